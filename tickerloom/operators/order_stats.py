"""Exact ranks, positions and quantiles of groups of any size.

A plain ``rank()`` over one as-of date, or the built-in ``percentile``, brings the whole group into
one task. Here the ordered domain of all groups together is cut into ranges by split points taken
from a small sample, rows are ordered inside their range only, and a table with one row per
(group, range) supplies how many rows come before it. The split points decide the balance of the
work, never the result.

The number of ranges follows the session's shuffle partitions, so a larger cluster cuts finer. The
sample keeps, for each of a number of hash cells, the key with the smallest hash: bounded in size
for any input, combined map-side, and the same on every evaluation, so a recomputed task agrees
with the rest of the job.

Quantiles need no order of all values. One read of the input makes a mergeable sketch per group (the built-in
`percentile_approx`, whose rank error is bounded), out of which each wanted position gets a bracket of values that
holds it. The second read counts what lies between brackets and tallies the values inside them, about a
200th of a group each. The brackets are written down first, so every task of the second read has the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.stage import stage

RANGES_PER_PARTITION = 4
LEAST_RANGES = 256
CELLS_PER_RANGE = 16
#: Positions at which a sketch is read, and the inverse of its rank error.
SKETCH_POINTS = 512
SKETCH_ACCURACY = 4096


def range_number(spark: SparkSession) -> int:
    """How many ranges an ordered domain is cut into."""
    return max(LEAST_RANGES, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))


def _split_points(df: DataFrame, order: Sequence[str], ranges: int) -> DataFrame:
    """One row: sorted array of at most ranges - 1 keys taken from ``df``."""
    picked = (
        df.select(F.struct(*order).alias("key"), F.xxhash64(*order).alias("h"))
        .groupBy(F.pmod("h", F.lit(CELLS_PER_RANGE * ranges)).alias("cell"))
        .agg(F.min_by("key", "h").alias("key"))
        .agg(F.array_sort(F.collect_set("key")).alias("keys"))
    )
    step = F.greatest(F.lit(1), F.ceil(F.size("keys") / F.lit(ranges)))
    return picked.select(
        F.filter("keys", lambda _, i: (i > 0) & (i % step == 0)).alias("_splits")
    )


def _first_above(element, low: int, high: int, key: Column) -> Column:
    """How many of ``element(low) .. element(high - 1)``, which ascend, are at or below ``key``, plus
    ``low``; an element past the end of the array is null and counts as above."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(element(middle) <= key, _first_above(element, middle + 1, high, key)).otherwise(
        _first_above(element, low, middle, key)
    )


def with_range(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Add ``_range``: how many split points are at or below the row's key.

    A search of 15 compiled comparisons per level, each level sixteen times finer than the one before;
    as many levels as the number of ranges needs.
    """
    ranges = ranges or range_number(df.sparkSession)
    points = _split_points(df, order, ranges).scalar()
    found = df.withColumns({"_range_splits": points, "_range_key": F.struct(*order), "_range_at": F.lit(0)})
    splits, key, at = F.col("_range_splits"), F.col("_range_key"), F.col("_range_at")
    step = 1
    while 16 * step < ranges:
        step *= 16
    while step:
        within = _first_above(lambda i, step=step: F.get(splits, at + step * (i + 1) - 1), 0, 15, key)
        # explode of one element: each level stays in its place instead of being copied into the next.
        found = found.withColumn("_range_next", F.explode(F.array(at + step * within))).drop("_range_at").withColumnRenamed("_range_next", "_range_at")
        step //= 16
    return found.withColumnRenamed("_range_at", "_range").drop("_range_splits", "_range_key")


def _offsets(ranged: DataFrame, group: Sequence[str], weight: Column) -> DataFrame:
    """Rows before each range of a group, in it, and in the group. At most groups + ranges rows."""
    inside = W.partitionBy(*group)
    before = inside.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.groupBy(*group, "_range")
        .agg(F.sum(weight).alias("_held"))
        .select(
            *group,
            "_range",
            "_held",
            F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"),
            F.sum("_held").over(inside).alias("n_group"),
        )
    )


def rank_table(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """One row per distinct (group, value): ``n_less``, ``n_equal`` and ``n_group`` as longs.

    Equal values collapse before the shuffle, so a value held by most rows costs one row here.
    Null values take no part.
    """
    group = list(group) or ["_all"]
    source = df if group != ["_all"] else df.withColumn("_all", F.lit(0))
    tally = (
        source.where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("n_equal"))
    )
    ranged = with_range(tally, [*group, value])
    offsets = _offsets(ranged, group, F.col("n_equal"))
    smaller = W.partitionBy(*group, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    out = (
        ranged.withColumn("_within", F.coalesce(F.sum("n_equal").over(smaller), F.lit(0)))
        .join(offsets.drop("_held"), [*group, "_range"])
        .select(*group, value, "n_equal", (F.col("_before") + F.col("_within")).alias("n_less"), "n_group")
    )
    return out.drop("_all")


def join_ranks(values: DataFrame, ranks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Left join of every row to what its value got. Rows without a value get nothing and are dealt out by
    the hash of the whole row, or they would meet in one task."""
    spread = F.when(F.col(value).isNull(), F.xxhash64(*values.columns)).otherwise(F.lit(0).cast("long"))
    return (
        values.withColumn("_spread", spread)
        .join(ranks.withColumn("_spread", F.lit(0).cast("long")), [*keys, value, "_spread"], "left")
        .drop("_spread")
    )


def with_position(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add the zero-based ``position`` in the group and ``n_group``; ``order`` must be unique in it."""
    group = list(group) or ["_all"]
    source = df if group != ["_all"] else df.withColumn("_all", F.lit(0))
    ranged = with_range(source, [*group, *order])
    offsets = _offsets(ranged, group, F.lit(1))
    w = W.partitionBy(*group, "_range").orderBy(*order)
    return (
        ranged.withColumn("_row", F.row_number().over(w))
        .join(offsets.drop("_held"), [*group, "_range"])
        .withColumn("position", F.col("_before") + F.col("_row") - 1)
        .drop("_all", "_range", "_before", "_row")
    )


def _holds(position: Column) -> Column:
    return (F.col("n_less") <= position) & (position < F.col("n_less") + F.col("n_equal"))


def _brackets(df: DataFrame, group: Sequence[str], value: str, positions: Sequence[tuple[Column, Column]], also: Sequence[Column]) -> DataFrame:
    """One row per group, written: ``n_group`` values, ``also``, and ``_low0``, ``_high0`` .. with the values from and to
    which the first (low, high) of ``positions`` must lie; null where nothing bounds it.

    Point j of the sketch has a rank within the rank error of j shares of the group, so the point taken for
    the lower end is at most the wanted rank and that for the upper end at least.
    """
    points = ", ".join(f"{j / SKETCH_POINTS!r}D" for j in range(SKETCH_POINTS + 1))
    sketched = df.groupBy(*group).agg(
        F.count(value).alias("n_group"),
        F.expr(f"percentile_approx(`{value}`, array({points}), {SKETCH_ACCURACY})").alias("_points"),
        *also,
    )
    share, error = F.try_divide(F.lit(float(SKETCH_POINTS)), F.col("n_group")), SKETCH_POINTS / SKETCH_ACCURACY
    ends = []
    for i, (low, high) in enumerate(positions):
        first = F.floor(low * share - error).cast("int")
        last = F.ceil((high + 1) * share + error).cast("int")
        ends.append(F.when(first >= 0, F.get("_points", first)).alias(f"_low{i}"))
        ends.append(F.when(last <= SKETCH_POINTS, F.get("_points", last)).alias(f"_high{i}"))
    return stage(sketched.select("*", *ends).drop("_points"), "quantiles")


def _near_positions(df: DataFrame, brackets: DataFrame, group: Sequence[str], value: str, number: int) -> DataFrame:
    """The part of the rank table that lies in the brackets: ``n_less`` and ``n_equal`` of each value there.

    Values outside are counted by the number of brackets below them, so they lie before the values
    inside that have as many below; they are never shuffled or sorted.
    """
    at, inside = F.lit(0), F.lit(False)
    for i in range(number):
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        at = at + F.coalesce(high < F.col(value), F.lit(False)).cast("int")
        inside = inside | ((low.isNull() | (low <= F.col(value))) & (high.isNull() | (F.col(value) <= high)))
    # A row per group: Spark sends it to the values where its written size allows, else skew is split.
    ends = brackets.select(*group, "n_group", *[f"_{e}{i}" for i in range(number) for e in ("low", "high")])
    tally = (
        df.where(F.col(value).isNotNull()).select(*group, value).join(ends, list(group))
        .groupBy(*group, "n_group", at.alias("_at"), F.when(inside, F.col(value)).alias(value))
        .agg(F.count(F.lit(1)).alias("n_equal"))
    )
    below = (
        tally.groupBy(*group, "_at").agg(F.sum("n_equal").alias("_held"))
        .select(*group, "_at", (F.sum("_held").over(W.partitionBy(*group).orderBy("_at")) - F.col("_held")).alias("_before"))
    )
    smaller = W.partitionBy(*group, "_at").orderBy(F.col(value).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    return (
        tally.withColumn("_within", F.coalesce(F.sum("n_equal").over(smaller), F.lit(0)))
        .join(below, [*group, "_at"])
        .select(*group, value, "n_equal", (F.col("_before") + F.col("_within")).alias("n_less"), "n_group")
        .where(F.col(value).isNotNull())
    )


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, quantiles: dict[str, float], also: Sequence[Column] = (), counts: bool = False
) -> DataFrame:
    """Linear-interpolation quantiles, one column per entry of ``quantiles``, one row per group with a value.

    ``also``: named aggregates over all rows of a group, taken along in the first read; groups without a value then
    have a row too. ``counts`` adds ``<name>_below`` and ``<name>_above``, how many values are less and greater.
    """
    for q in quantiles.values():
        if not 0 <= q <= 1:
            raise ValueError(f"quantile outside 0-1: {q}")
    keys = list(group) or ["_all"]
    source = df if group else df.withColumn("_all", F.lit(0))
    places = {name: (F.col("n_group") - 1) * F.lit(float(q)) for name, q in quantiles.items()}
    brackets = _brackets(source, keys, value, [(F.floor(at), F.ceil(at)) for at in places.values()], also)
    near = _near_positions(source, brackets, keys, value, len(places))
    held = F.struct(F.col(value).alias("value"), "n_less", "n_equal")
    picks, columns = [F.max("n_group").alias("_n")], []
    for name, at in places.items():
        picks += [
            F.max(F.when(_holds(F.floor(at)), held)).alias(f"_{name}_low"),
            F.max(F.when(_holds(F.ceil(at)), held)).alias(f"_{name}_high"),
            F.max(at - F.floor(at)).alias(f"_{name}_share"),
        ]
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        lo, hi = low["value"], high["value"]
        found = _found(low, lo + (hi - lo) * F.col(f"_{name}_share"))
        columns.append(found.alias(name))
        if counts:
            columns += [
                F.when(found <= lo, low["n_less"]).otherwise(high["n_less"]).alias(f"{name}_below"),
                (F.col("_n") - high["n_less"] - F.when(found < hi, 0).otherwise(high["n_equal"])).alias(f"{name}_above"),
            ]
    out = _per_group(near, group, picks).select(*group, *columns)
    if not also:
        return out
    first = brackets.drop("n_group", *[f"_{e}{i}" for i in range(len(places)) for e in ("low", "high")])
    return first.join(out, list(group), "left")


def _found(held: Column, result: Column) -> Column:
    """``result``, or the failure of the job where a group has values and none was at the wanted position."""
    missed = F.col("_n").isNotNull() & held.isNull()
    return F.when(missed, F.raise_error(F.lit("a wanted position lies outside its bracket"))).otherwise(result)


def _per_group(near: DataFrame, group: Sequence[str], picks: list[Column]) -> DataFrame:
    """One row per group; without a group always one row, even of nothing."""
    return near.groupBy(*group).agg(*picks) if group else near.agg(*picks)


def upper_median(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Element at index floor(n/2) of the sorted values: the larger middle one when n is even."""
    keys = list(group) or ["_all"]
    source = df if group else df.withColumn("_all", F.lit(0))
    middle = F.floor(F.col("n_group") / 2)
    brackets = _brackets(source, keys, value, [(middle, middle)], [])
    near = _near_positions(source, brackets, keys, value, 1)
    picked = F.max(F.when(_holds(middle), F.struct(F.col(value).alias("value")))).alias("_held")
    held = _per_group(near, group, [F.max("n_group").alias("_n"), picked])
    return held.select(*group, _found(F.col("_held"), F.col("_held.value")).alias(name))
