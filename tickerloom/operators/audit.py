"""Checks that results do not depend on the future, and agree with a second computation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.keys import DataQualityError

INDICATORS = [
    "simple_return", "log_return", "sma_20", "sma_50", "ema_20", "rsi_14",
    "volatility_20d_annualized", "drawdown", "max_drawdown_to_date",
]


def future_dates(df: DataFrame, as_of, columns: Sequence[str], check: str) -> DataFrame:
    """``check, column_name, violations``: populated dates later than ``as_of``, in one pass."""
    present = [c for c in columns if c in df.columns]
    limit = F.lit(as_of).cast("date") if not hasattr(as_of, "_jc") else as_of
    df = df.withColumn("_as_of", limit)
    counts = df.agg(*[F.count_if(F.to_date(c) > F.col("_as_of")).alias(f"c{i}") for i, c in enumerate(present)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("violations")) for i, c in enumerate(present)]
    return counts.select(F.lit(check).alias("check"), F.inline(F.array(*rows)))


def lookahead_audit(features: DataFrame, master: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Dates after the latest price day, per date column of the three tables."""
    as_of = features.agg(F.max("date")).scalar()
    filed = [c for c in fundamentals.columns if c.endswith("_filed")]
    ends = [c for c in fundamentals.columns if c.endswith("_period_end")]
    return (
        future_dates(features, as_of, ["date"], "technical_dates_after_as_of")
        .unionByName(future_dates(master, as_of, ["date"], "master_dates_after_as_of"))
        .unionByName(future_dates(fundamentals, as_of, filed, "fundamental_filing_dates_after_as_of"))
        .unionByName(future_dates(fundamentals, as_of, ends, "fundamental_period_ends_after_as_of"))
    )


def assert_no_lookahead(audit: DataFrame) -> None:
    bad = audit.where(F.col("violations") > 0).collect()  # one row per date column
    if bad:
        raise DataQualityError(f"look-ahead audit failed: {[(r.check, r.column_name, r.violations) for r in bad]}")


def prefix_invariance(full: DataFrame, prefix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of the prefix whose features differ, bit for bit, from the same rows of the full run.

    A symbol's rows of both runs, which the calendar bounds, meet in one row and are then grouped by day: where the runs are
    dealt out by symbol already, as windows leave them, neither is exchanged again. A join on symbol and day would exchange
    both. A row without a symbol or a day has no row to agree with.
    """
    keys, row = ["symbol", "date"], F.struct("date", F.struct(*columns).alias("row"))
    ran = prefix.groupBy("symbol").agg(F.collect_list(row).alias("a"))
    held = ran.join(full.dropna(subset=keys).groupBy("symbol").agg(F.collect_list(row).alias("b")), "symbol", "left")
    # An array past its end is null, and so is the field of a null: each row keeps its own side only.
    a = F.transform("a", lambda x: F.struct(x["date"].alias("date"), x["row"].alias("a"), F.get("b", F.lit(-1))["row"].alias("b")))
    b = F.transform("b", lambda x: F.struct(x["date"].alias("date"), F.get("a", F.lit(-1))["row"].alias("a"), x["row"].alias("b")))
    days = held.select("symbol", F.explode(F.array(a, b)).alias("side")).select("symbol", F.inline("side")).groupBy(*keys)
    pairs = days.agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")).select(F.explode("a").alias("a"), "b")
    pairs = pairs.select("a", F.explode_outer("b").alias("b"))
    differs = [F.count_if(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"{c}_changed") for c in columns]
    return pairs.agg(F.count(F.lit(1)).alias("rows_compared"), *differs)


def _same(stored: str, value: str, rtol: float, atol: float) -> str:
    return f"(({stored}) <=> ({value}) OR coalesce(abs(({stored}) - ({value})) <= {atol}D + {rtol}D * abs({value}), false))"


def _checked_fold(start: dict[str, str], step: dict[str, str], value: str, stored: str, rtol: float, atol: float) -> str:
    """A fold over ``bars`` that compares as it goes: its state is a handful of numbers, however many days there are.

    ``step`` gives each number from the state ``s`` and the bar ``x``; ``value`` is the indicator that the state stands
    for. A bar's stored indicator is compared when the next one arrives, so nothing is worked out twice.
    """
    same, error = _same("s.w", value, rtol, atol), f"abs(s.w - ({value}))"
    zero = ", ".join(f"'{k}', {v}" for k, v in start.items())
    moved = ", ".join(f"'{k}', {v}" for k, v in step.items())
    return (
        f"aggregate(bars, named_struct({zero}, 'w', cast(NULL AS double), 'any', false, 'ok', true, 'e', cast(NULL AS double)), "
        f"(s, x) -> named_struct({moved}, 'w', cast(x.{stored} AS double), 'any', true, 'ok', s.ok AND (NOT s.any OR {same}), 'e', greatest(s.e, {error})), "
        f"s -> named_struct('indicator', '{stored}', 'passed', s.ok AND (NOT s.any OR {same}), 'max_abs_error', greatest(s.e, {error})))"
    )


def _joined(values: str, parts: Sequence[tuple[str, int]]) -> str:
    """The sum of ``values`` up to each index and of those that each array of ``parts`` holds so many places before it; null
    where one is missing or lies before the start."""
    return f"transform({values}, (x, i) -> x" + "".join(f" + get({of}, i - {back})" for of, back in parts) + ")"


def _spread(squares: str, sums: str, n: int) -> str:
    """Squared deviations from the mean of the last ``2 n`` values, out of those of both halves and of their sums."""
    return f"transform({squares}, (x, i) -> x + get({squares}, i - {n}) + pow(get({sums}, i) - get({sums}, i - {n}), 2) / {2 * n})"


def independent_recompute(features: DataFrame, rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """``symbol, indicator, passed, max_abs_error``: nine indicators worked out again from their definitions.

    A symbol's closes are one array in order of days, which the calendar bounds: a repeated day fails the job.
    Averages and deviations of a window are put together from those of its halves, recurrences are folds whose state does not
    grow, so the time is proportional to the days and nothing is shared with the window expressions under test. A missing close
    ends the RSI; the average of prices discounts what it skips; a window with one in it has no value.
    """
    fields = ", ".join(["date", "close", *INDICATORS])
    # Days are counted in the sorted array: a distinct count beside the list would exchange every bar twice.
    bars = features.groupBy("symbol").agg(F.expr(f"array_sort(collect_list(struct({fields})))").alias("bars"))
    once = F.expr("forall(bars, b -> b.date IS NOT NULL) AND size(array_distinct(transform(bars, b -> b.date))) = size(bars)")
    again = F.raise_error(F.lit("features contain duplicate symbol/date keys")).cast("boolean")
    df = bars.where(F.when(once, True).otherwise(again)).select("symbol", "bars", F.expr("transform(bars, b -> cast(b.close AS double))").alias("c"))
    df = df.select(
        "*",
        F.expr("transform(c, (x, i) -> try_divide(x, get(c, i - 1)) - 1)").alias("simple_return"),
        F.expr("transform(c, (x, i) -> ln(x) - ln(get(c, i - 1)))").alias("log_return"),
    )

    # The last 2, 4, 8 .. values are two halves put together: a window of n costs a few steps, not n.
    for n in (1, 2, 4, 8, 16):
        halves = {of: _joined(f"{of}{n}" if n > 1 else column, [(f"{of}{n}" if n > 1 else column, n)]) for of, column in (("c", "c"), ("r", "log_return"))}
        squares = "transform(log_return, (x, i) -> pow(x - get(log_return, i - 1), 2) / 2)" if n == 1 else _spread(f"q{n}", f"r{n}", n)
        kept = {f"{of}{2 * n}": e for of, e in halves.items() if of == "c" or n < 16} | ({f"q{2 * n}": squares} if n < 16 else {})
        df = df.select("*", *[F.expr(e).alias(name) for name, e in kept.items()])
    parts = "pow(get(r16, i) / 16 - get(r4, i - 16) / 4, 2) * 16 * 4 / 20"
    df = df.select(
        "*",
        F.expr(f"transform({_joined('c16', [('c4', 16)])}, x -> x / 20)").alias("sma_20"),
        F.expr(f"transform({_joined('c32', [('c16', 32), ('c2', 48)])}, x -> x / 50)").alias("sma_50"),
        F.expr(f"transform(q16, (x, i) -> sqrt((x + get(q4, i - 16) + {parts}) / 19 * 252))").alias("volatility_20d_annualized"),
    )
    nothing, close = "cast(NULL AS double)", "cast(x.close AS double)"
    keep = "pow(19D / 21, s.skipped + 1)"
    average = _checked_fold(
        {"v": nothing, "skipped": "0", "seen": "0"},
        {
            "v": f"CASE WHEN x.close IS NULL THEN s.v WHEN s.v IS NULL THEN {close} ELSE ({keep} * s.v + 2D / 21 * {close}) / ({keep} + 2D / 21) END",
            "skipped": "CASE WHEN x.close IS NULL THEN s.skipped + 1 ELSE 0 END", "seen": "CASE WHEN x.close IS NULL THEN s.seen ELSE s.seen + 1 END",
        },
        "CASE WHEN s.seen >= 20 THEN s.v END", "ema_20", rtol, atol,
    )

    def smoothed(side: str, sign: str) -> str:
        """Wilder: the mean of the first 14 moves, then 13 parts of it and one part of each later move."""
        move = f"coalesce(greatest({sign}({close} - s.prev), 0D), 0D)"
        return f"CASE WHEN s.i < 12 THEN s.{side} + {move} WHEN s.i = 12 THEN (s.{side} + {move}) / 14 ELSE (13 * s.{side} + {move}) / 14 END"

    strength = _checked_fold(
        {"i": "-2", "prev": nothing, "up": "0D", "down": "0D", "known": "true"},
        {
            "i": "s.i + 1", "prev": close, "up": smoothed("up", ""), "down": smoothed("down", "-"),
            "known": f"s.known AND (s.i = -2 OR ({close} - s.prev) IS NOT NULL)",
        },
        "CASE WHEN s.i < 13 OR NOT s.known THEN NULL WHEN s.up + s.down = 0 THEN 50D ELSE 100 * s.up / (s.up + s.down) END", "rsi_14", rtol, atol,
    )
    peak = {"peak": f"greatest(s.peak, {close})", "c": close}
    fall = _checked_fold({"peak": nothing, "c": nothing}, peak, "s.c / s.peak - 1", "drawdown", rtol, atol)
    worst = _checked_fold(
        {"peak": nothing, "c": nothing, "worst": nothing}, peak | {"worst": f"least(s.worst, {close} / greatest(s.peak, {close}) - 1)"},
        "CASE WHEN s.c IS NOT NULL THEN s.worst END", "max_drawdown_to_date", rtol, atol,
    )

    def compared(name: str) -> str:
        stored = f"transform(bars, b -> cast(b.{name} AS double))"
        return (
            f"named_struct('indicator', '{name}', 'passed', forall(zip_with({stored}, {name}, (a, b) -> {_same('a', 'b', rtol, atol)}), x -> x), "
            f"'max_abs_error', array_max(zip_with({stored}, {name}, (a, b) -> abs(a - b))))"
        )

    listed = ["simple_return", "log_return", "sma_20", "sma_50", "volatility_20d_annualized"]
    return df.select("symbol", F.expr(f"inline(array({', '.join([*map(compared, listed), average, strength, fall, worst])}))"))
