"""Reports over panels and snapshots: coverage, missing values, distributions, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.constants import (
    BETA_WINDOWS,
    CORRELATION_FEATURES,
    DISTRIBUTION_FEATURES,
    METADATA_COLUMNS,
    STOCK_ONLY_COLUMNS,
)
from tickerloom.operators.order_stats import exact_quantiles, with_position
from tickerloom.operators.snapshot import first_per_symbol
from tickerloom.operators.transform import long_features

LIST_BLOCK = 1000


def listed_in_blocks(df: DataFrame, group: Sequence[str], item: str, name: str, block: int = LIST_BLOCK) -> DataFrame:
    """Sorted, comma-joined items per group in blocks of ``block``: a short list is one row, a long
    one continues in the next block, so no row or task ever holds an unbounded list."""
    placed = with_position(df.select(*group, item), group, [item])
    return (
        placed.withColumn("list_part", F.floor(F.col("position") / block).cast("long"))
        .groupBy(*group, "list_part")
        .agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias(name))
    )


def feature_report(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, symbols and available values per indicator, in one pass."""
    return features.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("symbol").alias("symbols"),
        *[F.count(c).alias(f"{c}_non_null") for c in columns],
    )


def first_return_check(features: DataFrame) -> DataFrame:
    """The first row of each symbol has no return; says so for both kinds."""
    first = first_per_symbol(features.select("symbol", "date", "simple_return", "log_return"))
    return first.agg(
        F.count(F.lit(1)).alias("first_rows"),
        F.bool_and(F.col("simple_return").isNull()).alias("first_simple_return_all_null"),
        F.bool_and(F.col("log_return").isNull()).alias("first_log_return_all_null"),
    )


def _assessed(master: DataFrame) -> list[str]:
    return [c for c in master.columns if c not in METADATA_COLUMNS]


def _missing_flags(master: DataFrame) -> DataFrame:
    """``symbol, feature, scope, missing`` for every eligible cell."""
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit("stocks_only" if c in STOCK_ONLY_COLUMNS else "stocks_and_benchmark").alias("scope"),
            (F.lit(c not in STOCK_ONLY_COLUMNS) | ~F.col("is_benchmark")).alias("eligible"),
            F.col(c).isNull().alias("missing"),
        )
        for c in _assessed(master)
    ]
    return master.select("symbol", "is_benchmark", F.inline(F.array(*cells)))


def missing_report(master: DataFrame) -> DataFrame:
    """One row per feature: missing and available values among the rows that can have it. The symbols behind
    the counts are rows of ``missing_by_symbol``, whatever their number."""
    per_feature = _missing_flags(master).groupBy("feature", "scope").agg(
        F.count_if("eligible").alias("eligible_rows"),
        F.count_if(F.col("eligible") & F.col("missing")).alias("missing_count"),
        F.bool_or(F.col("is_benchmark")).alias("_has_benchmark"),
    )
    return per_feature.select(
        "feature", "scope", "eligible_rows", "missing_count",
        (F.col("eligible_rows") - F.col("missing_count")).alias("available_count"),
        F.try_divide("missing_count", "eligible_rows").alias("missing_rate"),
        ((F.col("scope") == "stocks_only") & F.col("_has_benchmark")).alias("benchmark_not_applicable"),
    )


def missing_by_symbol(master: DataFrame) -> DataFrame:
    return (
        _missing_flags(master)
        .where(F.col("eligible") & F.col("missing"))
        .select("symbol", "feature", F.lit("eligible_missing").alias("scope"))
    )


def missing_summary(master: DataFrame) -> DataFrame:
    report = missing_report(master)
    some = F.col("missing_count") > 0
    features = report.agg(
        F.count(F.lit(1)).alias("features_assessed"),
        F.count_if(some & (F.col("scope") == "stocks_only")).alias("features_with_stock_missing"),
        F.count_if(some).alias("features_with_any_eligible_missing"),
    )
    rows = master.agg(
        F.struct(
            F.count(F.lit(1)).alias("master_rows"),
            F.count_if(~F.col("is_benchmark")).alias("stock_rows"),
            F.count_if(F.col("is_benchmark")).alias("benchmark_rows"),
        ).alias("r")
    )
    return features.withColumn("_r", rows.scalar()).select("_r.*", *features.columns)


def skewness(value: str) -> Column:
    """Bias-corrected sample skewness: 0 for a constant, null below three values."""
    n = F.count(value)
    corrected = F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, None).when(F.max(value) == F.min(value), 0.0).otherwise(corrected)


def distribution_statistics(df: DataFrame, features: Sequence[str] = DISTRIBUTION_FEATURES) -> DataFrame:
    values = long_features(df, features, ids=())
    moments = [
        F.count(F.lit(1)).alias("eligible_rows"),
        F.count("value").alias("available_count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        skewness("value").alias("skewness"),
    ]
    described = exact_quantiles(
        values, ["feature"], "value", {"median": 0.5, "p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95}, also=moments
    )
    missing = F.col("eligible_rows") - F.col("available_count")
    return described.withColumns(
        {
            "missing_count": missing,
            "missing_rate": F.try_divide(missing, F.col("eligible_rows")),
            "strong_skew_flag": F.when(F.col("available_count") >= 3, F.abs("skewness") > 1),
        }
    )


def histogram(df: DataFrame, features: Sequence[str] = DISTRIBUTION_FEATURES) -> DataFrame:
    """Equal-width bins per feature, 5 to 10 of them; the last bin includes its upper edge."""
    values = long_features(df, features, ids=()).where(F.col("value").isNotNull())
    span = values.groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n")
    )
    bins = F.least(F.lit(10), F.greatest(F.lit(5), F.floor(F.col("n") / 2))).cast("long")
    # A constant feature gets the unit interval around its value.
    flat = F.col("lo") == F.col("hi")
    span = span.select(
        "feature", bins.alias("bins"),
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    at = F.floor((F.col("value") - F.col("lo")) / width)
    counted = (
        values.join(F.broadcast(span), "feature")  # one row per feature name
        .groupBy("feature", "bins", "lo", "hi", F.least(at, F.col("bins") - 1).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_values"))
    )
    every = span.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)))
    return (
        every.join(counted.select("feature", "bin", "n_values"), ["feature", "bin"], "left")
        .select(
            "feature", "bin",
            (F.col("lo") + F.col("bin") * width).alias("bin_from"),
            (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_to"),
            F.coalesce("n_values", F.lit(0).cast("long")).alias("n_values"),
        )
    )


def boxplot(df: DataFrame, features: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers at the furthest value within 1.5 interquartile ranges, outliers beyond."""
    values = long_features(df, features, ids=()).where(F.col("value").isNotNull())
    quartiles = exact_quantiles(values, ["feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    low, high = F.col("q1") - reach, F.col("q3") + reach
    inside = F.col("value").between(low, high)
    return (
        values.join(F.broadcast(quartiles), "feature")  # one row per feature name
        .groupBy("feature", "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n_values"),
            F.min(F.when(inside, F.col("value"))).alias("_low"),
            F.max(F.when(inside, F.col("value"))).alias("_high"),
            F.count_if(F.col("value") < low).alias("low_outliers"),
            F.count_if(F.col("value") > high).alias("high_outliers"),
        )
        # A whisker never ends inside the box.
        .withColumns(
            {"whisker_low": F.least("_low", "q1"), "whisker_high": F.greatest("_high", "q3")}
        )
        .drop("_low", "_high")
    )


def _pairs(names: Sequence[str], diagonal: bool) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i if diagonal else i + 1:]]


def _pearson(a: str, b: str) -> Column:
    """Null, not an error, when either side is constant."""
    return F.try_divide(F.regr_sxy(b, a), F.sqrt(F.regr_sxx(b, a) * F.regr_syy(b, a)))


def _pair_aggregates(df: DataFrame, features: dict[str, str], diagonal: bool, minimum: int) -> DataFrame:
    """One pass: an aggregate per feature pair, then stacked. The number of pairs depends on the
    feature list only, never on the rows."""
    columns = {name: f"v{i}" for i, name in enumerate(features)}
    numeric = df.select([F.col(source).cast("double").alias(columns[name]) for name, source in features.items()])
    pairs = _pairs(list(features), diagonal)
    aggregates = []
    for i, (a, b) in enumerate(pairs):
        x, y = columns[a], columns[b]
        n = F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull())
        aggregates += [n.alias(f"n{i}"), F.when(n >= minimum, _pearson(x, y)).alias(f"r{i}")]
    rows = [
        F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"),
                 F.col(f"r{i}").alias("correlation"), F.col(f"n{i}").alias("pairwise_observations"))
        for i, (a, b) in enumerate(pairs)
    ]
    return numeric.agg(*aggregates).select(F.inline(F.array(*rows)))


def correlation_matrix(df: DataFrame, features: dict[str, str] | None = None, minimum: int = 3) -> DataFrame:
    """Pearson over pairwise complete rows as a full matrix, one row per feature; null below ``minimum``."""
    features = features or CORRELATION_FEATURES
    half = _pair_aggregates(df, features, True, minimum)
    return _square(half, "correlation", list(features))


def pair_counts(df: DataFrame, features: dict[str, str] | None = None) -> DataFrame:
    features = features or CORRELATION_FEATURES
    half = _pair_aggregates(df, features, True, 3)
    return _square(half, "pairwise_observations", list(features))


def _square(half: DataFrame, value: str, names: list[str]) -> DataFrame:
    mirrored = half.select("feature_1", "feature_2", value).unionByName(
        half.where("feature_1 <> feature_2").select(
            F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"), value
        )
    )
    return mirrored.groupBy(F.col("feature_1").alias("feature")).agg(
        *[F.max(F.when(F.col("feature_2") == n, F.col(value))).alias(n) for n in names]
    )


def ranked_pairs(df: DataFrame, features: dict[str, str] | None = None) -> DataFrame:
    """Distinct pairs, strongest absolute correlation first."""
    features = features or CORRELATION_FEATURES
    return (
        _pair_aggregates(df, features, False, 3)
        .withColumn("absolute_correlation", F.abs("correlation"))
        .orderBy(F.desc_nulls_last("absolute_correlation"), "feature_1", "feature_2")
    )


def correlation_summary(df: DataFrame, features: dict[str, str] | None = None, least: float = 0.70) -> DataFrame:
    """One row: rows, pairs, pairs with a correlation, and how many are at or above ``least`` in absolute value."""
    pairs = _pair_aggregates(df, features or CORRELATION_FEATURES, False, 3).agg(
        F.count(F.lit(1)).alias("pairs"), F.count("correlation").alias("pairs_with_correlation"),
        F.count_if(F.abs("correlation") >= least).alias("strong_pairs"), F.max(F.abs("correlation")).alias("strongest"),
    )
    return pairs.withColumns({"rows": df.agg(F.count(F.lit(1))).scalar(), "least": F.lit(least), "method": F.lit("Pearson")})


def symbol_quality(features: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows, span, missing values and repeated days per symbol; repeated days are combined first."""
    per_day = features.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(out) for out, c in columns.items()]
    )
    return per_day.groupBy("symbol").agg(
        F.sum("n").alias("rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        *[F.sum(out).alias(out) for out in columns],
        F.sum(F.col("n") - 1).alias("duplicate_dates"),
    )


def master_coverage(master: DataFrame) -> DataFrame:
    stock = ~F.col("is_benchmark")
    flags = ["has_fundamentals", "has_beta", "has_momentum", "has_growth"]
    return master.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(stock).alias("stock_rows"),
        F.count_if(F.col("is_benchmark")).alias("benchmark_rows"),
        (F.count(F.lit(1)) - F.count_distinct("symbol")).alias("duplicate_symbols"),
        *[F.count_if(stock & F.col(f)).alias(f.replace("has_", "stocks_with_")) for f in flags],
    )


def latest_coverage(latest: DataFrame, columns: Sequence[str] = tuple(f"beta_{n}" for n in BETA_WINDOWS)) -> DataFrame:
    return latest.agg(F.count(F.lit(1)).alias("symbols"), *[F.count(c).alias(f"{c}_available") for c in columns])


def growth_coverage(growth: DataFrame) -> DataFrame:
    return growth.agg(
        F.count(F.lit(1)).alias("symbols"),
        F.count_if("revenue_growth_available").alias("revenue_growth_yoy_available"),
        F.count_if("profit_margin_available").alias("profit_margin_available"),
        F.count_if("unusual_margin_flag").alias("unusual_margin_flags"),
    )


def score_coverage(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count(F.lit(1)).alias("stocks"),
        F.count_if(~F.col("incomplete_score_flag")).alias("full_coverage_stocks"),
        F.count_if("incomplete_score_flag").alias("incomplete_stocks"),
        F.count_if("score_eligible").alias("eligible_stocks"),
    )
