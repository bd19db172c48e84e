"""Momentum quintiles and their forward returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.indicators import add_forward_return, add_momentum
from tickerloom.operators.keys import assert_unique, require_columns
from tickerloom.operators.order_stats import exact_quantiles, with_position


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def minimum_cross_section(df: DataFrame, n: int = 10) -> DataFrame:
    """Rows of the days on which at least ``n`` symbols are usable.

    Days are counted map-side and joined back: one row per calendar day, so that side is small."""
    days = df.groupBy("date").agg(F.count("symbol").alias("_n")).where(F.col("_n") >= n).select("date")
    return df.join(F.broadcast(days), "date", "left_semi")


def add_quantile_bin(df: DataFrame, signal: str, bins: int = 5, name: str = "quintile") -> DataFrame:
    """Equal-count bins of each day's signal; ties are ordered by symbol.

    The bin edges are the interpolated quantiles of the positions, so with ``r`` counted from zero the
    bin is ``ceil(bins * r / (n - 1))``, at least one. Integer arithmetic keeps edges exact.
    """
    placed = with_position(df, ["date"], [signal, "symbol"])
    r, n = F.col("position"), F.col("n_group")
    up = F.expr(f"({bins} * position + n_group - 2) div greatest(n_group - 1, 1)")
    return placed.withColumn(name, F.greatest(F.lit(1).cast("long"), F.when(n > 1, up).otherwise(r * 0 + 1)).cast("int")).drop(
        "position", "n_group"
    )


def momentum_observations(
    prices: DataFrame,
    benchmark: str,
    momentum_window: int = 63,
    forward_window: int = 21,
    minimum_universe: int = 10,
    price: str = "adjusted_close",
    validate: bool = False,
) -> DataFrame:
    """Formation-day rows with signal, quintile, forward return and hit flag."""
    return bin_observations(
        signal_rows(prices, benchmark, momentum_window, forward_window, price, validate),
        momentum_window, forward_window, minimum_universe,
    )


def signal_rows(
    prices: DataFrame, benchmark: str, momentum_window: int = 63, forward_window: int = 21,
    price: str = "adjusted_close", validate: bool = False,
) -> DataFrame:
    """Rows with both a signal and an outcome. Stage this table before binning a large panel: the
    ranks read it more than once."""
    require_columns(prices, ["symbol", "date", price], "momentum research")
    df = prices.where(F.col("symbol") != benchmark).select("symbol", "date", price)
    if validate:
        assert_unique(df, ["symbol", "date"], "momentum research")
    signal, outcome = f"momentum_{momentum_window}d", f"forward_return_{forward_window}d"
    df = add_forward_return(add_momentum(df, (momentum_window,), price), forward_window, price)
    return complete_cases(df.drop(f"{signal}_n_obs"), [signal, outcome])


def bin_observations(
    rows: DataFrame, momentum_window: int = 63, forward_window: int = 21, minimum_universe: int = 10
) -> DataFrame:
    signal, outcome = f"momentum_{momentum_window}d", f"forward_return_{forward_window}d"
    df = add_quantile_bin(minimum_cross_section(rows, minimum_universe), signal)
    return df.withColumn("forward_hit", F.col(outcome) > 0)


def quintile_summary(observations: DataFrame, outcome: str = "forward_return_21d") -> DataFrame:
    means = [
        F.count(F.lit(1)).alias("observations"),
        F.count_distinct("date").alias("dates"),
        F.avg(outcome).alias("mean_forward_return"),
        F.avg(F.col("forward_hit").cast("double")).alias("hit_rate"),
    ]
    rows = observations.where(F.col("quintile").isNotNull())
    summary = exact_quantiles(rows, ["quintile"], outcome, {"median_forward_return": 0.5}, also=means)
    return summary.where(F.col("median_forward_return").isNotNull())


def spread_by_date(observations: DataFrame, outcome: str = "forward_return_21d") -> DataFrame:
    wide = observations.groupBy("date").pivot("quintile", [1, 2, 3, 4, 5]).agg(F.avg(outcome))
    wide = wide.select("date", *[F.col(str(q)).alias(f"q{q}") for q in range(1, 6)])
    return wide.select("date", "q1", "q5", (F.col("q5") - F.col("q1")).alias("top_minus_bottom"))


def research_report(observations: DataFrame, outcome: str = "forward_return_21d") -> DataFrame:
    spread = spread_by_date(observations, outcome).where(F.col("top_minus_bottom").isNotNull())
    # One spread per calendar day: small enough for the built-in exact median.
    result = spread.agg(
        F.struct(
            F.avg("top_minus_bottom").alias("mean_top_minus_bottom"),
            F.median("top_minus_bottom").alias("median_top_minus_bottom"),
            F.avg((F.col("top_minus_bottom") > 0).cast("double")).alias("positive_spread_hit_rate"),
        ).alias("s")
    )
    return (
        observations.agg(
            F.count(F.lit(1)).alias("observations"),
            F.count_distinct("date").alias("formation_dates"),
            F.count_distinct("symbol").alias("symbols"),
        )
        .withColumn("_s", result.scalar())
        .select("observations", "formation_dates", "symbols", "_s.*")
    )
