"""Screens over the one-row-per-symbol table, their summary figures, and the signal map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.constants import SCREEN_FIELDS
from tickerloom.operators.order_stats import exact_quantiles, upper_median

TRENDS = ("All", "Above SMA 50", "Below SMA 50")


def matches_text(term: str) -> Column:
    """Literal, case-blind part of the symbol or the company name."""
    wanted = F.lit(term.strip().casefold())
    return F.contains(F.lower("symbol"), wanted) | F.contains(F.lower(F.coalesce("company_name", F.lit(""))), wanted)


def criterion(df: DataFrame, column: str, operator: str, threshold: float) -> Column:
    """A missing value never passes."""
    if column not in df.columns:
        raise ValueError(f"unknown filter feature: {column}")
    if operator == ">=":
        return F.col(column) >= threshold
    if operator == "<=":
        return F.col(column) <= threshold
    raise ValueError(f"unsupported filter operator: {operator}")


def screen(
    df: DataFrame,
    search: str = "",
    rsi_range: tuple[float, float] = (0, 100),
    max_volatility: float = 200,
    trend: str = "All",
    include_benchmark: bool = True,
    numeric_filters: dict[str, tuple[str, float]] | None = None,
    labels: Sequence[str] | None = None,
    sort_by: str | None = None,
    ascending: bool = False,
    benchmark: str = "SPY",
) -> DataFrame:
    """All conditions must hold. RSI and volatility always take part, so rows without them drop out;
    an empty label list selects nothing, ``None`` switches the label condition off."""
    keep: list[Column] = [F.col("rsi_14").between(*rsi_range), F.col("volatility_pct") <= max_volatility]
    if not include_benchmark:
        keep.append(F.col("symbol") != benchmark)
    if search.strip():
        keep.append(matches_text(search))
    if trend == "Above SMA 50":
        keep.append(F.col("trend_above_sma50"))
    elif trend == "Below SMA 50":
        keep.append(~F.col("trend_above_sma50"))
    if labels is not None and "overall_label" in df.columns:
        keep.append(F.col("overall_label").isin(list(labels)) if labels else F.lit(False))
    for column, (operator, threshold) in (numeric_filters or {}).items():
        keep.append(criterion(df, column, operator, threshold))
    for condition in keep:
        df = df.where(condition)
    return sort_rows(df, sort_by, ascending) if sort_by else df


def screen_any_label(
    df: DataFrame,
    search: str = "",
    criteria: Sequence[tuple[str, str, float]] = (),
    labels: Sequence[str] = (),
    sort_by: str | None = "composite_score",
    ascending: bool = False,
    benchmark: str = "SPY",
) -> DataFrame:
    """Permissive screen: the benchmark never shows, an empty label list means no label condition,
    and nothing is filtered that was not asked for. A field may appear in several criteria."""
    df = df.where(F.col("symbol") != benchmark)
    if search:
        df = df.where(matches_text(search))
    if labels:
        df = df.where(F.col("overall_label").isin(list(labels)))
    for column, operator, threshold in criteria:
        if column not in SCREEN_FIELDS:
            raise ValueError(f"unknown filter feature: {column}")
        df = df.where(criterion(df, column, operator, threshold))
    return sort_rows(df, sort_by, ascending) if sort_by else df


def sort_rows(df: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    """Missing values last in either direction; equal values by symbol."""
    if column not in df.columns:
        raise ValueError(f"unknown sort feature: {column}")
    order = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    return df.orderBy(order, F.asc("symbol"))


def signal_map(df: DataFrame) -> DataFrame:
    """Every row, marked as plotted or not; size at least one, missing labels named."""
    return df.withColumns(
        {
            "eligible": F.col("rsi_14").isNotNull() & F.col("pe_ratio_raw").isNotNull(),
            "bubble_score": F.greatest(F.coalesce("composite_score", F.lit(1.0)), F.lit(1.0)),
            "overall_label": F.coalesce("overall_label", F.lit("Unavailable")),
        }
    )


def signal_map_counts(df: DataFrame) -> DataFrame:
    return signal_map(df).agg(
        F.count_if("eligible").alias("plotted"), F.count_if(~F.col("eligible")).alias("excluded")
    )


def quadrant_map(df: DataFrame) -> DataFrame:
    """Positive P/E only: reasons for rows left out, axis cap, dividing P/E and quadrant."""
    pe, rsi = F.col("pe_ratio_raw"), F.col("rsi_14")
    no_pe = ~F.coalesce(pe > 0, F.lit(False))
    plotted = rsi.isNotNull() & ~no_pe
    reasons = F.array_join(
        F.array_compact(F.array(F.when(rsi.isNull(), "RSI N/A"), F.when(no_pe, "P/E not meaningful"))), " · "
    )
    shown = df.where(plotted)
    middle = upper_median(shown, [], "pe_ratio_raw", "m")
    highest = shown.agg(F.max("pe_ratio_raw"))
    df = df.withColumns({"_middle": middle.scalar(), "_highest": highest.scalar()})
    divider = F.coalesce("_middle", F.lit(25.0))
    cap = F.greatest(F.lit(50.0), F.least(F.lit(200.0), F.coalesce("_highest", F.lit(50.0))))
    side = F.when(rsi >= 50, "stronger RSI").otherwise("cooler RSI")
    level = F.when(pe >= divider, "higher P/E").otherwise("lower P/E")
    return df.withColumns(
        {
            "plotted": plotted,
            "reasons": reasons,
            "pe_axis_cap": cap,
            "pe_divider": divider,
            "quadrant": F.when(plotted, F.concat_ws(", ", level, side)),
        }
    ).drop("_middle", "_highest")


def screener_kpis(shown: DataFrame, universe: DataFrame, benchmark: str = "SPY") -> DataFrame:
    """Rows shown of the universe, bullish rows, and the median RSI and volatility."""
    counts = shown.agg(
        F.count(F.lit(1)).alias("rows_shown"), F.count_if(F.col("signal") == "Bullish").alias("bullish")
    )
    total = universe.where(F.col("symbol") != benchmark).agg(F.count(F.lit(1)))
    return counts.withColumns(
        {
            "universe": total.scalar(),
            "median_rsi": exact_quantiles(shown, [], "rsi_14", {"m": 0.5}).scalar(),
            "median_volatility_pct": exact_quantiles(shown, [], "volatility_pct", {"m": 0.5}).scalar(),
        }
    )


def upper_median_kpis(shown: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper medians of several columns of one screen."""
    stacked = [F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in columns]
    return upper_median(shown.select(F.inline(F.array(*stacked))), ["field"], "value", "upper_median")


def market_breadth(df: DataFrame, benchmark: str = "SPY") -> DataFrame:
    """How much of the universe rises, beats the benchmark, or is labelled favourably; and the regime."""
    stock = F.col("symbol") != benchmark
    m = F.col("momentum_63d_raw_pct")
    market = df.where(~stock).agg(
        F.struct(F.max(m).alias("momentum"), F.max("daily_return_pct").alias("day")).alias("b")
    )
    df = df.withColumn("_b", market.scalar())
    counts = df.agg(
        F.count_if(stock).alias("stocks"),
        F.count_if(stock & (m > 0)).alias("positive_momentum"),
        F.count_if(stock & (m > F.col("_b.momentum"))).alias("beating_benchmark"),
        F.count_if(stock & F.col("overall_label").isin("Strong", "Positive")).alias("favorable_labels"),
        F.max("_b.momentum").alias("_m"),
        F.max("_b.day").alias("_d"),
    )
    base = F.greatest("stocks", F.lit(1))
    mm, dd = F.coalesce("_m", F.lit(0.0)), F.coalesce("_d", F.lit(0.0))
    return counts.withColumns(
        {
            "positive_momentum_pct": F.col("positive_momentum") / base * 100,
            "beating_benchmark_pct": F.col("beating_benchmark") / base * 100,
            "favorable_labels_pct": F.col("favorable_labels") / base * 100,
            "regime": F.when((mm > 0) & (dd > 0), "UPTREND").when((mm < 0) & (dd < 0), "DOWNTREND").otherwise("MIXED"),
        }
    ).drop("_m", "_d")
