"""Provider valuation and winsorised features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.constants import WINSOR_FEATURES
from tickerloom.functions.scalars import clip, lenient_number
from tickerloom.operators.keys import one_row_each
from tickerloom.operators.order_stats import exact_quantiles

PE_SOURCE = "provider overview PERatio"


def long_features(df: DataFrame, features: Sequence[str], ids: Sequence[str] = ("symbol",)) -> DataFrame:
    """``ids, feature, value`` with one row per feature; one pass over the wide table."""
    stacked = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    return df.select(*ids, F.inline(F.array(*stacked)))


def provider_valuation(symbols: DataFrame, overviews: DataFrame) -> DataFrame:
    """P/E that may be used, and the reason where it may not. Every requested symbol keeps a row."""
    df = symbols.select("symbol").join(overviews.withColumn("_found", F.lit(True)), "symbol", "left")
    pe, eps = lenient_number(F.col("PERatio")), lenient_number(F.col("EPS"))
    df = df.withColumns({"pe_ratio_raw": pe, "provider_eps_ttm": eps})
    pe, eps = F.col("pe_ratio_raw"), F.col("provider_eps_ttm")
    meaningful = F.coalesce((pe > 0) & (eps > 0), F.lit(False))
    reason = (
        F.when(F.col("_found").isNull(), "provider overview missing")
        .when(eps.isNull(), "provider EPS missing")
        .when(eps <= 0, "provider EPS nonpositive")
        .when(pe.isNull(), "provider P/E missing")
        .when(pe <= 0, "provider P/E nonpositive")
        .otherwise("")
    )
    return df.select(
        "symbol", "pe_ratio_raw", "provider_eps_ttm",
        F.when(meaningful, pe).alias("pe_ratio"),
        meaningful.alias("pe_is_meaningful"),
        reason.alias("pe_exclusion_reason"),
        F.lit(PE_SOURCE).alias("pe_source"),
    )


def _check_quantiles(lower: float, upper: float) -> None:
    if not 0 <= lower < upper <= 1:
        raise ValueError("winsor quantiles must satisfy 0 <= lower < upper <= 1")


def _stock_values(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    return long_features(df.where(~F.col("is_benchmark")), features, by)


def winsor_bounds(
    df: DataFrame, features: Sequence[str] = WINSOR_FEATURES, lower: float = 0.05, upper: float = 0.95, by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantile bounds per feature over the stocks, with how many values lie outside; per value of ``by`` (such as
    an as-of day) where it is given."""
    _check_quantiles(lower, upper)
    keys = [*by, "feature"]
    values = _stock_values(df, features, by)
    available = F.count("value").alias("available_stock_values")
    bounds = exact_quantiles(values, keys, "value", {"lower_bound": lower, "upper_bound": upper}, also=[available], counts=True)
    none = F.lit(0).cast("long")
    counted = bounds.select(
        *keys, "lower_bound", "upper_bound", "available_stock_values",
        F.coalesce("lower_bound_below", none).alias("lower_capped_count"),
        F.coalesce("upper_bound_above", none).alias("upper_capped_count"),
    )
    return counted.withColumns({"lower_quantile": F.lit(lower), "upper_quantile": F.lit(upper)})


def winsorize(
    df: DataFrame, features: Sequence[str] = WINSOR_FEATURES, lower: float = 0.05, upper: float = 0.95, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``<feature>_winsorized`` and ``<feature>_outlier_flag``; the raw columns stay as they are. With ``by`` each of its
    values (such as an as-of day) has bounds of its own, joined by that key."""
    _check_quantiles(lower, upper)
    bounds = exact_quantiles(_stock_values(df, features, by), [*by, "feature"], "value", {"lo": lower, "hi": upper})
    packed = F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lo", "hi")))).alias("_b")
    if by:
        df = df.join(bounds.groupBy(*by).agg(packed), list(by), "left")
    else:
        df = df.withColumn("_b", bounds.agg(packed).scalar())
    columns = {}
    for f in features:
        value, bound = F.col(f).cast("double"), F.try_element_at(F.col("_b"), F.lit(f))
        clipped = F.when(bound.isNull(), value).otherwise(clip(value, bound["lo"], bound["hi"]))
        outside = F.coalesce((value < bound["lo"]) | (value > bound["hi"]), F.lit(False))
        columns[f"{f}_winsorized"] = F.when(~F.col("is_benchmark"), clipped)
        columns[f"{f}_outlier_flag"] = ~F.col("is_benchmark") & outside
    return df.withColumns(columns).drop("_b")


def transform_features(
    master: DataFrame, valuation: DataFrame, lower: float = 0.05, upper: float = 0.95, by: Sequence[str] = ()
) -> DataFrame:
    valued = master.join(one_row_each(valuation, ["symbol"], "valuation"), "symbol", "left")
    return winsorize(valued, WINSOR_FEATURES, lower, upper, by)
