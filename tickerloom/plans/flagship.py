"""The whole chain as one report: bars and filings in, ranked and explained symbols out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.operators import screening
from tickerloom.plans import chains
from tickerloom.plans.tables import BENCHMARK


def screener_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every symbol with usable indicators, best composite score first."""
    shown = screening.screen(
        chains.screener(spark, folder), max_volatility=1e9, include_benchmark=False,
        sort_by="composite_score", benchmark=BENCHMARK,
    )
    return shown.select(
        "symbol", "company_name", "date", "close", "signal", "rsi_14", "volatility_pct", "momentum_63d_raw_pct",
        "profit_margin_raw_pct", "pe_ratio_raw", "beta_252_raw", "composite_score", "score_coverage",
        "overall_display_label",
    )
