"""One row per symbol: latest rows and the joins that assemble a master table and a screener."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.constants import BETA_WINDOWS, MOMENTUM_PERIODS
from tickerloom.functions.scalars import symbol_text, technical_signal
from tickerloom.operators.cleaning import patch_benchmark_identity, with_billions, with_percent_columns
from tickerloom.operators.keys import one_row_each

FUNDAMENTAL_COLUMNS = [
    "company_name", "sic", "sic_description", "fiscal_year_end", "exchange",
    "revenue", "net_income", "assets", "liabilities", "equity", "eps_diluted",
]
GROWTH_COLUMNS = [
    "revenue_growth_yoy", "profit_margin", "latest_frame", "comparison_frame",
    "revenue_growth_available", "profit_margin_available", "unusual_margin_flag", "quality_note",
]


def _at(df: DataFrame, order: str, keys: Sequence[str], pick) -> DataFrame:
    """One aggregate per column, each carrying its order: hash aggregates, combined before the exchange. Null
    orders are never picked; a text or nested column makes Spark sort its side instead."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[pick(c, order).alias(c) for c in rest]).select(df.columns)


def latest_per_symbol(df: DataFrame, order: str = "date", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Last row of each key; ``order`` is unique in it."""
    return _at(df, order, keys, F.max_by)


def first_per_symbol(df: DataFrame, order: str = "date", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """First row of each key; ``order`` is unique in it."""
    return _at(df, order, keys, F.min_by)


def latest_beta(rolling: DataFrame, windows: Sequence[int] = BETA_WINDOWS) -> DataFrame:
    kept = [c for n in windows for c in (f"beta_{n}", f"beta_{n}_n_obs")]
    return latest_per_symbol(rolling.select("symbol", "date", *kept))


def latest_momentum(history: DataFrame, periods: Sequence[int] = MOMENTUM_PERIODS) -> DataFrame:
    kept = [c for n in periods for c in (f"momentum_{n}d", f"momentum_{n}d_n_obs")]
    return latest_per_symbol(history.select("symbol", "date", "close", *kept))


def build_master(
    technical: DataFrame,
    fundamentals: DataFrame,
    betas: DataFrame,
    momentum: DataFrame,
    growth: DataFrame,
    benchmark: str,
) -> DataFrame:
    """Left joins of one-row-per-symbol tables; a repeated symbol in any of them fails the job. The dedicated tables replace columns of the same name.

    All sides are keyed by symbol, so the chain needs each table hashed once; Spark broadcasts a side
    by itself when its measured size allows.
    """
    sides = {
        "technical": technical, "fundamentals": fundamentals, "beta": betas,
        "momentum": momentum, "growth": growth,
    }
    sides = {k: one_row_each(v.withColumn("symbol", symbol_text(F.col("symbol"))), ["symbol"], k) for k, v in sides.items()}
    columns = {
        "fundamentals": [c for c in FUNDAMENTAL_COLUMNS if c in fundamentals.columns],
        "beta": [c for c in betas.columns if c.startswith("beta_")],
        "momentum": [c for c in momentum.columns if c.startswith("momentum_")],
        "growth": GROWTH_COLUMNS,
    }
    replaced = [c for name in ("beta", "momentum", "growth") for c in columns[name]]
    master = sides["technical"].drop(*replaced).withColumn("is_benchmark", F.col("symbol") == benchmark.upper())
    for name, kept in columns.items():
        master = master.join(sides[name].select("symbol", *kept), "symbol", "left")
    return add_availability(master)


def add_availability(master: DataFrame) -> DataFrame:
    return master.withColumns(
        {
            "has_fundamentals": F.col("company_name").isNotNull(),
            "has_beta": F.col("beta_252").isNotNull(),
            "has_momentum": F.col("momentum_126d").isNotNull(),
            "has_growth": F.col("revenue_growth_yoy").isNotNull(),
        }
    )


SIGNAL_COLUMNS = [
    "momentum_21d_raw", "momentum_63d_raw", "momentum_126d_raw",
    "revenue_growth_yoy_raw", "profit_margin_raw", "pe_ratio_raw", "beta_252_raw",
    "momentum_subscore", "quality_subscore", "valuation_subscore", "composite_score",
    "score_coverage", "momentum_label", "fundamentals_label", "valuation_label",
    "overall_label", "overall_display_label",
]
_PERCENT = {
    "daily_return_pct": "simple_return", "volatility_pct": "volatility_20d_annualized",
    "drawdown_pct": "drawdown", "max_drawdown_pct": "max_drawdown_to_date",
    "momentum_21d_raw_pct": "momentum_21d_raw", "momentum_63d_raw_pct": "momentum_63d_raw",
    "momentum_126d_raw_pct": "momentum_126d_raw", "revenue_growth_yoy_raw_pct": "revenue_growth_yoy_raw",
    "profit_margin_raw_pct": "profit_margin_raw",
}


def build_screener(
    latest: DataFrame,
    identity: DataFrame,
    labels: DataFrame | None = None,
    benchmark: str = "SPY",
    benchmark_name: str = "SPDR S&P 500 ETF Trust",
    benchmark_description: str = "Benchmark ETF",
) -> DataFrame:
    """Latest technical row with identity, signal, percent and billion columns, and score labels."""
    wanted = ["symbol", "company_name", "sic_description", "revenue", "net_income", "assets", "eps_diluted"]
    df = one_row_each(latest, ["symbol"], "latest rows").join(one_row_each(identity.select(wanted), ["symbol"], "identity"), "symbol", "left")
    df = patch_benchmark_identity(df, benchmark, benchmark_name, benchmark_description)
    df = df.withColumns(
        {
            "signal": technical_signal(F.col("rsi_14"), F.col("close"), F.col("sma_50")),
            "trend_above_sma50": F.coalesce(F.col("close") > F.col("sma_50"), F.lit(False)),
        }
    )
    if labels is not None:
        kept = [c for c in SIGNAL_COLUMNS if c in labels.columns]
        df = df.join(one_row_each(labels.select("symbol", *kept), ["symbol"], "labels"), "symbol", "left")
    return with_billions(with_percent_columns(df, _PERCENT))
