"""Typing, validation and price basis of landed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.constants import (
    DISPLAY_NAMES,
    FACT_METRICS,
    OHLC,
    PRICE_ADJUSTMENT,
    PRICE_COLUMNS,
    RAW_CLOSE_PROVIDER,
)
from tickerloom.functions.scalars import finite, half_even_long, lenient_date, symbol_text
from tickerloom.operators.keys import DataQualityError, assert_positive, assert_unique, require_columns

ISSUES = [
    "missing_date", "missing_symbol", "duplicate_symbol_date", "missing_ohlcv_cells",
    "missing_adjusted_close", "nonpositive_adjusted_close_rows", "nonpositive_price_rows",
    "negative_volume_rows", "high_below_ohlc_rows", "low_above_ohlc_rows",
]


def _as_number(df: DataFrame, column: str) -> Column:
    is_text = dict(df.dtypes)[column] == "string"
    return finite(F.trim(F.col(column)).try_cast("double") if is_text else F.col(column))


def _as_date(df: DataFrame, column: str) -> Column:
    return lenient_date(F.col(column)) if dict(df.dtypes)[column] == "string" else F.to_date(column)


def type_prices(raw: DataFrame) -> DataFrame:
    """Days, trimmed upper-case symbols, lower-case providers and numbers; what cannot be read is null."""
    require_columns(raw, PRICE_COLUMNS, "prices")
    return raw.withColumns(
        {
            "date": _as_date(raw, "date"),
            "symbol": symbol_text(F.col("symbol")),
            "provider": F.lower(F.trim("provider")),
            **{c: _as_number(raw, c) for c in [*OHLC, "adjusted_close", "volume"]},
        }
    )


def price_issues(typed: DataFrame) -> DataFrame:
    """One row with ten counters. Rows of a repeated key are combined before the shuffle."""
    prices = [F.col(c) for c in OHLC]
    cells = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in [*OHLC, "volume"]), F.lit(0))

    def tally(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    not_positive = F.lit(False)
    for p in prices:
        not_positive = not_positive | F.coalesce(p <= 0, F.lit(False))
    per_key = typed.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(cells).alias("cells"),
        tally(F.col("adjusted_close").isNull()).alias("no_adj"),
        tally(F.col("adjusted_close") <= 0).alias("bad_adj"),
        tally(not_positive).alias("bad_price"),
        tally(F.col("volume") < 0).alias("bad_volume"),
        tally(F.col("high") < F.greatest(*prices)).alias("bad_high"),
        tally(F.col("low") > F.least(*prices)).alias("bad_low"),
    )

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("long")

    n = F.col("n")
    return per_key.agg(
        total(F.when(F.col("date").isNull(), n)).alias("missing_date"),
        total(F.when(F.col("symbol").isNull() | (F.col("symbol") == ""), n)).alias("missing_symbol"),
        total(n - 1).alias("duplicate_symbol_date"),
        total(F.col("cells")).alias("missing_ohlcv_cells"),
        total(F.col("no_adj")).alias("missing_adjusted_close"),
        total(F.col("bad_adj")).alias("nonpositive_adjusted_close_rows"),
        total(F.col("bad_price")).alias("nonpositive_price_rows"),
        total(F.col("bad_volume")).alias("negative_volume_rows"),
        total(F.col("bad_high")).alias("high_below_ohlc_rows"),
        total(F.col("bad_low")).alias("low_above_ohlc_rows"),
    )


def assert_clean_prices(typed: DataFrame) -> None:
    """Fail the whole batch if any counter is not zero; nothing is dropped or repaired."""
    found = price_issues(typed).first().asDict()
    broken = [f"{name}={found[name]}" for name in ISSUES if found[name]]
    if broken:
        raise DataQualityError("price validation failed: " + ", ".join(broken))


def clean_prices(raw: DataFrame, validate: bool = True) -> DataFrame:
    typed = type_prices(raw)
    if validate:
        assert_clean_prices(typed)
    return typed.withColumns(
        {"volume": half_even_long(F.col("volume")), "price_adjustment": F.lit(PRICE_ADJUSTMENT)}
    )


def clean_fundamentals(raw: DataFrame, validate: bool = True) -> DataFrame:
    """Typed snapshot; liabilities derived from the same period's balance sheet where not reported."""
    require_columns(raw, ["symbol", "assets", "liabilities", "equity"], "fundamentals")
    typed = raw.withColumn("symbol", symbol_text(F.col("symbol")))
    if validate:
        assert_unique(typed, ["symbol"], "fundamentals")
    columns: dict[str, Column] = {}
    for metric in FACT_METRICS:
        columns[metric] = _as_number(raw, metric)
        for suffix in ("period_end", "filed"):
            if f"{metric}_{suffix}" in raw.columns:
                columns[f"{metric}_{suffix}"] = _as_date(raw, f"{metric}_{suffix}")
    typed = typed.withColumns(columns)
    derivable = (
        F.col("liabilities").isNull()
        & F.col("assets").isNotNull()
        & F.col("equity").isNotNull()
        & F.coalesce(F.col("assets_period_end") == F.col("equity_period_end"), F.lit(False))
    )
    derived = {
        "liabilities": F.col("assets") - F.col("equity"),
        "liabilities_period_end": F.col("assets_period_end"),
        "liabilities_filed": F.greatest("assets_filed", "equity_filed"),
        "liabilities_form": F.lit("DERIVED"),
        "liabilities_tag": F.lit("derived: Assets - StockholdersEquity"),
    }
    df = typed.withColumn("_derive", derivable).withColumns(
        {c: F.when(F.col("_derive"), e).otherwise(F.col(c)) for c, e in derived.items()}
    )
    return df.withColumns({f"{m}_is_missing": F.col(m).isNull() for m in FACT_METRICS}).drop("_derive")


def fundamentals_report(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Counts of the cleaning step; one row."""
    before = raw.agg(F.count_if(F.col("liabilities").isNull()).alias("liabilities_missing_before"))
    negative = F.lit(False)
    for c in ("assets", "liabilities", "equity"):
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
    after = clean.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("symbol").alias("symbols"),
        F.count_if(F.col("liabilities_form") == "DERIVED").alias("liabilities_derived"),
        F.count_if(negative).alias("negative_balance_rows"),
        *[F.count_if(F.col(m).isNull()).alias(f"{m}_missing_after") for m in FACT_METRICS],
    )
    return after.withColumn("liabilities_missing_before", before.scalar())


def adjusted_price_basis(prices: DataFrame, validate: bool = True) -> DataFrame:
    """``close`` becomes the adjusted close; the raw close survives only where a provider states it."""
    if "adjusted_close" not in prices.columns:
        raise ValueError("adjusted_close is required; land prices with full adjustment")
    if validate:
        assert_positive(prices, "adjusted_close", "price basis", allow_null=False)
    kept = F.col("unadjusted_close").cast("double") if "unadjusted_close" in prices.columns else F.lit(None).cast("double")
    provider = F.lower("provider") if "provider" in prices.columns else F.lit("")
    return prices.withColumn(
        "unadjusted_close", F.when(provider == RAW_CLOSE_PROVIDER, F.col("close")).otherwise(kept)
    ).withColumn("close", F.col("adjusted_close").cast("double"))


def with_percent_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``new name -> source`` columns scaled by 100; sources that are absent are skipped."""
    return df.withColumns({new: F.col(old) * 100 for new, old in names.items() if old in df.columns})


def with_billions(df: DataFrame, columns: Sequence[str] = ("revenue", "net_income", "assets")) -> DataFrame:
    return df.withColumns({f"{c}_billions": F.col(c) / F.lit(1e9) for c in columns if c in df.columns})


def display_table(df: DataFrame, columns: Sequence[str], names: dict[str, str] | None = None) -> DataFrame:
    """Chosen columns under their display names; columns the frame lacks are left out."""
    names = names or DISPLAY_NAMES
    return df.select([F.col(c).alias(names.get(c, c)) for c in columns if c in df.columns])


def patch_benchmark_identity(df: DataFrame, benchmark: str, name: str, description: str) -> DataFrame:
    is_benchmark = F.col("symbol") == benchmark
    return df.withColumns(
        {
            "company_name": F.when(is_benchmark, F.lit(name)).otherwise(F.col("company_name")),
            "sic_description": F.when(is_benchmark, F.lit(description)).otherwise(F.col("sic_description")),
        }
    )
