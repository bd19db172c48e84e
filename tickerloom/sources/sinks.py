"""Writers: stage tables, CSV tables, JSON reports and the dashboard documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators.order_stats import with_position


def write_panel(df: DataFrame, path: str) -> None:
    """Parquet by calendar year: a date filter reads the years it needs only."""
    df.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("year")


def write_bucketed(df: DataFrame, table: str, buckets: int, path: str) -> DataFrame:
    """Table of the catalog below ``path``, bucketed and sorted by symbol, with one file a bucket; read back, per-symbol
    windows and joins need no exchange. The buckets are the tasks that later work on it: take as many as a cluster has
    use for, since a bucket is the least unit of work."""
    spread = df.repartition(buckets, "symbol").sortWithinPartitions("symbol", "date")
    spread.write.mode("overwrite").option("path", path).bucketBy(buckets, "symbol").sortBy("symbol", "date").saveAsTable(table)
    return df.sparkSession.table(table)


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """Table with a header; missing values are empty cells."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').option(
        "nullValue", ""
    ).option("emptyValue", "").csv(path)


def ranked_screen(df: DataFrame, columns: Sequence[str], sort_by: str, ascending: bool = False) -> DataFrame:
    """Chosen columns with ``rank``, the row's place in the sorted screen (missing last, then symbol)."""
    key = F.col(sort_by) if ascending else -F.col(sort_by)
    placed = with_position(df.withColumn("_key", F.coalesce(key, F.lit(float("inf")))), [], ["_key", "symbol"])
    return placed.select((F.col("position") + 1).alias("rank"), *[c for c in columns if c != "rank"])


def report_json(report: DataFrame) -> DataFrame:
    """Each row of a report as one JSON object, missing values written as null."""
    fields = F.struct(*[F.col(c) for c in report.columns])
    return report.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    report_json(report).write.mode("overwrite").text(path)


def _json_scalar(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    if kind == "date":
        return F.date_format(column, "yyyy-MM-dd").alias(column)
    return F.col(column)


STOCK_FIELDS = [
    "symbol", "company_name", "sic_description", "date", "adjusted_close", "daily_return_pct",
    "rsi_14", "volatility_pct", "max_drawdown_pct", "momentum_21d_raw_pct", "momentum_63d_raw_pct",
    "momentum_126d_raw_pct", "profit_margin_raw_pct",
    "revenue_growth_yoy_raw_pct", "pe_ratio_raw", "beta_252_raw", "momentum_subscore",
    "quality_subscore", "valuation_subscore", "composite_score", "score_coverage",
    "momentum_label", "fundamentals_label", "valuation_label", "overall_label",
    "overall_display_label", "signal", "trend_above_sma50",
]
HISTORY_FIELDS = ["date", "adjusted_close", "sma_20", "sma_50", "rsi_14", "volatility_20d_annualized", "drawdown"]


def dashboard_documents(screener: DataFrame, history: DataFrame) -> DataFrame:
    """``symbol, stock, history``: one JSON object and one JSON array of daily rows per symbol.

    A history holds one entry per calendar day; no document spans symbols, so the export has no
    single row that grows with the universe.
    """
    stock_fields = [c for c in STOCK_FIELDS if c in screener.columns]
    null_kept = {"ignoreNullFields": "false"}
    stock = screener.select(
        "symbol",
        F.to_json(F.struct(*[_json_scalar(screener, c) for c in stock_fields]), null_kept).alias("stock"),
    )
    day = F.struct(*[_json_scalar(history, c) for c in HISTORY_FIELDS])
    # The ISO date leads the struct, so sorting the array sorts by day.
    days = history.groupBy("symbol").agg(F.array_sort(F.collect_list(day)).alias("h"))
    days = days.select("symbol", F.to_json("h", null_kept).alias("history"))
    return stock.join(days, "symbol", "full_outer")


def dashboard_meta(screener: DataFrame, benchmark: str) -> DataFrame:
    return screener.agg(F.date_format(F.max("date"), "yyyy-MM-dd").alias("latest_market_date")).withColumns(
        {
            "price_basis": F.lit("adjusted_close"),
            "benchmark": F.lit(benchmark),
            "missing_policy": F.lit(
                "No imputation; filtered metrics require a real value; comparisons use common dates."
            ),
        }
    )
