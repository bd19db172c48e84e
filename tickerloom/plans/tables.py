"""The panel model read out of the star-schema test tables.

A supplier is a symbol and its shipments are its trades, so the panel grows with ``lineitem``:
bars are daily aggregates of shipments, filings are quarterly ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.constants import PRICE_COLUMNS
from tickerloom.operators.keys import keyed

BENCHMARK = "MKT"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def symbol_of(key: str) -> Column:
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 10, "0"))


#: Shipments that a task of the bars holds.
SHIPMENTS_PER_TASK = 200_000


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """One bar per supplier and shipping day. Few shipments share both, so combining them before the exchange would
    only widen rows and hold a whole split in memory: they are dealt out by both, over a number of tasks that follows the table."""
    price = F.lit(50.0) + F.col("l_extendedprice") / 1000
    shipments = table(spark, folder, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, -(-shipments.count() // SHIPMENTS_PER_TASK))
    dated = shipments.select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity")
    daily = (
        keyed(dated, tasks, ["l_suppkey", "date"])
        .groupBy("l_suppkey", "date")
        .agg(
            F.avg(price).alias("mean"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.sum(price * F.col("l_quantity")).alias("turnover"),
            F.sum("l_quantity").alias("volume"),
        )
    )

    def within(value: Column) -> Column:
        return F.least(F.greatest(value, F.col("low")), F.col("high"))

    even = F.col("l_suppkey") % 2 == 0
    df = daily.withColumns(
        {"symbol": symbol_of("l_suppkey"), "open": within(F.col("mean")), "close": within(F.col("turnover") / F.col("volume"))}
    )
    return df.withColumns(
        {
            "adjusted_close": F.when(even, F.col("close") * 0.98).otherwise(F.col("close")),
            "provider": F.when(even, "alpha_vantage").otherwise("twelve_data"),
        }
    ).select(PRICE_COLUMNS)


def market_bars(stock_bars: DataFrame) -> DataFrame:
    """Benchmark: mean over the symbols on weekdays, so weekend bars have no partner."""
    weekday = F.dayofweek("date").between(2, 6)
    return (
        stock_bars.where(weekday)
        .groupBy("date")
        .agg(
            F.avg("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.avg("close").alias("close"), F.sum("volume").alias("volume"),
        )
        .withColumns(
            {"adjusted_close": F.col("close"), "symbol": F.lit(BENCHMARK), "provider": F.lit("twelve_data")}
        )
        .select(PRICE_COLUMNS)
    )


def panel(spark: SparkSession, folder: str) -> DataFrame:
    b = bars(spark, folder)
    return b.unionByName(market_bars(b))


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").withColumn("symbol", symbol_of("s_suppkey"))


def _quarters(spark: SparkSession, folder: str) -> DataFrame:
    start = F.date_trunc("quarter", "l_shipdate").cast("date")
    amount = F.col("l_extendedprice")
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", start.alias("period_start"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(amount).alias("ext"),
            F.sum(amount * (1 - F.col("l_discount"))).alias("rev"),
            F.sum("l_quantity").alias("qty"),
        )
        .select(
            symbol_of("l_suppkey").alias("symbol"),
            "period_start",
            F.date_sub(F.add_months("period_start", 3), 1).alias("period_end"),
            F.year("period_start").alias("year"),
            F.quarter("period_start").alias("quarter"),
            "n", "ext", "rev",
            # Cost ratio follows the average lot size, so margins vary and a few look unusual.
            (F.col("rev") - F.col("ext") * ((F.col("qty") / F.col("n") - 15) / 20)).alias("income"),
        )
    )


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Flat facts per supplier: standalone quarters, restatements, balance sheets, year-to-date rows. Shipments are read
    and combined once; the year to date is a running sum over the four quarters of a year. A quarter's texts are put
    together once, below that window, not once for every fact of the quarter."""
    so_far = W.partitionBy("symbol", "year").orderBy("quarter").rowsBetween(W.unboundedPreceding, 0)
    n, quarter = F.col("n"), F.col("quarter")

    def digits(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("null"))

    named = {
        "form": F.when(quarter == 4, "10-K").otherwise("10-Q"),
        "filed": F.date_add("period_end", 45),
        "frame": F.concat(F.lit("CY"), digits("year"), F.lit("Q"), digits("quarter")),
    }
    q = _quarters(spark, folder).withColumns(named).withColumn("ytd", F.sum("rev").over(so_far))
    form, filed, frame = F.col("form"), F.col("filed"), F.col("frame")

    def item(when: Column, tag: str, unit: str, val: Column, seq: int, instant: bool = False, late: bool = False) -> Column:
        row = F.struct(
            F.lit(tag).alias("tag"), F.lit(unit).alias("unit"), val.alias("val"),
            F.when(F.lit(not instant), F.col("period_start")).alias("period_start"),
            (F.add_months(filed, 12) if late else filed).alias("filed"),
            (F.lit("10-K") if late else form).alias("form"),
            (F.concat(frame, F.lit("I")) if instant else frame).alias("frame"),
            F.lit(seq).alias("seq"),
        )
        return F.when(when, row)

    # Year-to-date rows carry no frame and must never be taken for a quarter.
    year_to_date = F.when(
        quarter > 1,
        F.struct(
            F.lit("Revenues").alias("tag"), F.lit("USD").alias("unit"), F.col("ytd").alias("val"),
            F.make_date("year", F.lit(1), F.lit(1)).alias("period_start"),
            filed.alias("filed"), form.alias("form"), F.lit(None).cast("string").alias("frame"), F.lit(2).alias("seq"),
        ),
    )
    items = F.array_compact(
        F.array(
            item(n >= 12, "Revenues", "USD", F.col("rev"), 0),
            item(n >= 25, "Revenues", "USD", F.col("rev") * 1.01, 1, late=True),
            item((n < 12) | (n >= 20), "SalesRevenueNet", "USD", F.col("rev") * 0.9, 0),
            item(n >= 15, "NetIncomeLoss", "USD", F.col("income"), 0),
            item(n >= 1, "Assets", "USD", F.col("ext") * 3, 0, instant=True),
            item(n >= 15, "StockholdersEquity", "USD", F.col("ext") * 1.2, 0, instant=True),
            item(n >= 22, "Liabilities", "USD", F.col("ext") * 1.8, 0, instant=True),
            item(n >= 10, "EarningsPerShareDiluted", "USD/shares", F.col("income") / 100000, 0),
            year_to_date,
        )
    )
    order = ["symbol", "tag", "unit", "val", "period_start", "period_end", "filed", "form", "frame", "seq"]
    return q.select("symbol", "period_end", F.inline(items)).select(order)


def fact_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``symbol, document``: the same facts as nested filing documents. Values per tag are bounded by
    the quarters of the calendar."""
    f = facts(spark, folder)
    item = F.struct(
        F.col("seq"), F.col("val"),
        F.date_format("period_start", "yyyy-MM-dd").alias("start"), F.date_format("period_end", "yyyy-MM-dd").alias("end"),
        F.date_format("filed", "yyyy-MM-dd").alias("filed"), "form", "frame",
    )
    per_unit = f.groupBy("symbol", "tag", "unit").agg(F.array_sort(F.collect_list(item)).alias("items"))
    per_tag = per_unit.groupBy("symbol", "tag").agg(F.map_from_entries(F.collect_list(F.struct("unit", "items"))).alias("units"))
    per_symbol = per_tag.groupBy("symbol").agg(
        F.map_from_entries(F.collect_list(F.struct("tag", F.struct("units")))).alias("gaap")
    )
    doc = F.struct(F.col("symbol").alias("entityName"), F.create_map(F.lit("us-gaap"), F.col("gaap")).alias("facts"))
    return per_symbol.select("symbol", F.to_json(doc).alias("document"))


def identity(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    s = suppliers(spark, folder).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(
        "symbol",
        F.col("s_name").alias("company_name"),
        F.col("s_nationkey").cast("string").alias("sic"),
        F.col("n_name").alias("sic_description"),
        F.lit("1231").alias("fiscal_year_end"),
        F.concat(F.lit("X"), F.col("n_regionkey").cast("string")).alias("exchange"),
    )


def overviews(spark: SparkSession, folder: str) -> DataFrame:
    """Provider overview fields as text, with the placeholder words providers use for "missing"."""
    key = F.col("s_nationkey")
    word = F.when(key == 0, "None").when(key == 1, "-").when(key == 2, "N/A").when(key == 3, "")
    eps = F.col("s_acctbal") / 1000
    return suppliers(spark, folder).select(
        "symbol",
        F.coalesce(word, (F.col("s_acctbal") / 250 + key - 4).cast("string")).alias("PERatio"),
        F.when(key == 4, "None").otherwise(eps.cast("string")).alias("EPS"),
        F.when(key == 5, "-").otherwise((key / F.lit(10.0)).cast("string")).alias("Beta"),
    )
