"""One registered query per operator, each over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.constants import (
    BETA_WINDOWS,
    CORRELATION_FEATURES,
    DEFAULT_DISPLAY,
    DISTRIBUTION_FEATURES,
    FACT_METRICS,
    INCOME_TAGS,
    PRICE_COLUMNS,
    REVENUE_TAGS,
    SCREEN_FIELDS,
    TIMEFRAME_DAYS,
    WINSOR_FEATURES,
)
from tickerloom.functions import scalars
from tickerloom.operators import (
    audit,
    cleaning,
    explain,
    filings,
    indicators,
    keys,
    market,
    portfolio,
    research,
    scoring,
    screening,
    snapshot,
    statistics,
    transform,
)
from tickerloom.operators.recurrence import linear_recurrence
from tickerloom.plans import chains, tables
from tickerloom.plans.tables import BENCHMARK
from tickerloom.sources import catalog, filings as filing_sources, prices, sinks
from tickerloom.stage import shared_folder, stage
from tickerloom.streaming.landing import land_new_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return register


def rounded(df: DataFrame, digits: int = 8, **special: int) -> DataFrame:
    """Doubles rounded for comparison.

    A fixed small part of the last digit is added first, as sums that lie exactly between two digits
    differ in their last bit by engine; adding zero afterwards turns a negative zero into zero.
    """

    def shown(name: str) -> Column:
        d = special.get(name, digits)
        return (F.round(F.col(f"`{name}`") + F.lit(float(f"1.37e-{d + 1}")), d) + F.lit(0.0)).alias(name)

    return df.select([shown(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def pick(df: DataFrame, *columns: str) -> DataFrame:
    return rounded(df.select(*columns))


def json_list(column: str) -> Column:
    return F.array_join(column, " | ")


def scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- sources and sinks -------------------------------------------------------------------------


@query("src_01_price_files")
def _(spark, d):
    path = scratch(spark, "price-files")
    sinks.write_csv(chains.panel(spark, d), path)
    return rounded(prices.read_price_files(spark, path))


@query("src_02_fundamental_csv")
def _(spark, d):
    path = scratch(spark, "fundamentals-csv")
    raw = chains.fundamentals(spark, d).withColumn(
        "equity_filed", F.coalesce(F.col("equity_filed").cast("string"), F.lit("not a date"))
    )
    sinks.write_csv(raw, path)
    df = prices.read_fundamental_csv(spark, path, list(FACT_METRICS))
    return rounded(df.select("symbol", "revenue", "revenue_period_end", "equity", "equity_filed", "revenue_form"), 4)


def _provider_payloads(spark, d) -> tuple[DataFrame, DataFrame]:
    b = tables.bars(spark, d)
    text = {c: F.col(c).cast("string") for c in ["open", "high", "low", "close", "adjusted_close", "volume"]}
    numbered = F.create_map(
        F.lit("1. open"), text["open"], F.lit("2. high"), text["high"], F.lit("3. low"), text["low"],
        F.lit("4. close"), text["close"], F.lit("5. Adjusted Close"), text["adjusted_close"], F.lit("6. volume"), text["volume"],
    )
    day = F.date_format("date", "yyyy-MM-dd")
    # A payload is one symbol's daily history: at most one entry per calendar day.
    maps = b.where("provider = 'alpha_vantage'").groupBy("symbol").agg(
        F.map_from_entries(F.collect_list(F.struct(day, numbered))).alias("m")
    )
    maps = maps.select("symbol", F.to_json(F.struct(F.col("m").alias("Time Series (Daily)"))).alias("payload"))
    row = F.struct(
        day.alias("datetime"), text["open"].alias("open"), text["high"].alias("high"), text["low"].alias("low"),
        text["close"].alias("close"), text["volume"].alias("volume"),
    )
    lists = b.where("provider = 'twelve_data'").groupBy("symbol").agg(F.collect_list(row).alias("values"))
    lists = lists.select("symbol", F.to_json(F.struct("values")).alias("payload"))
    return maps, lists


@query("src_03_provider_bars")
def _(spark, d):
    maps, lists = _provider_payloads(spark, d)
    return rounded(prices.bars_from_date_maps(maps).unionByName(prices.bars_from_value_lists(lists)))


@query("src_04_company_facts")
def _(spark, d):
    flat = filing_sources.flatten_company_facts(tables.fact_documents(spark, d))
    return rounded(flat.select("symbol", "tag", "unit", "val", "period_start", "period_end", "filed", "form", "frame"), 4)


@query("src_05_company_identity")
def _(spark, d):
    i = tables.identity(spark, d)
    blank = F.when(F.col("sic") == "7", "").otherwise(F.col("company_name"))
    sub = F.struct(
        blank.alias("name"), "sic", F.col("sic_description").alias("sicDescription"),
        F.col("fiscal_year_end").alias("fiscalYearEnd"),
        F.when(F.col("sic") != "3", F.array("exchange")).otherwise(F.array().cast("array<string>")).alias("exchanges"),
    )
    docs = i.select(
        "symbol", F.to_json(sub).alias("submissions"),
        F.to_json(F.struct(F.col("symbol").alias("entityName"))).alias("facts"),
    )
    return filing_sources.company_identity(docs)


@query("src_06_ticker_cik")
def _(spark, d):
    s = tables.suppliers(spark, d)
    entry = F.struct(F.lower("symbol").alias("ticker"), F.concat(F.lit("CIK"), F.col("s_suppkey").cast("string")).alias("cik_str"))
    # Pages of a fixed size, as a provider has them: their number grows with the list, their size does not.
    docs = s.groupBy(F.floor(F.col("s_suppkey") / 1000).alias("page")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), entry))).alias("m")
    )
    return filing_sources.ticker_cik_map(docs.select(F.to_json("m").alias("payload")))


@query("src_07_overviews")
def _(spark, d):
    docs = tables.overviews(spark, d).select("symbol", F.to_json(F.struct("PERatio", "EPS", "Beta")).alias("document"))
    df = filing_sources.parse_overviews(docs)
    num = {c: scalars.lenient_number(F.col(c)) for c in ("PERatio", "EPS", "Beta")}
    return rounded(df.select("symbol", num["PERatio"].alias("pe"), num["EPS"].alias("eps"), num["Beta"].alias("beta")))


@query("src_07_overview_files")
def _(spark, d):
    """One file per symbol, read back from the folder."""
    path = scratch(spark, "overviews")
    docs = tables.overviews(spark, d).select("symbol", F.to_json(F.struct("PERatio", "EPS", "Beta")).alias("document"))
    docs.repartition("symbol").write.partitionBy("symbol").text(path)
    df = filing_sources.read_overviews(spark, path, ".txt")
    num = {c: scalars.lenient_number(F.col(c)) for c in ("PERatio", "EPS", "Beta")}
    return rounded(df.select("symbol", num["PERatio"].alias("pe"), num["EPS"].alias("eps"), num["Beta"].alias("beta")))


@query("src_08_parquet_stage")
def _(spark, d):
    path = scratch(spark, "panel")
    sinks.write_panel(tables.panel(spark, d), path)
    return rounded(sinks.read_panel(spark, path))


@query("src_08_bucketed_panel")
def _(spark, d):
    """Indicators over a bucketed table: no exchange."""
    import uuid

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = sinks.write_bucketed(chains.basis(spark, d), f"panel_{uuid.uuid4().hex}", buckets, scratch(spark, "bucketed"))
    df = indicators.add_risk(indicators.add_simple_averages(table))
    return pick(df, "symbol", "date", "sma_20", "sma_50", "volatility_20d_annualized", "drawdown")


@query("src_09_screen_csv")
def _(spark, d):
    path = scratch(spark, "screen-csv")
    shown = sinks.ranked_screen(
        chains.screener(spark, d).where(F.col("symbol") != BENCHMARK), ["symbol", "company_name", "composite_score", "rsi_14"], "composite_score"
    )
    sinks.write_csv(shown, path, quote_all=True)
    back = spark.read.schema("rank long, symbol string, company_name string, composite_score double, rsi_14 double").csv(path, header=True)
    return rounded(back)


@query("src_10_report_json")
def _(spark, d):
    path = scratch(spark, "report")
    report = statistics.feature_report(chains.features(spark, d), ["sma_20", "rsi_14"])
    sinks.write_report(report, path)
    parsed = spark.read.schema("rows long, symbols long, sma_20_non_null long, rsi_14_non_null long").json(path)
    return parsed


@query("src_11_dashboard_export")
def _(spark, d):
    docs = sinks.dashboard_documents(chains.screener(spark, d), chains.features(spark, d))
    day = "array<struct<date: string, adjusted_close: double, sma_50: double, drawdown: double>>"
    stock = "struct<company_name: string, composite_score: double>"
    parsed = docs.select("symbol", F.from_json("stock", stock).alias("s"), F.explode(F.from_json("history", day)).alias("h"))
    return rounded(
        parsed.select("symbol", "s.company_name", "s.composite_score", "h.date", "h.adjusted_close", "h.sma_50", "h.drawdown")
    )


def _typed(row, fields: Sequence[str], texts: Sequence[str], flags: Sequence[str] = ()) -> str:
    kinds = {c: "string" if c in texts else "boolean" if c in flags else "double" for c in fields}
    return "struct<" + ", ".join(f"{c}: {k}" for c, k in kinds.items()) + ">"


_STOCK_TEXTS = [
    "symbol", "company_name", "sic_description", "date", "momentum_label", "fundamentals_label", "valuation_label", "overall_label",
    "overall_display_label", "signal",
]


@query("src_11_dashboard_stocks")
def _(spark, d):
    """Every field of the stock objects."""
    docs = sinks.dashboard_documents(chains.screener(spark, d), chains.features(spark, d))
    kind = _typed(None, sinks.STOCK_FIELDS, _STOCK_TEXTS, ["trend_above_sma50"])
    return rounded(docs.select(F.from_json("stock", kind).alias("s")).select("s.*"))


@query("src_11_dashboard_history")
def _(spark, d):
    """Every field of the daily histories."""
    docs = sinks.dashboard_documents(chains.screener(spark, d), chains.features(spark, d))
    kind = f"array<{_typed(None, sinks.HISTORY_FIELDS, ['date'])}>"
    return rounded(docs.select("symbol", F.explode(F.from_json("history", kind)).alias("h")).select("symbol", "h.*"), 6)


@query("src_11_dashboard_meta")
def _(spark, d):
    return sinks.dashboard_meta(chains.screener(spark, d), BENCHMARK)


@query("src_12_catalog_entry")
def _(spark, d):
    return catalog.catalog_entry(tables.panel(spark, d))


@query("src_12_catalog_symbols")
def _(spark, d):
    return catalog.catalog_symbols(tables.panel(spark, d))


@query("src_13_raw_inventory")
def _(spark, d):
    files = catalog.raw_inventory(spark, d, "*.parquet")
    return files.withColumn("path", F.element_at(F.split("path", "/"), -1))


@query("src_14_landing_manifest")
def _(spark, d):
    wanted = chains.stock_symbols(spark, d).unionByName(
        tables.table(spark, d, "nation").select(F.col("n_name").alias("symbol"))
    )
    return catalog.landing_manifest(wanted, tables.bars(spark, d))


@query("src_14_file_manifest")
def _(spark, d):
    """A folder with a file per symbol, among them an empty one, one without a column and one with text for numbers."""
    path = scratch(spark, "files")
    bars = chains.bars(spark, d)
    bars.withColumn("file", F.col("symbol")).repartition("file").write.option("header", True).partitionBy("file").csv(path)
    market = tables.market_bars(bars).select([F.col(c).cast("string").alias(c) for c in PRICE_COLUMNS])
    odd = F.when(F.dayofmonth(F.col("date").cast("date")) == 13, "n/a").otherwise(F.col("close"))
    market.withColumn("close", odd).repartition(1).write.option("header", True).csv(f"{path}/file=TEXT")
    market.drop("adjusted_close").repartition(1).write.option("header", True).csv(f"{path}/file=COLUMN")
    jvm = spark.sparkContext._jvm
    empty = jvm.org.apache.hadoop.fs.Path(f"{path}/file=NOTHING/nothing.csv")
    empty.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(empty).close()
    name = F.regexp_extract("path", "file=([^/]+)", 1)
    return catalog.file_manifest(spark, path).select(
        name.alias("file"), "success", "rows", "failed_rows", "first_date", "last_date", "note"
    )


@query("src_15_incremental_landing")
def _(spark, d):
    source, target, log = scratch(spark, "arrivals"), scratch(spark, "landed"), scratch(spark, "landing-log")
    panel = tables.panel(spark, d)
    sinks.write_csv(panel.where("date < date'1999-01-01'"), source)
    land_new_files(spark, source, target, log, PRICE_COLUMNS)
    panel.where("date >= date'1999-01-01'").write.mode("append").option("header", True).csv(source)
    return rounded(land_new_files(spark, source, target, log, PRICE_COLUMNS))


@query("src_15_still_to_land")
def _(spark, d):
    wanted = chains.stock_symbols(spark, d).unionByName(
        tables.table(spark, d, "nation").select(F.col("n_name").alias("symbol"))
    )
    manifest = catalog.landing_manifest(wanted, tables.bars(spark, d))
    first = catalog.request_start(F.to_date(F.lit("2001-12-31")), 2)
    return catalog.not_yet_landed(wanted, manifest).withColumn("window_start", first)


@query("src_16_universe")
def _(spark, d):
    return catalog.universe_of(tables.panel(spark, d), BENCHMARK)


# ---- projections, validation, cleaning ---------------------------------------------------------


def _untidy(spark, d) -> DataFrame:
    """The panel as it lands: padded lower-case symbols, numbers and days as text."""
    p = tables.panel(spark, d)
    return p.withColumns(
        {
            "symbol": F.concat(F.lit("  "), F.lower("symbol"), F.lit(" ")),
            "provider": F.concat(F.upper("provider"), F.lit(" ")),
            "date": F.concat(F.col("date").cast("string"), F.lit(" ")),
            "volume": (F.col("volume") + 0.5).cast("string"),
        }
    )


@query("prj_01_clean_prices")
def _(spark, d):
    return rounded(cleaning.clean_prices(_untidy(spark, d), validate=False))


def _faulty(spark, d) -> DataFrame:
    """Raw shipments taken for bars: repeated days, and faults planted where the data says so."""
    li = tables.table(spark, d, "lineitem")
    price = F.col("l_extendedprice") / 1000
    q = F.col("l_quantity")
    return li.select(
        F.when(q == 7, None).otherwise(F.to_date("l_shipdate")).alias("date"),
        F.when(q == 3, "  ").when(q == 4, None).otherwise(tables.symbol_of("l_suppkey")).alias("symbol"),
        (price - F.when(q == 11, 60).otherwise(0)).alias("open"),
        F.when(q == 13, price * 0.5).otherwise(price * 1.1).alias("high"),
        F.when(q == 17, price * 2).otherwise(price * 0.9).alias("low"),
        F.when(q == 19, None).otherwise(price).alias("close"),
        F.when(q == 23, None).when(q == 29, -price).otherwise(price).alias("adjusted_close"),
        F.when(q == 31, -q).when(q == 37, None).otherwise(q).alias("volume"),
        F.lit("twelve_data").alias("provider"),
    )


@query("prj_02_price_issues")
def _(spark, d):
    return cleaning.price_issues(cleaning.type_prices(_faulty(spark, d)))


def _raw_fundamentals(spark, d) -> DataFrame:
    return filings.fundamentals_snapshot(tables.facts(spark, d), as_of="1999-06-30")


@query("prj_03_clean_fundamentals")
def _(spark, d):
    df = cleaning.clean_fundamentals(_unreported(spark, d), validate=False)
    return rounded(
        df.select(
            "symbol", "assets", "liabilities", "equity", "liabilities_period_end", "liabilities_filed",
            "liabilities_form", "liabilities_tag", "liabilities_is_missing", "revenue_is_missing",
        ),
        4,
    )


def _unreported(spark, d) -> DataFrame:
    """Liabilities older than the assets count as not reported."""
    raw = _raw_fundamentals(spark, d)
    stale = ~F.col("liabilities_period_end").eqNullSafe(F.col("assets_period_end"))
    return raw.withColumn("liabilities", F.when(~stale, F.col("liabilities")))


@query("prj_03_fundamentals_report")
def _(spark, d):
    raw = _unreported(spark, d)
    return cleaning.fundamentals_report(raw, cleaning.clean_fundamentals(raw, validate=False))


@query("prj_04_adjusted_basis")
def _(spark, d):
    return pick(chains.basis(spark, d), "symbol", "date", "close", "unadjusted_close", "adjusted_close")


@query("prj_05_percent_columns")
def _(spark, d):
    return pick(
        chains.screener(spark, d), "symbol", "daily_return_pct", "volatility_pct", "drawdown_pct", "max_drawdown_pct",
        "momentum_63d_raw_pct", "profit_margin_raw_pct", "revenue_billions", "net_income_billions", "assets_billions",
    )


@query("prj_06_display_table")
def _(spark, d):
    shown = cleaning.display_table(chains.screener(spark, d), DEFAULT_DISPLAY)
    return rounded(shown)


@query("prj_07_benchmark_identity")
def _(spark, d):
    return chains.screener(spark, d).select("symbol", "company_name", "sic_description")


@query("prj_08_availability")
def _(spark, d):
    return chains.master(spark, d).select("symbol", "has_fundamentals", "has_beta", "has_momentum", "has_growth")


@query("qc_02_verify_returns")
def _(spark, d):
    return market.return_mismatches(market.extract_benchmark(chains.features(spark, d), BENCHMARK))


@query("qc_03_independent_recompute")
def _(spark, d):
    return audit.independent_recompute(chains.features(spark, d)).groupBy("indicator").agg(
        F.count(F.lit(1)).alias("symbols"), F.count_if("passed").alias("passed")
    )


@query("qc_04_prefix_invariance")
def _(spark, d):
    bars = chains.features(spark, d).select("symbol", "date", "close")
    cut = bars.where("date <= date'1999-06-30'")
    columns = [*audit.INDICATORS, "momentum_21d", "momentum_63d", "momentum_126d"]
    return audit.prefix_invariance(indicators.add_all(bars), indicators.add_all(cut), columns)


# ---- filters -----------------------------------------------------------------------------------

_SHOWN = ["symbol", "rsi_14", "volatility_pct", "composite_score", "overall_label"]


@query("flt_01_screen")
def _(spark, d):
    df = screening.screen(
        chains.screener(spark, d), search="supplier#", rsi_range=(45, 60), max_volatility=900, trend="Above SMA 50",
        include_benchmark=False, numeric_filters={"momentum_63d_raw_pct": (">=", -40.0), "pe_ratio_raw": ("<=", 45.0)},
        labels=["Strong", "Positive", "Neutral"], sort_by="composite_score", benchmark=BENCHMARK,
    )
    return pick(df, *_SHOWN)


@query("flt_01a_text_search")
def _(spark, d):
    return chains.screener(spark, d).where(screening.matches_text("  R#00000001 ")).select("symbol", "company_name")


@query("flt_01b_range")
def _(spark, d):
    f = chains.features(spark, d).withColumn("volatility_pct", F.col("volatility_20d_annualized") * 100)
    shown = screening.screen(f.withColumn("company_name", F.col("symbol")), rsi_range=(0, 100), max_volatility=500)
    return rounded(shown.select("symbol", "date", "rsi_14", "volatility_pct"), 6)


@query("flt_01c_trend_below")
def _(spark, d):
    f = chains.features(spark, d)
    above = F.coalesce(F.col("close") > F.col("sma_50"), F.lit(False))
    f = f.withColumns({"trend_above_sma50": above, "volatility_pct": F.col("volatility_20d_annualized") * 100})
    return screening.screen(f, trend="Below SMA 50", max_volatility=1e9).select("symbol", "date")


@query("flt_01d_numeric")
def _(spark, d):
    df = screening.screen(
        chains.screener(spark, d), max_volatility=1e9,
        numeric_filters={"beta_252_raw": ("<=", 1.0), "profit_margin_raw_pct": (">=", 30.0)},
    )
    return pick(df, "symbol", "beta_252_raw", "profit_margin_raw_pct")


@query("flt_01e_label_lists")
def _(spark, d):
    s = chains.screener(spark, d)
    some = screening.screen(s, max_volatility=1e9, labels=["Strong", "Weak"]).withColumn("list", F.lit("two"))
    none = screening.screen(s, max_volatility=1e9, labels=[]).withColumn("list", F.lit("empty"))
    off = screening.screen(s, max_volatility=1e9, labels=None).withColumn("list", F.lit("off"))
    return some.unionByName(none).unionByName(off).groupBy("list").agg(F.count(F.lit(1)).alias("n_rows"))


@query("flt_02_any_label_screen")
def _(spark, d):
    df = screening.screen_any_label(
        chains.screener(spark, d), search="s00",
        criteria=[("momentum_63d_raw_pct", ">=", -50.0), ("momentum_63d_raw_pct", "<=", 60.0), ("score_coverage", ">=", 0.8)],
        benchmark=BENCHMARK,
    )
    return pick(df, "symbol", "momentum_63d_raw_pct", "score_coverage", "composite_score")


@query("flt_03_signal_map")
def _(spark, d):
    return pick(screening.signal_map(chains.screener(spark, d)), "symbol", "eligible", "bubble_score", "overall_label")


@query("flt_03_signal_map_counts")
def _(spark, d):
    return screening.signal_map_counts(chains.screener(spark, d))


@query("flt_04_quadrant_map")
def _(spark, d):
    df = screening.quadrant_map(chains.screener(spark, d).where(F.col("symbol") != BENCHMARK))
    return pick(df, "symbol", "plotted", "reasons", "pe_axis_cap", "pe_divider", "quadrant")


@query("flt_05_month_lookback")
def _(spark, d):
    return market.lookback(tables.panel(spark, d).select("symbol", "date")).select("symbol", "timeframe", "date")


@query("flt_06_day_lookback")
def _(spark, d):
    df = market.lookback_days(tables.panel(spark, d).select("symbol", "date"), TIMEFRAME_DAYS)
    return df.groupBy("symbol", "timeframe").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"))


@query("flt_07_known_facts")
def _(spark, d):
    df = filings.known_facts(tables.facts(spark, d), "1998-05-15")
    return rounded(df.select("symbol", "tag", "val", "period_end", "filed", "form"), 4)


@query("flt_08_minimum_cross_section")
def _(spark, d):
    b = tables.bars(spark, d).select("symbol", "date")
    return research.minimum_cross_section(b, 20)


@query("flt_09_complete_cases")
def _(spark, d):
    df = indicators.add_momentum(chains.basis(spark, d), (63,)).select("symbol", "date", "momentum_63d")
    return rounded(research.complete_cases(df, ["momentum_63d"]))


# ---- joins -------------------------------------------------------------------------------------


@query("jn_01_align_returns")
def _(spark, d):
    f = indicators.add_returns(chains.basis(spark, d))
    return rounded(market.align_returns(f, f, BENCHMARK))


@query("jn_02_alignment_audit")
def _(spark, d):
    f = indicators.add_returns(chains.basis(spark, d))
    return market.alignment_audit(f, f, BENCHMARK)


@query("jn_03_master")
def _(spark, d):
    m = chains.master(spark, d)
    money = {"revenue": 4, "net_income": 4, "assets": 4, "liabilities": 4, "equity": 4}
    return rounded(
        m.select(
            "symbol", "date", "close", "sma_50", "rsi_14", "is_benchmark", "company_name", "sic_description", "exchange",
            "revenue", "net_income", "assets", "liabilities", "equity", "eps_diluted",
            "beta_60", "beta_60_n_obs", "beta_252", "beta_252_n_obs", "momentum_63d", "momentum_126d", "momentum_126d_n_obs",
            "revenue_growth_yoy", "profit_margin", "latest_frame", "comparison_frame", "quality_note",
        ),
        **money,
    )


@query("jn_03_master_as_of")
def _(spark, d):
    """The master table on the last day of every quarter, in one job."""
    money = {"revenue": 4, "net_income": 4, "assets": 4, "liabilities": 4, "equity": 4}
    return rounded(
        chains.master_as_of(spark, d).select(
            "symbol", "as_of", "date", "close", "sma_50", "rsi_14", "is_benchmark", "company_name", "sic_description", "exchange",
            "revenue", "net_income", "assets", "liabilities", "equity", "eps_diluted",
            "beta_60", "beta_60_n_obs", "beta_252", "beta_252_n_obs", "momentum_63d", "momentum_126d", "momentum_126d_n_obs",
            "revenue_growth_yoy", "profit_margin", "latest_frame", "comparison_frame", "quality_note", "has_fundamentals", "has_growth",
        ),
        **money,
    )


@query("jn_04_screener")
def _(spark, d):
    return pick(
        chains.screener(spark, d), "symbol", "company_name", "close", "signal", "trend_above_sma50", "rsi_14",
        "composite_score", "score_coverage", "overall_display_label",
    )


@query("jn_05_master_valuation")
def _(spark, d):
    df = chains.master(spark, d).join(chains.valuation(spark, d), "symbol", "left")
    return pick(df, "symbol", "is_benchmark", "pe_ratio", "pe_ratio_raw", "pe_is_meaningful", "pe_exclusion_reason")


@query("jn_06_compare_betas")
def _(spark, d):
    latest = snapshot.latest_beta(market.add_rolling_beta(chains.aligned(spark, d)))
    df = market.compare_betas(latest, catalog.provider_betas(chains.stock_symbols(spark, d), tables.overviews(spark, d)))
    cols = [c for n in BETA_WINDOWS for c in (f"difference_beta_{n}", f"absolute_difference_beta_{n}")]
    return pick(df, "symbol", "provider_beta", "provider_beta_available", "methodology_comparable", *cols)


@query("jn_07_indexed_comparison")
def _(spark, d):
    df = market.indexed_comparison(chains.panel(spark, d), BENCHMARK)
    return pick(df, "symbol", "timeframe", "date", "stock_indexed", "benchmark_indexed")


@query("jn_07_comparison_summary")
def _(spark, d):
    return rounded(market.comparison_summary(chains.panel(spark, d), BENCHMARK)).drop("benchmark")


@query("jn_07_comparison_by_days")
def _(spark, d):
    """The day-count variant: the window ends on the stock's own last day."""
    df = market.indexed_comparison_days(chains.panel(spark, d), BENCHMARK, TIMEFRAME_DAYS)
    return rounded(df)


def _decisions(spark, d) -> DataFrame:
    """Every supplier decides on each of its own order days."""
    return tables.bars(spark, d).select("symbol", F.col("date").alias("decision_date"))


@query("jn_08_point_in_time_facts")
def _(spark, d):
    return rounded(filings.point_in_time_facts(tables.facts(spark, d), _decisions(spark, d)), 4)


@query("jn_09_year_on_year")
def _(spark, d):
    q = filings.quarterly_facts(tables.facts(spark, d), REVENUE_TAGS)
    df = filings.year_on_year(q).select("symbol", "year", "quarter", "val", "prior_val", "growth_yoy", "comparison_frame")
    return rounded(df, 8, val=4, prior_val=4)


@query("jn_10_match_income")
def _(spark, d):
    f = tables.facts(spark, d)
    df = filings.match_income(filings.quarterly_facts(f, REVENUE_TAGS), filings.quarterly_facts(f, INCOME_TAGS))
    return rounded(df.select("symbol", "year", "quarter", "val", "income", "income_tag"), 4)


@query("jn_11_universe_semi_anti")
def _(spark, d):
    p = tables.panel(spark, d).select("symbol", "date")
    u = catalog.universe_of(tables.panel(spark, d), BENCHMARK)
    kept = p.join(u.where(~F.col("is_benchmark")), "symbol", "left_semi").withColumn("side", F.lit("universe"))
    left = p.join(u.where(~F.col("is_benchmark")), "symbol", "left_anti").withColumn("side", F.lit("other"))
    return kept.unionByName(left).groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("symbol").alias("symbols"))


# ---- aggregations ------------------------------------------------------------------------------


@query("agg_01_latest_per_symbol")
def _(spark, d):
    return rounded(snapshot.latest_per_symbol(chains.panel(spark, d).select("symbol", "date", "close", "volume")))


@query("agg_01_latest_beta")
def _(spark, d):
    return rounded(snapshot.latest_beta(market.add_rolling_beta(chains.aligned(spark, d))))


@query("agg_02_first_per_symbol")
def _(spark, d):
    return statistics.first_return_check(chains.features(spark, d))


@query("agg_03_feature_report")
def _(spark, d):
    cols = [*audit.INDICATORS, "momentum_21d", "momentum_63d", "momentum_126d"]
    return statistics.feature_report(chains.features(spark, d), cols)


@query("agg_04_missing_report")
def _(spark, d):
    return rounded(statistics.missing_report(chains.master(spark, d)))


@query("agg_05_missing_by_symbol")
def _(spark, d):
    return statistics.missing_by_symbol(chains.master(spark, d))


@query("agg_06_missing_summary")
def _(spark, d):
    return statistics.missing_summary(chains.master(spark, d))


@query("agg_07_distributions")
def _(spark, d):
    t = chains.transformed(spark, d).where(~F.col("is_benchmark"))
    return rounded(statistics.distribution_statistics(t), 6)


@query("agg_07_panel_distributions")
def _(spark, d):
    f = chains.features(spark, d).where(F.col("symbol") != BENCHMARK)
    return rounded(statistics.distribution_statistics(f, ["rsi_14", "drawdown", "momentum_21d", "volatility_20d_annualized"]), 6)


@query("agg_08_histogram")
def _(spark, d):
    return rounded(statistics.histogram(chains.transformed(spark, d).where(~F.col("is_benchmark")), DISTRIBUTION_FEATURES), 6)


@query("agg_09_boxplot")
def _(spark, d):
    t = chains.transformed(spark, d).where(~F.col("is_benchmark"))
    cols = [c for f in WINSOR_FEATURES for c in (f, f"{f}_winsorized")]
    return rounded(statistics.boxplot(t, cols), 6)


@query("agg_10_winsor_bounds")
def _(spark, d):
    m = chains.master(spark, d).join(chains.valuation(spark, d), "symbol", "left")
    return rounded(transform.winsor_bounds(m))


@query("agg_10_winsor_bounds_as_of")
def _(spark, d):
    m = chains.master_as_of(spark, d).join(chains.valuation(spark, d), "symbol", "left")
    return rounded(transform.winsor_bounds(m, by=chains.AS_OF))


def _correlated(spark, d) -> DataFrame:
    return chains.transformed(spark, d).where(~F.col("is_benchmark"))


def _plain_names(df: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(_slug(c)) for c in df.columns])


def _slug(label: str) -> str:
    return label.lower().replace(" ", "_").replace("/", "_")


@query("agg_11_correlation_matrix")
def _(spark, d):
    return rounded(_plain_names(statistics.correlation_matrix(_correlated(spark, d))))


@query("agg_12_pair_counts")
def _(spark, d):
    return _plain_names(statistics.pair_counts(_correlated(spark, d)))


@query("agg_13_ranked_pairs")
def _(spark, d):
    return rounded(statistics.ranked_pairs(_correlated(spark, d)))


@query("agg_13_strong_pairs")
def _(spark, d):
    return rounded(statistics.correlation_summary(_correlated(spark, d)))


@query("agg_14_quintile_summary")
def _(spark, d):
    return rounded(research.quintile_summary(chains.observations(spark, d)))


@query("agg_15_spread_by_date")
def _(spark, d):
    return rounded(research.spread_by_date(chains.observations(spark, d)))


@query("agg_15_research_report")
def _(spark, d):
    return rounded(research.research_report(chains.observations(spark, d)))


@query("agg_16_screener_kpis")
def _(spark, d):
    s = chains.screener(spark, d)
    shown = screening.screen(s, max_volatility=1e9, include_benchmark=False, benchmark=BENCHMARK)
    return rounded(screening.screener_kpis(shown, s, BENCHMARK))


@query("agg_17_upper_medians")
def _(spark, d):
    shown = screening.screen_any_label(chains.screener(spark, d), sort_by=None, benchmark=BENCHMARK)
    return rounded(screening.upper_median_kpis(shown, ["rsi_14", "volatility_pct", "pe_ratio_raw", "composite_score"]))


@query("agg_18_market_breadth")
def _(spark, d):
    s = chains.screener(spark, d)
    m = chains.master(spark, d).select("symbol", (F.col("momentum_63d") * 100).alias("_m"))
    s = s.join(m, "symbol", "left").withColumn(
        "momentum_63d_raw_pct", F.coalesce("momentum_63d_raw_pct", "_m")
    )
    return rounded(screening.market_breadth(s, BENCHMARK))


@query("agg_19_symbol_quality")
def _(spark, d):
    wanted = {
        "missing_close": "close", "missing_return": "simple_return", "missing_sma20": "sma_20", "missing_sma50": "sma_50",
        "missing_rsi": "rsi_14", "missing_volatility": "volatility_20d_annualized",
    }
    return statistics.symbol_quality(chains.features(spark, d), wanted)


@query("agg_20_label_distribution")
def _(spark, d):
    return scoring.label_distribution(chains.screener(spark, d))


@query("agg_21_master_coverage")
def _(spark, d):
    return statistics.master_coverage(chains.master(spark, d))


@query("agg_21_growth_coverage")
def _(spark, d):
    return statistics.growth_coverage(chains.growth(spark, d))


@query("agg_21_score_coverage")
def _(spark, d):
    return statistics.score_coverage(chains.labels(spark, d))


@query("agg_21_latest_coverage")
def _(spark, d):
    return statistics.latest_coverage(chains.master(spark, d), ["beta_60", "beta_126", "beta_252", "momentum_21d", "momentum_126d"])


@query("agg_22_timeframe_max_drawdown")
def _(spark, d):
    return rounded(market.max_drawdown(market.add_timeframe_drawdown(market.lookback(tables.panel(spark, d)))))


@query("agg_23_lookahead_audit")
def _(spark, d):
    early = chains.features(spark, d).where("date <= date'2000-12-31'")
    return audit.lookahead_audit(early, chains.master(spark, d), chains.fundamentals(spark, d))


def _holdings(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers buy what they ordered; prices are each supplier's last two closes."""
    owner = F.col("o_custkey").alias("owner")
    orders = tables.table(spark, d, "orders")
    li = tables.table(spark, d, "lineitem")
    spent = li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        owner, tables.symbol_of("l_suppkey").alias("symbol"), (F.col("l_extendedprice") / 100 - 20).alias("amount")
    )
    w = indicators.by_symbol()
    b = tables.bars(spark, d).withColumn("price", F.lag("close").over(w))
    last = snapshot.latest_per_symbol(b.select("symbol", "date", "price", F.col("close").alias("next_price")))
    cash = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_acctbal").alias("cash"))
    return spent, last.drop("date"), cash


@query("agg_24_portfolio_moves")
def _(spark, d):
    spent, last, _cash = _holdings(spark, d)
    return rounded(portfolio.mark_to_market(spent, last), 6)


@query("agg_24_portfolio_worth")
def _(spark, d):
    spent, last, cash = _holdings(spark, d)
    return rounded(portfolio.worth(portfolio.mark_to_market(spent, last), cash), 6)


# ---- windows -----------------------------------------------------------------------------------


@query("win_01_simple_return")
def _(spark, d):
    return pick(indicators.add_returns(chains.basis(spark, d)), "symbol", "date", "simple_return")


@query("win_02_log_return")
def _(spark, d):
    return pick(indicators.add_returns(chains.basis(spark, d)), "symbol", "date", "log_return")


@query("win_03_sma")
def _(spark, d):
    return pick(indicators.add_simple_averages(chains.basis(spark, d)), "symbol", "date", "sma_20", "sma_50")


@query("win_04_ema")
def _(spark, d):
    return rounded(indicators.add_ema(chains.basis(spark, d)).select("symbol", "date", "ema_20"), 6)


@query("win_05_rsi")
def _(spark, d):
    return rounded(indicators.add_rsi(chains.basis(spark, d)).select("symbol", "date", "rsi_14"), 6)


@query("win_05a_linear_recurrence")
def _(spark, d):
    """Exponentially faded turnover per supplier, y = 0.9 y + 0.1 x."""
    import math

    b = tables.bars(spark, d).select("symbol", "date", (F.col("volume") * 0.1).alias("u"))
    b = b.withColumn("decay", (F.row_number().over(indicators.by_symbol()) - 1) * F.lit(math.log(0.9)))
    return rounded(linear_recurrence(b, ["symbol"], "date", {"faded": "u"}, "decay").select("symbol", "date", "faded"), 6)


@query("win_06_volatility")
def _(spark, d):
    return pick(indicators.add_risk(chains.basis(spark, d)), "symbol", "date", "volatility_20d_annualized")


@query("win_07_drawdown")
def _(spark, d):
    return pick(indicators.add_risk(chains.basis(spark, d)), "symbol", "date", "drawdown")


@query("win_08_max_drawdown_to_date")
def _(spark, d):
    return pick(indicators.add_risk(chains.basis(spark, d)), "symbol", "date", "max_drawdown_to_date")


@query("win_09_momentum")
def _(spark, d):
    cols = [c for n in (21, 63, 126) for c in (f"momentum_{n}d", f"momentum_{n}d_n_obs")]
    return pick(indicators.add_momentum(chains.basis(spark, d)), "symbol", "date", *cols)


@query("win_09_momentum_provider_close")
def _(spark, d):
    return pick(chains.momentum_history(spark, d), "symbol", "date", "close", "momentum_21d")


@query("win_10_rolling_beta")
def _(spark, d):
    f = indicators.add_returns(chains.basis(spark, d))
    df = market.add_rolling_beta(market.align_returns(f, f, BENCHMARK))
    cols = [c for n in BETA_WINDOWS for c in (f"beta_{n}", f"beta_{n}_n_obs", f"benchmark_variance_{n}")]
    return pick(df, "symbol", "date", *cols)


@query("win_11_forward_return")
def _(spark, d):
    return pick(indicators.add_forward_return(tables.panel(spark, d)), "symbol", "date", "forward_return_21d")


@query("win_12_quintile")
def _(spark, d):
    return pick(chains.observations(spark, d), "symbol", "date", "momentum_63d", "forward_return_21d", "quintile", "forward_hit")


@query("win_13_timeframe_drawdown")
def _(spark, d):
    df = market.deep_dive(chains.features(spark, d))
    return pick(df, "symbol", "timeframe", "date", "timeframe_drawdown_pct", "volatility_20d_annualized_pct")


@query("win_14_percentile_rank")
def _(spark, d):
    cols = [f"{f}_{s}" for f in DISTRIBUTION_FEATURES for s in ("percentile", "rank_position", "eligible_count")]
    return pick(chains.percentiles(spark, d), "symbol", *cols)


@query("win_14_percentile_as_of")
def _(spark, d):
    cols = [f"{f}_{s}" for f in DISTRIBUTION_FEATURES for s in ("percentile", "rank_position", "eligible_count")]
    return pick(chains.percentiles_as_of(spark, d), "symbol", "as_of", *cols)


@query("win_14_percentile_by_date")
def _(spark, d):
    """Every shipping day is a cross-section: volume percentile of each supplier among the day's bars."""
    b = tables.bars(spark, d).select("symbol", "date", F.col("volume").alias("value"))
    return rounded(scoring.percentile_ranks(b, ["date"]))


@query("win_15_score_rank")
def _(spark, d):
    return pick(chains.labels(spark, d), "symbol", "composite_score", "score_eligible", "score_rank")


@query("win_15_score_rank_as_of")
def _(spark, d):
    return pick(chains.scores_as_of(spark, d), "symbol", "as_of", "composite_score", "score_eligible", "score_rank")


@query("win_16_peer_percentile")
def _(spark, d):
    df = explain.peer_percentiles(chains.screener(spark, d), ["volatility_pct", "pe_ratio_raw", "profit_margin_raw_pct"], BENCHMARK)
    return pick(df, "symbol", "field", "value", "peer_percentile", "band")


@query("win_17_indexed_to_100")
def _(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("symbol").orderBy("date")
    df = tables.panel(spark, d).withColumn("indexed", F.col("adjusted_close") / F.first("adjusted_close").over(w) * 100)
    return pick(df, "symbol", "date", "indexed")


@query("win_18_duplicate_keys")
def _(spark, d):
    return keys.duplicate_keys(tables.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- sorts, sets -------------------------------------------------------------------------------


@query("srt_01_panel_order")
def _(spark, d):
    return pick(tables.panel(spark, d), "symbol", "date", "close").orderBy("symbol", "date")


@query("srt_02_user_sort")
def _(spark, d):
    return pick(sinks.ranked_screen(chains.screener(spark, d), ["symbol", "pe_ratio_raw"], "pe_ratio_raw", ascending=True), "rank", "symbol", "pe_ratio_raw")


@query("srt_03_score_order")
def _(spark, d):
    df = chains.labels(spark, d).select("symbol", "score_rank", F.col("score_rank").cast("double").alias("_k"))
    return sinks.ranked_screen(df, ["symbol", "score_rank"], "_k", ascending=True)


@query("srt_04_missing_order")
def _(spark, d):
    r = statistics.missing_report(chains.master(spark, d))
    return rounded(r.select("feature", "missing_rate")).orderBy(F.desc_nulls_last("missing_rate"), "feature")


@query("srt_05_top_pairs")
def _(spark, d):
    return rounded(statistics.ranked_pairs(_correlated(spark, d)).limit(10))


@query("srt_06_quarter_priority")
def _(spark, d):
    df = filings.quarterly_facts(tables.facts(spark, d), REVENUE_TAGS)
    return rounded(df.select("symbol", "year", "quarter", "val", "tag", "filed", "form"), 4)


@query("srt_07_latest_fact")
def _(spark, d):
    return rounded(filings.latest_facts(tables.facts(spark, d), as_of="2000-03-01"), 4)


@query("set_01_union_by_name")
def _(spark, d):
    b = tables.bars(spark, d)
    both = b.unionByName(tables.market_bars(b)).groupBy("provider")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"))


@query("set_02_date_sets")
def _(spark, d):
    b = tables.bars(spark, d).select("date").distinct()
    m = tables.market_bars(tables.bars(spark, d)).select("date").distinct()
    only = b.exceptAll(m).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("stock only"))
    both = b.intersect(m).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("both"))
    return only.unionByName(both)


@query("set_03_comparison_long")
def _(spark, d):
    return rounded(market.comparison_long(market.indexed_comparison(chains.panel(spark, d), BENCHMARK)))


@query("set_04_pivot_quintiles")
def _(spark, d):
    wide = chains.observations(spark, d).groupBy("date").pivot("quintile", [1, 2, 3, 4, 5]).agg(F.count(F.lit(1)))
    return wide.select("date", *[F.col(str(q)).alias(f"n_q{q}") for q in range(1, 6)])


# ---- scalar functions --------------------------------------------------------------------------


@query("scl_01_trading_date")
def _(spark, d):
    e = tables.table(spark, d, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    text = (
        F.when(F.col("event_type") == "click", day)
        .when(F.col("event_type") == "view", F.concat(day, F.lit(" 00:00:00")))
        .when(F.col("event_type") == "error", F.concat(day, F.lit("T20:00:00+00:00")))
        .otherwise(F.concat(day, F.lit(" 20:00:00 UTC")))
    )
    return e.select("event_id", scalars.strict_trading_date(text).alias("day"))


@query("scl_02_lenient_number")
def _(spark, d):
    docs = tables.table(spark, d, "documents")
    s = tables.overviews(spark, d).select(F.concat(F.lit("o"), "symbol").alias("id"), F.col("PERatio").alias("t"))
    words = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("place", "t"))
    t = words.select(F.concat_ws(" ", F.lit("d"), "doc_id", "place").alias("id"), "t")
    n = scalars.lenient_number(F.col("t"))
    parsed = s.unionByName(t).select("id", F.when(F.abs(n) < 1e6, n).alias("small"), F.when(F.abs(n) >= 1e6, n).alias("large"))
    # A number of this size has no eighth decimal to round.
    shown = rounded(parsed.select("id", "large", F.col("small").alias("number")).select("id", "number", F.col("large").cast("string").alias("large")))
    return shown.select("id", F.coalesce("number", F.col("large").cast("double")).alias("number"))


@query("scl_03_text_functions")
def _(spark, d):
    p = tables.table(spark, d, "part")
    padded = F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))
    return p.select(
        "p_partkey", scalars.symbol_text(padded).alias("upper_name"), F.lower(F.trim(padded)).alias("lower_name"),
        F.contains(F.lower("p_name"), F.lit("red")).alias("has_red"),
    )


@query("scl_04_frame_parts")
def _(spark, d):
    f = tables.facts(spark, d).select("symbol", "tag", "frame", "filed", "seq")
    return f.select(
        "symbol", "tag", "filed", "seq", scalars.frame_year(F.col("frame")).alias("year"),
        scalars.frame_quarter(F.col("frame")).alias("quarter"), scalars.is_quarter_frame(F.col("frame")).alias("is_quarter"),
    )


@query("scl_05_comparison_frame")
def _(spark, d):
    o = tables.table(spark, d, "orders")
    return o.select("o_orderkey", scalars.prior_year_frame(F.year("o_orderdate"), F.quarter("o_orderdate")).alias("comparison_frame"))


@query("scl_06_math")
def _(spark, d):
    s = tables.table(spark, d, "customer")
    b = F.col("c_acctbal")
    return rounded(
        s.select(
            "c_custkey", F.ln(F.abs(b) + 1).alias("log_value"), F.sqrt(F.abs(b)).alias("root"),
            scalars.ratio(b, F.when(b > 0, b + 1).otherwise(0.0)).alias("share"),
            scalars.clip(b, F.lit(-100.0), F.lit(5000.0)).alias("clipped"),
        )
    )


@query("scl_07_winsorize")
def _(spark, d):
    cols = [c for f in WINSOR_FEATURES for c in (f"{f}_winsorized", f"{f}_outlier_flag")]
    return pick(chains.transformed(spark, d), "symbol", *cols)


@query("scl_07_winsorize_as_of")
def _(spark, d):
    cols = [c for f in WINSOR_FEATURES for c in (f"{f}_winsorized", f"{f}_outlier_flag")]
    return pick(chains.transformed_as_of(spark, d), "symbol", "as_of", *cols)


@query("scl_08_pe_validity")
def _(spark, d):
    wanted = chains.stock_symbols(spark, d).unionByName(
        tables.table(spark, d, "nation").select(F.col("n_name").alias("symbol"))
    )
    return rounded(transform.provider_valuation(wanted, tables.overviews(spark, d)).drop("pe_source"))


@query("scl_09_weighted_score")
def _(spark, d):
    score, coverage = scoring.weighted_score(
        {"momentum_63d_score": 0.4, "valuation_score": 0.4, "profitability_score": 0.2}, require_all=False
    )
    strict, _ = scoring.weighted_score(
        {"momentum_63d_score": 0.4, "valuation_score": 0.4, "profitability_score": 0.2}, require_all=True
    )
    df = chains.percentiles(spark, d).select("symbol", score.alias("score"), coverage.alias("coverage"), strict.alias("strict_score"))
    return rounded(df)


@query("scl_10_subscores")
def _(spark, d):
    return pick(
        chains.labels(spark, d), "symbol", "momentum_subscore", "quality_subscore", "quality_subscore_coverage",
        "valuation_subscore", "composite_score", "score_coverage", "incomplete_score_flag", "score_eligible",
        "intended_components_available",
    )


@query("scl_10_subscores_as_of")
def _(spark, d):
    return pick(
        chains.scores_as_of(spark, d), "symbol", "as_of", "momentum_subscore", "quality_subscore", "quality_subscore_coverage",
        "valuation_subscore", "composite_score", "score_coverage", "incomplete_score_flag", "score_eligible", "intended_components_available",
    )


@query("scl_11_direction_adjust_as_of")
def _(spark, d):
    return pick(
        chains.percentiles_as_of(spark, d), "symbol", "as_of", "momentum_21d_score", "growth_score", "profitability_score",
        "valuation_score", "drawdown_resilience_score",
    )


@query("scl_11_policy_table_as_of")
def _(spark, d):
    return rounded(scoring.policy_table(chains.transformed_as_of(spark, d), by=chains.AS_OF))


@query("scl_11_direction_adjust")
def _(spark, d):
    return pick(
        chains.percentiles(spark, d), "symbol", "momentum_21d_score", "growth_score", "profitability_score",
        "valuation_score", "drawdown_resilience_score",
    )


@query("scl_11_policy_table")
def _(spark, d):
    return rounded(scoring.policy_table(chains.transformed(spark, d)))


@query("scl_12_score_label")
def _(spark, d):
    b = tables.table(spark, d, "lineitem")
    score = F.when(F.col("l_quantity") == 13, None).otherwise(F.col("l_quantity") * 2)
    df = b.select(score.alias("score")).withColumn("label", scalars.score_label(F.col("score")))
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


@query("scl_13_display_label")
def _(spark, d):
    return chains.labels(spark, d).select(
        "symbol", "momentum_label", "fundamentals_label", "valuation_label", "overall_label",
        "overall_display_label", "signal_is_eligible", "signal_note",
    )


@query("scl_14_technical_signal")
def _(spark, d):
    f = chains.features(spark, d)
    signal = scalars.technical_signal(F.col("rsi_14"), F.col("close"), F.col("sma_50"))
    return f.select("symbol", "date", signal.alias("signal"))


@query("scl_15_growth_metrics")
def _(spark, d):
    df = chains.growth(spark, d).select(
        "symbol", "revenue_growth_yoy", "profit_margin", "latest_revenue", "prior_year_revenue", "latest_net_income",
        "latest_frame", "comparison_frame", "revenue_tag", "net_income_tag", "period_start", "period_end",
        "revenue_growth_available", "profit_margin_available", "unusual_margin_flag", "quality_note",
    )
    return rounded(df, 8, latest_revenue=4, prior_year_revenue=4, latest_net_income=4)


@query("scl_16_evidence_lists")
def _(spark, d):
    e = explain.evidence_lists(chains.screener(spark, d))
    return e.select(
        "symbol", json_list("strengths").alias("strengths"), json_list("cautions").alias("cautions"),
        json_list("data_gaps").alias("data_gaps"), "overall",
    )


@query("scl_17_context_text")
def _(spark, d):
    df = explain.context_texts(chains.screener(spark, d), BENCHMARK)
    return df.select("symbol", "context", "label", "value_text", "status", "meaning", "peer_position")


@query("scl_17_context_lines")
def _(spark, d):
    return explain.context_lines(chains.screener(spark, d), BENCHMARK)


@query("scl_18_json_get")
def _(spark, d):
    e = tables.table(spark, d, "events")
    props = F.from_json("props", "map<string, long>")
    return e.select(
        "event_id", F.try_element_at(props, F.lit("k")).alias("k"),
        F.coalesce(F.try_element_at(props, F.lit("missing")), F.lit(-1).cast("long")).alias("missing"),
    )


@query("scl_19_iso_dates")
def _(spark, d):
    o = tables.table(spark, d, "orders")
    doc = F.to_json(F.struct(scalars.iso_date(F.col("o_orderdate")).alias("d"), F.lit(None).cast("double").alias("x")), {"ignoreNullFields": "false"})
    return o.select("o_orderkey", doc.alias("document"))
