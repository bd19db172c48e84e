"""Chains from the tables to scores. Stage tables are written once per session and folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.constants import MOMENTUM_PERIODS
from tickerloom.operators import asof, cleaning, filings, indicators, market, research, scoring, snapshot, transform
from tickerloom.operators.keys import keyed
from tickerloom.plans import tables
from tickerloom.plans.tables import BENCHMARK
from tickerloom.stage import drop_all, stage

_staged: dict[tuple[str, str, str, str], DataFrame] = {}


def forget_stages() -> None:
    """Remove every stage table, of chains and of operators; the next use of one computes it again."""
    drop_all()
    _staged.clear()


def _listing(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of the input files: another listing is another input."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(hadoop).globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/*"))
    return ";".join(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found or [])


def staged(
    spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], distinct: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """The stage table of this name over the folder as it is now; ``distinct`` and ``buckets`` as ``stage`` has them."""
    key = (spark.sparkContext.applicationId, folder, name, _listing(spark, folder))
    if key not in _staged:
        _staged[key] = stage(build(), name, distinct, buckets)
    return _staged[key]


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of the shipments, aggregated once: the panel reads them for the stocks and again for the benchmark."""
    return staged(spark, folder, "bars", lambda: tables.bars(spark, folder))


#: Bars that a task of the windows holds: about 150 MB with all indicators.
BARS_PER_TASK = 100_000


def tasks(spark: SparkSession, folder: str) -> int:
    """Tasks of windows over the bars of symbols: one a core, and more so that a task's bars do not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-bars(spark, folder).count() // BARS_PER_TASK))


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, folder, "facts", lambda: tables.facts(spark, folder))


def keyed_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts dealt out by symbol, a bounded number a task. The choice among facts carries text and so sorts its input, and a
    task of a scan would sort all rows of a split."""
    return keyed(facts(spark, folder), tasks(spark, folder))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    b = bars(spark, folder)
    return b.unionByName(tables.market_bars(b))


def clean_panel(spark: SparkSession, folder: str) -> DataFrame:
    return keyed(cleaning.clean_prices(panel(spark, folder), validate=False), tasks(spark, folder))


def basis(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.adjusted_price_basis(clean_panel(spark, folder), validate=False)


#: Indicators that hardly repeat a value.
MEASURED = [
    "simple_return", "log_return", "sma_20", "sma_50", "ema_20", "rsi_14", "volatility_20d_annualized", "drawdown",
    *[f"momentum_{n}d" for n in MOMENTUM_PERIODS],
]


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Every indicator. The windows have dealt rows out by symbol already, and the table keeps that: later windows on the
    symbol read it without an exchange, in tasks of as many bars."""
    return staged(spark, folder, "features", lambda: indicators.add_all(basis(spark, folder)), MEASURED, tasks(spark, folder))


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return features(spark, folder).where(F.col("symbol") == BENCHMARK)


def aligned(spark: SparkSession, folder: str) -> DataFrame:
    """Staged indicators are dealt out by cleaned symbols, and their tasks are bounded."""
    return market.align_returns(features(spark, folder), benchmark(spark, folder), BENCHMARK, tidy=True)


def as_of(spark: SparkSession, folder: str):
    """Latest trading day, as a scalar subquery."""
    return tables.table(spark, folder, "lineitem").agg(F.max(F.to_date("l_shipdate"))).scalar()


def fundamentals(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        snap = filings.fundamentals_snapshot(keyed_facts(spark, folder), as_of=as_of(spark, folder))
        joined = snap.join(tables.identity(spark, folder), "symbol", "left")
        return cleaning.clean_fundamentals(joined, validate=False)

    return staged(spark, folder, "fundamentals", build)


def stock_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return tables.suppliers(spark, folder).select("symbol")


def growth(spark: SparkSession, folder: str) -> DataFrame:
    return filings.company_growth(
        stock_symbols(spark, folder), facts(spark, folder), as_of=as_of(spark, folder)
    )


def momentum_history(spark: SparkSession, folder: str) -> DataFrame:
    """Momentum of the provider's close, as the dedicated momentum table has it."""
    return indicators.add_momentum(clean_panel(spark, folder))


def master(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        f = features(spark, folder)
        technical = f.select(
            "symbol", "date", "close", "adjusted_close", "simple_return", "sma_20", "sma_50", "ema_20", "rsi_14",
            "volatility_20d_annualized", "drawdown", "max_drawdown_to_date",
        )
        return snapshot.build_master(
            snapshot.latest_per_symbol(technical),
            fundamentals(spark, folder),
            market.latest_rolling_beta(aligned(spark, folder)),
            snapshot.latest_momentum(momentum_history(spark, folder)),
            growth(spark, folder),
            BENCHMARK,
        )

    return staged(spark, folder, "master", build)


def valuation(spark: SparkSession, folder: str) -> DataFrame:
    return transform.provider_valuation(stock_symbols(spark, folder), tables.overviews(spark, folder))


def transformed(spark: SparkSession, folder: str) -> DataFrame:
    return staged(
        spark, folder, "transformed",
        lambda: transform.transform_features(master(spark, folder), valuation(spark, folder)),
    )


def percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, folder, "percentiles", lambda: scoring.feature_percentiles(transformed(spark, folder)))


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.composite_scores(percentiles(spark, folder), transformed(spark, folder))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, folder, "labels", lambda: scoring.add_labels(scores(spark, folder)))


AS_OF = ["as_of"]


def master_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """The master table on the last day of every quarter."""

    def build() -> DataFrame:
        f = features(spark, folder)
        technical = f.select(
            "symbol", "date", "close", "adjusted_close", "simple_return", "sma_20", "sma_50", "ema_20", "rsi_14",
            "volatility_20d_annualized", "drawdown", "max_drawdown_to_date",
        )
        return asof.master_as_of(
            asof.period_ends(f), technical, market.add_rolling_beta(aligned(spark, folder)), momentum_history(spark, folder),
            facts(spark, folder), tables.identity(spark, folder), BENCHMARK, tasks(spark, folder),
        )

    return staged(spark, folder, "master_as_of", build)


def transformed_as_of(spark: SparkSession, folder: str) -> DataFrame:
    return staged(
        spark, folder, "transformed_as_of",
        lambda: transform.transform_features(master_as_of(spark, folder), valuation(spark, folder), by=AS_OF),
    )


def percentiles_as_of(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, folder, "percentiles_as_of", lambda: scoring.feature_percentiles(transformed_as_of(spark, folder), by=AS_OF))


def scores_as_of(spark: SparkSession, folder: str) -> DataFrame:
    return staged(
        spark, folder, "scores_as_of",
        lambda: scoring.composite_scores(percentiles_as_of(spark, folder), transformed_as_of(spark, folder), by=AS_OF),
    )


def screener(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        latest = snapshot.latest_per_symbol(
            features(spark, folder).select(
                "symbol", "date", "close", "adjusted_close", "simple_return", "sma_20", "sma_50", "rsi_14",
                "volatility_20d_annualized", "drawdown", "max_drawdown_to_date",
            )
        )
        return snapshot.build_screener(
            latest, fundamentals(spark, folder), labels(spark, folder), BENCHMARK, "All suppliers", "Benchmark index"
        )

    return staged(spark, folder, "screener", build)


def research_rows(spark: SparkSession, folder: str) -> DataFrame:
    return staged(
        spark, folder, "signal_rows", lambda: research.signal_rows(clean_panel(spark, folder), BENCHMARK)
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, folder, "observations", lambda: research.bin_observations(research_rows(spark, folder)))
