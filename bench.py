"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query starts without stage tables, so its time covers the whole chain from the source tables.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from tickerloom.plans import chains, flagship
from tickerloom.plans.queries import QUERIES

HEADLINES = [
    "src_01_price_files", "prj_02_price_issues", "win_03_sma", "win_04_ema", "win_05_rsi", "win_06_volatility",
    "win_09_momentum", "win_10_rolling_beta", "win_12_quintile", "win_14_percentile_by_date", "jn_01_align_returns",
    "jn_07_comparison_summary", "jn_08_point_in_time_facts", "agg_01_latest_per_symbol", "agg_07_panel_distributions",
    "agg_14_quintile_summary", "agg_24_portfolio_worth", "scl_10_subscores", "scl_15_growth_metrics",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tickerloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tickerloom-bench-"))
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    only = sys.argv[1:]
    runs = {name: QUERIES[name] for name in HEADLINES} | {"flagship_screener": flagship.screener_report}
    seconds = {}
    for name, run in runs.items():
        if only and not any(part in name for part in only):
            continue
        chains.forget_stages()
        start = time.perf_counter()
        # The noop sink computes every column and moves nothing to the driver.
        run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
