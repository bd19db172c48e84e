"""Stage tables that keep how rows are dealt out, and what reads them without an exchange."""

import datetime as dt
import pathlib
import statistics
import time

import pytest
from pyspark.sql import functions as F

from tickerloom import stage as stages
from tickerloom.operators import audit, indicators, market

DAY = dt.date


def local_folders(spark):
    return list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]


def bars(spark, symbols=20, days=8):
    return spark.range(symbols * days).select(
        F.concat(F.lit("S"), (F.col("id") % symbols).cast("string")).alias("symbol"),
        F.date_add(F.lit(DAY(2020, 1, 1)), (F.col("id") / symbols).cast("int")).alias("date"),
        (F.lit(10.0) + F.col("id") % 7).alias("close"),
    )


def test_a_bucketed_stage_is_read_without_an_exchange(spark):
    df = bars(spark).unionByName(bars(spark, 1, 2).withColumn("symbol", F.lit(None).cast("string")))
    staged = stages.stage(df.repartition(5, "symbol"), "bucketed", ["close"], buckets=5)
    assert sorted(map(str, staged.collect())) == sorted(map(str, df.collect())) and staged.schema == df.schema
    again = indicators.add_simple_averages(staged, (2,))
    assert not exchanges(again) and again.where("sma_2 IS NOT NULL").count() == 141
    assert len(list(pathlib.Path(staged.stage_path.removeprefix("file:")).glob("*.parquet"))) <= 5
    stages.drop(staged)
    assert not pathlib.Path(staged.stage_path.removeprefix("file:")).exists() and not spark.catalog.tableExists(staged.stage_table)


def test_a_stage_leaves_settings_as_they_were_and_no_exchange(spark):
    before = {k: spark.conf.get(k, None) for k in stages.WRITTEN_WITH}
    blocks = lambda: [x for d in local_folders(spark) for x in pathlib.Path(d).rglob("shuffle_*.data")]
    there = set(blocks())
    staged = stages.stage(bars(spark).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "plain")
    until = time.time() + 20  # files go a moment after the write
    while set(blocks()) - there and time.time() < until:
        time.sleep(0.1)
    assert not set(blocks()) - there and staged.where("n = 8").count() == 20
    assert {k: spark.conf.get(k, None) for k in stages.WRITTEN_WITH} == before
    with pytest.raises(Exception, match="no more"):
        stages.stage(spark.range(1).select(F.raise_error(F.lit("no more")).alias("x")), "failing")
    assert {k: spark.conf.get(k, None) for k in stages.WRITTEN_WITH} == before


def test_prefix_rows_meet_the_full_run_without_an_exchange(spark):
    full = stages.stage(bars(spark).repartition(4, "symbol"), "full", buckets=4)
    cut = full.where("date < '2020-01-05'").withColumn("close", F.when(F.col("symbol") == "S3", -1.0).otherwise(F.col("close")))
    out = audit.prefix_invariance(full, cut, ["close"])
    assert not exchanges(out)
    assert out.first().asDict() == {"rows_compared": 80, "close_changed": 4}


def test_prefix_rows_pair_as_a_left_join_does(spark):
    kind = "symbol string, date date, x double, y double"
    day, later = DAY(2020, 1, 1), DAY(2020, 1, 2)
    full = spark.createDataFrame(
        [("A", day, 1.0, None), ("A", day, 2.0, 3.0), ("A", later, 1.0, 1.0), (None, day, 1.0, 1.0), ("B", None, 1.0, 1.0), ("C", day, 1.0, 1.0)], kind
    )
    cut = spark.createDataFrame(
        [
            ("A", day, 1.0, None), ("A", day, 2.0, 4.0), ("A", later, 1.0, 1.0), ("A", DAY(2020, 1, 3), 1.0, None), (None, day, 1.0, None),
            ("B", None, 1.0, None), ("B", None, 2.0, 2.0), ("D", day, None, 1.0),
        ], kind,
    )
    assert audit.prefix_invariance(full, cut, ["x", "y"]).first().asDict() == {"rows_compared": 10, "x_changed": 6, "y_changed": 5}


def test_recomputing_exchanges_a_bar_once_at_most(spark):
    plain = stages.stage(indicators.add_all(bars(spark, 4, 90)), "plain")
    passed = {(r.symbol, r.indicator) for r in audit.independent_recompute(plain).where("passed").collect()}
    assert passed == {(f"S{s}", i) for s in range(4) for i in audit.INDICATORS}
    assert len(exchanges(audit.independent_recompute(plain))) == 1
    assert not exchanges(audit.independent_recompute(stages.stage(plain.repartition(3, "symbol"), "bucketed", buckets=3)))


@pytest.mark.parametrize("day", [DAY(2020, 1, 3), None])
def test_recomputing_refuses_a_repeated_or_missing_day(spark, day):
    f = stages.stage(indicators.add_all(bars(spark, 2, 30)), "features")
    spoiled = f.unionByName(f.where("date = '2020-01-03'").withColumn("date", F.lit(day).cast("date")))
    with pytest.raises(Exception, match="duplicate symbol/date"):
        audit.independent_recompute(spoiled).collect()


def test_recomputing_windows_keep_gaps_and_outliers_apart(spark):
    """A missing close empties its windows only, and a price beyond all others leaves no trace once it is out."""
    gap = F.when((F.col("symbol") == "S0") & (F.col("date") == "2020-02-10"), None)
    closes = gap.when((F.col("symbol") == "S1") & (F.col("date") == "2020-02-10"), 1e15).when(F.col("symbol") != "S2", F.col("close")).otherwise(5.0)
    f = stages.stage(indicators.add_all(bars(spark, 3, 150).withColumn("close", closes)), "features")
    listed = ["sma_20", "sma_50", "volatility_20d_annualized"]
    checked = audit.independent_recompute(f).where(F.col("indicator").isin(listed))
    assert {(r.symbol, r.indicator) for r in checked.where("passed").collect()} == {(f"S{s}", i) for s in range(3) for i in listed}
    for c in listed:
        off = f.withColumn(c, F.when((F.col("symbol") == "S0") & (F.col("date") == "2020-05-20"), F.col(c) + 1e-6).otherwise(F.col(c)))
        found = {(r.symbol, r.indicator) for r in audit.independent_recompute(off).where(F.col("indicator").isin(listed) & ~F.col("passed")).collect()}
        assert found == {("S0", c)}


def test_windows_of_beta_are_made_of_short_blocks():
    for windows in ((60, 126, 252), (5,), (8, 12, 20), (7, 11, 100)):
        blocks = market._blocks(windows)
        for n in windows:
            ends = [at for _, at in blocks[n]]
            assert ends == sorted(ends) and [at + size for size, at in blocks[n]] == [*ends[1:], n] and ends[0] == 0
    assert max(size for parts in market._blocks((60, 126, 252)).values() for size, _ in parts) == 18


def test_beta_of_blocks_is_that_of_every_window(spark):
    """Against sums over whole frames: gaps in either series, a flat benchmark, partial windows and what they count."""
    rows = [
        (s, DAY(2020, 1, 1) + dt.timedelta(days=d), None if d % 41 == 40 and s == "A" else (d * 7 % 13) / 100, None if d == 70 else (d * 5 % (1 if s == "C" else 11)) / 90)
        for s in "ABC" for d in range(150)
    ]
    df = spark.createDataFrame(rows, "symbol string, date date, simple_return double, benchmark_simple_return double")
    got = {(r.symbol, r.date): r for r in market.add_rolling_beta(df, (6, 20, 50)).collect()}
    for s in "ABC":
        mine = [r for r in rows if r[0] == s]
        for i, (_, day, _, _) in enumerate(mine):
            for n in (6, 20, 50):
                held = mine[max(0, i - n + 1): i + 1]
                pairs = [(y, x) for _, _, y, x in held if y is not None and x is not None]
                xs = [x for *_, x in held if x is not None]
                r = got[s, day]
                assert r[f"beta_{n}_n_obs"] == len(pairs)
                full = len(xs) == n
                assert (r[f"benchmark_variance_{n}"] is not None) == full
                if full:
                    assert r[f"benchmark_variance_{n}"] == pytest.approx(statistics.variance(xs), abs=1e-12)
                if len(pairs) == n and len(set(xs)) > 1:
                    assert r[f"beta_{n}"] == pytest.approx(statistics.covariance([p[0] for p in pairs], xs) / statistics.variance(xs), abs=1e-9)
                else:
                    assert r[f"beta_{n}"] is None
