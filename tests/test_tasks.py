"""Windows over the bars of symbols: a task holds a bounded number of bars however many there are."""

import datetime as dt
import pathlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import filings, market, merge
from tickerloom.plans import chains, tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(s, dt.datetime(2001, 1, 1) + dt.timedelta(days=d), 1.0 + s % 7, 1000.0 + s + d, 0.1) for s in range(40) for d in range(30)]
    kind = "l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double"
    spark.createDataFrame(rows, kind).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]


def test_tasks_follow_the_bars(spark, folder, monkeypatch):
    monkeypatch.setattr(chains, "BARS_PER_TASK", 30, raising=False)
    bars = chains.panel(spark, folder).count()
    assert bars > 1200
    for dated in (chains.basis(spark, folder), chains.momentum_history(spark, folder), chains.aligned(spark, folder)):
        assert dated.count() > 500 and most_in_a_task(dated) <= 300
    assert most_in_a_task(market.add_rolling_beta(chains.aligned(spark, folder), (5,))) <= 300
    assert chains.features(spark, folder).count() == bars


def test_a_merge_takes_the_tasks_it_is_given(spark):
    asked = spark.range(400).select(F.col("id").cast("string").alias("symbol"), F.lit(dt.date(2020, 1, 2)).alias("at"))
    part = asked.select("symbol", F.lit(dt.date(2020, 1, 1)).alias("at"), F.lit(1).alias("state"))
    states = merge.merge_states(asked, [part], tasks=40)
    assert states.where("state = 1").count() == 400 and most_in_a_task(states) <= 60


def test_shipments_and_facts_of_a_task_are_bounded(spark, folder, monkeypatch):
    monkeypatch.setattr(tables, "SHIPMENTS_PER_TASK", 30, raising=False)
    monkeypatch.setattr(chains, "BARS_PER_TASK", 30, raising=False)
    bars = tables.bars(spark, folder)
    assert bars.count() == 1200 and most_in_a_task(bars) <= 100
    facts = chains.facts(spark, folder)
    assert chains.keyed_facts(spark, folder).count() == facts.count() and most_in_a_task(chains.keyed_facts(spark, folder)) < facts.count() / 4


def test_a_snapshot_compares_a_fact_once(spark, folder):
    plan = filings.fundamentals_snapshot(chains.facts(spark, folder).repartition(4, "symbol"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    first = [line for line in plan.splitlines() if "Aggregate(" in line][-1]
    assert first.count("partial_max_by(") == 1


def test_facts_read_shipments_once(spark, folder):
    plan = tables.facts(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_facts_put_the_texts_of_a_quarter_together_once(spark, tmp_path):
    rows = [(1, dt.datetime(2001, 11, 5), 1.0, 100.0, 0.0)] * 30 + [(1, None, 1.0, 11.0, 0.0)]
    kind = "l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    facts = tables.facts(spark, str(tmp_path))
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("concat(CY") == 1
    found = {(r.tag, r.frame, r.form, r.filed) for r in facts.where("seq < 2").collect()}
    late, filed = dt.date(2003, 2, 14), dt.date(2002, 2, 14)
    assert found >= {("Revenues", "CY2001Q4", "10-K", filed), ("Assets", "CY2001Q4I", "10-K", filed), ("Revenues", "CY2001Q4", "10-K", late)}
    assert {r[1:] for r in found if "null" in r[1]} == {("CYnullQnull", "10-Q", None), ("CYnullQnullI", "10-Q", None)}


def test_year_to_date_adds_up_the_quarters_there_are(spark, tmp_path):
    day = dt.datetime
    rows = [
        (1, day(2001, 1, 5), 1.0, 100.0, 0.0), (1, day(2001, 2, 5), 1.0, 10.0, 0.5), (1, day(2001, 8, 5), 1.0, 1000.0, 0.0),
        (1, day(2001, 12, 31), 1.0, 5.0, None), (1, day(2002, 5, 1), 1.0, 7.0, 0.0), (2, day(2001, 11, 1), 1.0, 3.0, 0.0),
        (None, day(2001, 4, 1), 1.0, 9.0, 0.0), (1, None, 1.0, 11.0, 0.0),
    ]
    kind = "l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = tables.facts(spark, str(tmp_path)).where("seq = 2").collect()
    assert {(r.symbol, r.period_end, r.val) for r in found} == {
        ("S0000000001", dt.date(2001, 9, 30), 1105.0), ("S0000000001", dt.date(2001, 12, 31), 1105.0),
        ("S0000000001", dt.date(2002, 6, 30), 7.0), ("S0000000002", dt.date(2001, 12, 31), 3.0), (None, dt.date(2001, 6, 30), 9.0),
    }
    assert len(found) == 5 and all(r.frame is None and r.tag == "Revenues" and r.period_start == dt.date(r.period_end.year, 1, 1) for r in found)


def test_indicators_are_staged_without_a_dictionary(spark, folder):
    staged = chains.features(spark, folder)
    parts = [str(x) for x in pathlib.Path(staged.stage_path.removeprefix("file:")).glob("*.parquet")]
    group = next(f.metadata.row_group(0) for f in map(pq.ParquetFile, parts) if f.metadata.num_row_groups)
    encodings = {(c := group.column(i)).path_in_schema: c.encodings for i in range(group.num_columns)}
    plain = [c for c in encodings if not any("DICTIONARY" in e for e in encodings[c])]
    assert {"simple_return", "rsi_14", "drawdown", "momentum_21d"} <= set(plain) and "symbol" not in plain
    assert set(chains.MEASURED) <= set(staged.columns)
