"""The registered queries against their SQL on the smallest tables, and plan shapes."""

import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="test tables absent")


def _compared():
    from tickerloom.plans.oracles import ORACLES
    from tickerloom.plans.queries import QUERIES

    # The inventory's SQL reads the files of one scale.
    return sorted(set(ORACLES) & set(QUERIES) - {"src_13_raw_inventory"})


@pytest.fixture(scope="module")
def con():
    import compare

    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", _compared())
def test_query_matches_sql(spark, con, name):
    import __spark_entry__ as contract
    import compare

    df = contract.queries()[name](spark, FOLDER)
    res = con.execute(contract.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns)
    assert compare.canonical([tuple(r) for r in df.collect()], df.columns) == compare.canonical(res.fetchall(), names)


def test_every_oracle_belongs_to_a_query():
    import __spark_entry__ as contract

    from tickerloom.plans.queries import QUERIES

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.oracle_sql())


def test_inventory_matches_sql(spark):
    import __spark_entry__ as contract
    import compare

    folder = "/root/testdata/sf0.01"
    df = contract.queries()["src_13_raw_inventory"](spark, folder)
    res = compare.connect(folder).execute(contract.oracle_sql()["src_13_raw_inventory"])
    names = [c[0] for c in res.description]
    assert compare.canonical([tuple(r) for r in df.collect()], df.columns) == compare.canonical(res.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as contract

    df = contract.entry(spark)
    assert df.count() > 0 and "composite_score" in df.columns


def test_bars_read_only_what_they_need(spark):
    from tickerloom.plans import tables

    plan = tables.bars(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    schema = scan.split("ReadSchema: ")[1]
    assert "l_comment" not in schema and "l_discount" not in schema and "l_orderkey" not in schema
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan


def test_ranks_never_gather_a_cross_section(spark):
    from tickerloom.operators.order_stats import rank_table
    from tickerloom.plans import tables

    plan = rank_table(tables.bars(spark, FOLDER), [], "volume")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_range" in line or "_held" in line for line in windows)
