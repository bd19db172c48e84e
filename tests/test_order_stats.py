import pathlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import order_stats as os_
from tickerloom.operators.research import add_quantile_bin
from tickerloom.operators.scoring import percentile_ranks
from tickerloom.plans import chains


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value and one group; the rest is spread over many groups."""
    rng = np.random.default_rng(11)
    n = 30000
    group = np.where(rng.random(n) < 0.4, "hot", np.char.add("g", rng.integers(0, 40, n).astype(str)))
    value = np.where(rng.random(n) < 0.33, 5.0, np.round(rng.normal(0, 10, n), 2))
    pdf = pd.DataFrame({"id": np.arange(n), "g": group, "v": value})
    pdf.loc[rng.random(n) < 0.02, "v"] = np.nan
    df = spark.createDataFrame(pdf).selectExpr("id", "g", "CASE WHEN isnan(v) THEN NULL ELSE v END AS v")
    return pdf, df.repartition(6).cache()


def test_average_ranks_match_pandas(skewed):
    pdf, df = skewed
    out = percentile_ranks(df, ["g"], "v").toPandas().set_index("id").sort_index()
    assert len(out) == len(pdf)
    ranks = pdf.groupby("g")["v"].rank(method="average")
    pct = pdf.groupby("g")["v"].rank(method="average", pct=True) * 100
    assert np.allclose(out["rank_position"], ranks, equal_nan=True)
    assert np.allclose(out["percentile"], pct, equal_nan=True)


def test_quantiles_match_pandas(skewed):
    pdf, df = skewed
    qs = {"a": 0.05, "b": 0.5, "c": 0.731, "d": 1.0}
    out = os_.exact_quantiles(df, ["g"], "v", qs).toPandas().set_index("g")
    for name, q in qs.items():
        assert np.allclose(out[name].sort_index(), pdf.groupby("g")["v"].quantile(q).sort_index()), name
    whole = os_.exact_quantiles(df, [], "v", qs).first()
    assert whole["c"] == pytest.approx(pdf["v"].quantile(0.731))


def test_positions_are_a_permutation(skewed):
    pdf, df = skewed
    out = os_.with_position(df.where("v is not null"), ["g"], ["v", "id"]).toPandas().sort_values("id")
    clean = pdf.dropna().sort_values(["g", "v", "id"])
    clean["p"] = clean.groupby("g").cumcount()
    assert (out["position"].to_numpy() == clean.sort_values("id")["p"].to_numpy()).all()


def test_ranges_are_balanced_in_spite_of_a_hot_group(skewed):
    _, df = skewed
    sizes = os_.with_range(df.where("v is not null"), ["g", "v", "id"]).groupBy("_range").count().toPandas()["count"]
    assert len(sizes) > 200 and sizes.max() < 0.02 * sizes.sum()


@pytest.mark.parametrize("ranges", [4, 1000, 5000])
def test_any_number_of_ranges_cuts_in_order(skewed, ranges):
    _, df = skewed
    cut = os_.with_range(df.where("v is not null"), ["v", "id"], ranges).toPandas().sort_values(["v", "id"])
    assert cut["_range"].is_monotonic_increasing and len(cut) == df.where("v is not null").count()
    assert ranges / 3 < cut["_range"].nunique() <= ranges


@pytest.mark.parametrize("least", [4, 1000])
def test_results_do_not_depend_on_the_ranges(skewed, monkeypatch, least):
    pdf, df = skewed
    monkeypatch.setattr(os_, "LEAST_RANGES", least)
    monkeypatch.setattr(os_, "RANGES_PER_PARTITION", 1)
    out = percentile_ranks(df, ["g"], "v").toPandas().set_index("id").sort_index()
    assert np.allclose(out["rank_position"], pdf.groupby("g")["v"].rank(method="average"), equal_nan=True)


def test_missing_values_are_dealt_out(spark):
    df = spark.range(4000).selectExpr("id", "'f' AS g", "CASE WHEN id % 4 = 0 THEN CAST(id AS double) END AS v")
    spread = percentile_ranks(df, ["g"], "v")
    assert spread.where("v IS NULL AND percentile IS NULL").count() == 3000 and spread.where("percentile IS NOT NULL").count() == 1000
    join = next(x for x in spread._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x)
    assert "_spread" in join


def test_quantiles_read_the_input_twice_and_count_both_sides(spark, skewed, tmp_path):
    pdf, df = skewed
    df.write.parquet(str(tmp_path / "values"))
    stored = spark.read.parquet(str(tmp_path / "values"))
    out = os_.exact_quantiles(stored, ["g"], "v", {"low": 0.05, "mid": 0.5, "high": 0.95}, also=[F.count("id").alias("n")], counts=True)
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # The sketch was the first read; the second is the only scan of the values left, its tally is reused.
    scans = [x for x in plan.splitlines() if "FileScan" in x and "/values" in x]
    assert len(scans) == 1 and "ReusedExchange" in plan
    for row in rows:
        own = pdf.loc[pdf.g == row.g, "v"]
        assert row.n == len(own)
        for name, q in (("low", 0.05), ("mid", 0.5), ("high", 0.95)):
            bound = row[name]
            assert bound == pytest.approx(own.quantile(q))
            assert row[f"{name}_below"] == (own < bound).sum() and row[f"{name}_above"] == (own > bound).sum()


@pytest.mark.parametrize("points, accuracy", [(2, 4), (16, 8), (64, 256)])
def test_quantiles_are_exact_whatever_the_sketch(skewed, monkeypatch, points, accuracy):
    pdf, df = skewed
    monkeypatch.setattr(os_, "SKETCH_POINTS", points)
    monkeypatch.setattr(os_, "SKETCH_ACCURACY", accuracy)
    qs = {"a": 0.0, "b": 0.05, "c": 0.333, "d": 0.95, "e": 1.0}
    out = os_.exact_quantiles(df, ["g"], "v", qs).toPandas().set_index("g")
    for name, q in qs.items():
        assert np.allclose(out[name].sort_index(), pdf.groupby("g")["v"].quantile(q).sort_index()), name


@pytest.mark.parametrize("n", range(1, 12))
def test_quantiles_of_few_values(spark, n):
    values = [float(x * 7 % 5) for x in range(n)]
    qs = {f"q{i}": i / 10 for i in range(11)}
    out = os_.exact_quantiles(spark.createDataFrame([(x,) for x in values], "v double"), [], "v", qs).first()
    assert [out[name] for name in qs] == pytest.approx([np.quantile(values, q) for q in qs.values()])


def test_no_folder_is_left_of_what_quantiles_wrote(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    assert os_.exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 1.5
    assert any(root.glob("quantiles-*"))
    chains.forget_stages()
    assert not any(root.glob("quantiles-*"))


def test_quantiles_of_a_group_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "g string, v double")
    assert [tuple(r) for r in os_.exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()] == [("a", 1.5)]
    assert os_.upper_median(df, ["g"], "v", "m").count() == 1
    out = os_.exact_quantiles(df, ["g"], "v", {"m": 0.5}, also=[F.count(F.lit(1)).alias("n")], counts=True).orderBy("g").collect()
    assert [(r.g, r.n, r.m, r.m_below, r.m_above) for r in out] == [("a", 2, 1.5, 1, 1), ("b", 1, None, None, None)]
    assert os_.exact_quantiles(df.where("g = 'b'"), [], "v", {"m": 0.5}).first()["m"] is None


def test_upper_median(spark):
    df = spark.createDataFrame([(x,) for x in (4.0, 1.0, 3.0, 2.0)], "v double")
    assert os_.upper_median(df, [], "v", "m").first()["m"] == 3.0


@pytest.mark.parametrize("n", [5, 10, 11, 13, 20, 23, 36, 101])
def test_quantile_bins_match_qcut(spark, n):
    pdf = pd.DataFrame({"date": "d", "symbol": [f"S{i:04}" for i in range(n)], "x": [(i * 7919) % 13 * 1.0 for i in range(n)]})
    expected = pd.qcut(pdf.sort_values(["x", "symbol"])["x"].rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    expected.index = pdf.sort_values(["x", "symbol"])["symbol"]
    out = add_quantile_bin(spark.createDataFrame(pdf), "x").toPandas().set_index("symbol")["quintile"]
    assert out.sort_index().tolist() == expected.sort_index().tolist()


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert os_.exact_quantiles(df, ["g"], "v", {"m": 0.5}).count() == 0
    assert percentile_ranks(df, ["g"], "v").count() == 0
