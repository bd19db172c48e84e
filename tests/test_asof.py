"""State and scores on many decision days, against one day at a time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickerloom.constants import FACT_METRICS, RANK_POLICY, WINSOR_FEATURES
from tickerloom.operators import asof, filings, scoring, snapshot, transform
from tickerloom.operators.merge import merge_states

D = dt.date
FACT = "symbol string, tag string, unit string, val double, period_start date, period_end date, filed date, form string, frame string, seq int"


def facts(spark):
    """Quarters restated, filed late, of other tags and without a frame; two companies."""
    r, rows = random.Random(4), []
    for symbol in ("A", "B"):
        for k in range(14):
            year, q = 2020 + k // 4, k % 4 + 1
            start, end = D(year, 3 * q - 2, 1), D(year, 3 * q, 28)
            frame = f"CY{year}Q{q}"
            for tag, frm in (("Revenues", frame), ("SalesRevenueNet", frame), ("NetIncomeLoss", frame), ("Assets", frame + "I"), ("Revenues", None)):
                for again in range(r.choice([0, 1, 1, 2])):
                    filed = end + dt.timedelta(days=r.choice([30, 45, 45, 200, 400]) + again * 90)
                    rows.append((symbol, tag, "USD", float(r.randint(-5, 100)), start, end, filed, r.choice(["10-Q", "10-K"]), frm, again))
    rows += [("A", "Revenues", "USD", 1.0, D(2020, 1, 1), D(2020, 3, 31), None, "10-Q", "CY2020Q1", 9), ("A", "Revenues", "USD", 9e9, D(2020, 1, 1), D(2020, 3, 31), D(2020, 4, 1), "8-K", "CY2020Q1", 9)]
    return spark.createDataFrame(rows, FACT)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_dense_facts_equal_latest_facts_of_each_day(spark):
    f = facts(spark)
    days = [D(2019, 1, 1), D(2020, 6, 1), D(2021, 5, 12), D(2021, 5, 12), D(2024, 1, 1)]
    decisions = spark.createDataFrame([(s, d) for s in ("A", "B", "none") for d in days], "symbol string, decision_date date")
    dense = filings.point_in_time_facts(f, decisions)
    assert dense.count() == 3 * 4 * len(FACT_METRICS)
    for day in set(days):
        known = dense.where((F.col("decision_date") == F.lit(day)) & F.col("filed").isNotNull()).drop("decision_date")
        assert rows_of(known, "symbol", "metric") == rows_of(filings.latest_facts(f, as_of=str(day)), "symbol", "metric")
    assert dense.where("symbol = 'none' AND (val IS NOT NULL OR form IS NOT NULL)").count() == 0


def test_dense_facts_take_one_exchange(spark):
    decisions = spark.createDataFrame([("A", D(2021, 1, 1))], "symbol string, decision_date date")
    plan = filings.point_in_time_facts(facts(spark), decisions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_growth_events_equal_growth_of_each_day(spark):
    f = facts(spark)
    symbols = spark.createDataFrame([("A",), ("B",), ("none",)], "symbol string")
    days = [D(2019, 1, 1)] + [D(2020, 5, 1) + dt.timedelta(days=211 * i) for i in range(7)]
    asked = spark.createDataFrame([(s, d) for s in ("A", "B", "none") for d in days], "symbol string, at date")
    states = merge_states(asked, [filings.growth_events(f)])
    got = states.select("symbol", "at", *[e.alias(c) for c, e in filings.growth_columns(F.col("growth")).items()]).collect()
    assert len(got) == len(days) * 3
    for day in days:
        want = {tuple(r) for r in filings.company_growth(symbols, f, as_of=str(day)).collect()}
        assert {tuple(v for k, v in r.asDict().items() if k != "at") for r in got if r.at == day} == want


def test_merge_of_states(spark):
    part = spark.createDataFrame([("A", D(2024, 1, 2), 5, 1), ("A", D(2024, 1, 3), 3, None), ("A", D(2024, 1, 9), 4, 7)], "symbol string, at date, last int, high int")
    asked = spark.createDataFrame([("A", D(2024, 1, d)) for d in (1, 2, 3, 3, 8, 9)] + [("B", D(2024, 1, 5))], "symbol string, at date")
    got = rows_of(merge_states(asked, [part.select("symbol", "at", "last"), part.select("symbol", "at", "high")], highest=["high"]), "symbol", "at")
    assert got == [("A", D(2024, 1, d), v, h) for d, v, h in ((1, None, None), (2, 5, 1), (3, 3, 1), (8, 3, 1), (9, 4, 7))] + [("B", D(2024, 1, 5), None, None)]


def cross_sections(spark):
    r, rows = random.Random(2), []
    names = sorted({c for s, _, _ in RANK_POLICY.values() for c in (s.removesuffix("_winsorized"),)} | set(WINSOR_FEATURES) | set(RANK_POLICY))
    for day in (D(2024, 3, 31), D(2024, 6, 30)):
        for i in range(40):
            rows.append((f"S{i}", day, i == 0, *[None if r.random() < 0.1 else round(r.gauss(day.month, 2), 1) for _ in names]))
    return spark.createDataFrame(rows, "symbol string, as_of date, is_benchmark boolean, " + ", ".join(f"{n} double" for n in names)).withColumn("date", F.col("as_of"))


def test_days_scored_together_equal_each_alone(spark):
    both = cross_sections(spark)
    by = ["as_of"]

    def scored(df, by):
        wide = transform.winsorize(df, by=by)
        ids = ("symbol", "as_of", "date")
        ranked = scoring.feature_percentiles(wide, ids=ids, by=by)
        return wide, ranked, scoring.composite_scores(ranked, by=by), transform.winsor_bounds(df, by=by), scoring.policy_table(wide, by=by)

    together = scored(both, by)
    for day in ("2024-03-31", "2024-06-30"):
        alone = scored(both.where(F.col("as_of") == day), ())
        for a, b in zip(together, alone):
            kept = a.where(F.col("as_of") == day)
            columns = sorted(b.columns)
            assert sorted(map(repr, kept.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))
    ranks = together[2].where("score_rank = 1").select("as_of").collect()
    assert {r.as_of for r in ranks} == {D(2024, 3, 31), D(2024, 6, 30)}


def test_master_as_of_the_last_day_is_the_master(spark):
    folder = "/root/testdata/sf0.001"
    pytest.importorskip("pathlib").Path(folder).exists() or pytest.skip("test tables absent")
    from tickerloom.operators import market
    from tickerloom.plans import chains, tables

    last = chains.features(spark, folder).agg(F.max("date")).first()[0]
    want = chains.master(spark, folder)
    f = chains.features(spark, folder)
    asked = f.select("symbol").distinct().withColumn("as_of", F.lit(last))
    got = asof.master_as_of(
        asked, f.select([c for c in want.columns if c in f.columns]), market.add_rolling_beta(chains.aligned(spark, folder)),
        chains.momentum_history(spark, folder), tables.facts(spark, folder), tables.identity(spark, folder), "MKT",
    )
    assert set(got.columns) == {*want.columns, "as_of"}
    columns = want.columns
    exact = [c for c in columns if not c.startswith("beta_") or c.endswith("_n_obs")]
    assert [tuple(r) for r in got.select(exact).orderBy("symbol").collect()] == [tuple(r) for r in want.select(exact).orderBy("symbol").collect()]
    betas = [c for c in columns if c not in exact]
    for a, b in zip(got.orderBy("symbol").select(betas).collect(), want.orderBy("symbol").select(betas).collect()):
        assert list(a) == [None if v is None else pytest.approx(v, rel=1e-9) for v in b]
    assert snapshot.FUNDAMENTAL_COLUMNS == [c for c in columns if c in snapshot.FUNDAMENTAL_COLUMNS]


def test_latest_beta_is_the_last_row_of_the_rolling_one(spark):
    from tickerloom.operators import market

    r, rows = random.Random(8), []
    for symbol, n in (("A", 40), ("B", 9), ("C", 30), ("D", 25)):
        for i in range(n):
            x = 0.01 if symbol == "C" and i > 12 else r.gauss(0, 0.01)
            x = None if symbol == "D" and i == 20 else x
            rows.append((symbol, D(2024, 1, 1) + dt.timedelta(days=i), 1.2 * (x or 0) + r.gauss(0, 0.001), x))
    aligned = spark.createDataFrame(rows, "symbol string, date date, simple_return double, benchmark_simple_return double")
    want = snapshot.latest_beta(market.add_rolling_beta(aligned, (8, 12, 20)), (8, 12, 20)).orderBy("symbol").collect()
    got = market.latest_rolling_beta(aligned, (8, 12, 20)).select(want[0].__fields__).orderBy("symbol").collect()
    for a, b in zip(got, want):
        assert list(a) == [pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for v in b]
    assert [r.beta_8 is None for r in got] == [False, False, True, True]
    with pytest.raises(Exception, match="duplicate"):
        market.latest_rolling_beta(aligned.union(aligned), (8,)).collect()


def test_fold_check_takes_time_in_proportion(spark):
    import time

    from tickerloom.operators import audit, indicators

    def checked(n):
        r = random.Random(1)
        rows = [("A", D(1900, 1, 1) + dt.timedelta(days=i), None if n < 400 and i in (90, 91) else 100 + r.random()) for i in range(n)]
        f = indicators.add_all(spark.createDataFrame(rows, "symbol string, date date, close double")).cache()
        f.count()
        start = time.time()
        out = {x.indicator: x.passed for x in audit.independent_recompute(f).collect()}
        return time.time() - start, out

    _, gap = checked(300)
    assert all(gap.values()) and len(gap) == 9
    short, _ = checked(3_650)
    long, out = checked(36_500)
    assert all(out.values()) and long < 20 * max(short, 1.0)


def test_only_rows_that_a_decision_sees_enter_the_merge(spark):
    days = [None, None, *(D(2020, 1, 1) + dt.timedelta(days=i) for i in range(100))]
    dated = spark.createDataFrame([(s, d, float(i)) for s in (" a", "B") for i, d in enumerate(days)], "symbol string, date date, v double")
    decisions = spark.createDataFrame([("A", D(2020, 1, 31)), ("B", D(2020, 3, 31)), ("B", D(2020, 1, 31)), ("B", D(2019, 6, 30))], "symbol string, as_of date")
    kept = asof._dated(dated, "state", ["date", "v"], decisions)
    wanted = [None, D(2020, 1, 31), D(2020, 3, 31), D(2020, 4, 9)]
    assert [(r["symbol"], r["at"], r["state"]["date"]) for r in kept.orderBy("symbol", "at").collect()] == [(s, d, d) for s in "AB" for d in wanted]
    everything = dated.select(F.upper(F.trim("symbol")).alias("symbol"), F.col("date").alias("at"), F.struct("date", "v").alias("state"))
    asked = decisions.select("symbol", F.col("as_of").alias("at"))
    # Which of two rows without a day comes last is not defined.
    of = lambda part: [(r["symbol"], r["at"], r["state"] and r["state"]["date"]) for r in merge_states(asked, [part]).orderBy("symbol", "at").collect()]
    assert of(kept) == of(everything)
