"""Hand-computed cases of cleaning, alignment, filings, scoring and screening."""

import datetime as dt

import numpy as np
import pytest
from helpers import column, days, series
from pyspark.sql import functions as F

from tickerloom.constants import REVENUE_TAGS
from tickerloom.functions import scalars
from tickerloom.operators import (
    audit, cleaning, explain, filings, indicators, keys, market, portfolio, research, scoring, screening, snapshot,
    statistics, transform,
)

D = dt.date


# ---- cleaning ----------------------------------------------------------------------------------

BAR = "date string, symbol string, open double, high double, low double, close double, adjusted_close double, volume double, provider string"


def test_clean_prices(spark):
    df = spark.createDataFrame([("2024-01-02", " aapl ", 1.0, 2.0, 0.5, 1.5, 1.4, 2.5, " Twelve_Data ")], BAR)
    row = cleaning.clean_prices(df).first()
    assert (row.symbol, row.provider, row.date, row.volume) == ("AAPL", "twelve_data", D(2024, 1, 2), 2)
    assert row.price_adjustment == "splits_and_dividends"


def test_impossible_bar_fails_and_is_named(spark):
    df = spark.createDataFrame([("2024-01-02", "A", 1.0, 0.8, 0.5, 0.7, 0.7, 1.0, "x")], BAR)
    with pytest.raises(keys.DataQualityError, match="high_below_ohlc_rows=1"):
        cleaning.clean_prices(df)


def test_duplicate_and_missing_counts(spark):
    rows = [("2024-01-02", "A", 1.0, 2.0, 0.5, None, 1.4, None, "x")] * 3 + [("bad", " ", 1.0, 2.0, 0.5, 1.0, None, -1.0, "x")]
    got = cleaning.price_issues(cleaning.type_prices(spark.createDataFrame(rows, BAR))).first()
    assert got.duplicate_symbol_date == 2 and got.missing_ohlcv_cells == 6
    assert (got.missing_date, got.missing_symbol, got.missing_adjusted_close, got.negative_volume_rows) == (1, 1, 1, 1)


def test_liabilities_derived_only_for_the_same_period(spark):
    cols = ["symbol", *[f"{m}{s}" for m in ("revenue", "net_income", "assets", "liabilities", "equity", "eps_diluted")
                        for s in ("", "_period_end", "_filed", "_form", "_tag")]]
    base = {"assets": 100.0, "equity": 40.0, "assets_filed": "2024-02-01", "equity_filed": "2024-02-03", "assets_period_end": "2023-12-31"}
    rows = [dict(base, symbol="a", equity_period_end="2023-12-31"), dict(base, symbol="b", equity_period_end="2023-09-30")]
    schema = ", ".join(f"{c} {'double' if c in ('revenue', 'net_income', 'assets', 'liabilities', 'equity', 'eps_diluted') else 'string'}" for c in cols)
    df = cleaning.clean_fundamentals(spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], schema))
    a, b = df.orderBy("symbol").collect()
    assert a.liabilities == 60 and a.liabilities_form == "DERIVED" and a.liabilities_filed == D(2024, 2, 3) and not a.liabilities_is_missing
    assert b.liabilities is None and b.liabilities_is_missing


def test_adjusted_basis(spark):
    df = spark.createDataFrame([("A", 100.0, 50.0, "alpha_vantage"), ("B", 50.0, 50.0, "twelve_data")], "symbol string, close double, adjusted_close double, provider string")
    a, b = cleaning.adjusted_price_basis(df).orderBy("symbol").collect()
    assert (a.close, a.unadjusted_close) == (50, 100) and (b.close, b.unadjusted_close) == (50, None)
    with pytest.raises(keys.DataQualityError):
        cleaning.adjusted_price_basis(df.withColumn("adjusted_close", F.lit(None).cast("double")))


# ---- scalar functions --------------------------------------------------------------------------


def test_trading_dates(spark):
    df = spark.createDataFrame([("2026-08-03",), ("2026-08-03 00:00:00",), ("2026-08-03 20:00:00 UTC",), ("2026-08-03T23:00:00-05:00",), ("junk",)], "x string")
    got = [r[0] for r in df.select(scalars.trading_date(F.col("x"))).collect()]
    assert got == [D(2026, 8, 3)] * 3 + [D(2026, 8, 4), None]
    with pytest.raises(Exception, match="unparseable trading date: junk"):
        df.select(scalars.strict_trading_date(F.col("x"))).collect()


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/New_York"])
def test_trading_dates_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2026-08-03", "2026-08-03 00:00:00", "2026-08-03 20:00:00 UTC", "2026-08-03T20:00:00Z", "2026-08-03T22:00:00-01:30", "2026-08-03 23:59"]
        df = spark.createDataFrame([(t,) for t in texts], "x string")
        assert {r[0] for r in df.select(scalars.trading_date(F.col("x"))).collect()} == {D(2026, 8, 3)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_lenient_numbers(spark):
    texts = ["1.5", " -2 ", "", "None", "-", "N/A", "1e3", "nan", "inf", "12abc", None, "5d"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert [r[0] for r in df.select(scalars.lenient_number(F.col("x"))).collect()] == [1.5, -2.0, None, None, None, None, 1000.0, None, None, None, None, None]


def test_score_labels(spark):
    scores = [100.0, 80.0, 79.999, 60.0, 40.0, 20.0, 0.0, None]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    got = [r[0] for r in df.select(scalars.score_label(F.col("s"))).collect()]
    assert got == ["Strong", "Strong", "Positive", "Positive", "Neutral", "Weak", "Very Weak", "Unavailable"]
    with pytest.raises(Exception, match="score outside 0-100"):
        spark.createDataFrame([(101.0,)], "s double").select(scalars.score_label(F.col("s"))).collect()


def test_cik(spark):
    df = spark.createDataFrame([("CIK320193",), ("320193",)], "c string")
    assert {r[0] for r in df.select(scalars.zero_padded_cik(F.col("c"))).collect()} == {"0000320193"}
    with pytest.raises(Exception, match="digits only"):
        spark.createDataFrame([("12x",)], "c string").select(scalars.zero_padded_cik(F.col("c"))).collect()


# ---- benchmark ---------------------------------------------------------------------------------


def _pairs(spark, n, multiple, null_at=None, flat=False):
    rows = []
    for i, d in enumerate(days(n)):
        m = 0.01 if flat else ((i * 37) % 11 - 5) / 100.0
        rows.append((d, "A", None if i == null_at else multiple * m, m))
    return spark.createDataFrame(rows, "date date, symbol string, simple_return double, benchmark_simple_return double")


def test_beta_is_the_multiple(spark):
    out = market.add_rolling_beta(_pairs(spark, 130, 1.5)).cache()
    b60, b126 = column(out, "beta_60"), column(out, "beta_126")
    assert b60[58] is None and b60[59] == pytest.approx(1.5) and b126[125] == pytest.approx(1.5)
    assert set(column(out, "beta_252")) == {None} and column(out, "beta_252_n_obs")[-1] == 130


def test_beta_gap_and_constant_market(spark):
    out = column(market.add_rolling_beta(_pairs(spark, 45, 1.4, null_at=20), (20,)), "beta_20")
    assert out[19] == pytest.approx(1.4) and out[20:40] == [None] * 20 and out[40] == pytest.approx(1.4)
    flat = market.add_rolling_beta(_pairs(spark, 40, 1.0, flat=True), (20,))
    assert set(column(flat, "beta_20")) == {None} and column(flat, "benchmark_variance_20")[-1] == 0.0


@pytest.mark.parametrize("size", [1e3, 1e7, 1e12])
def test_rolling_beta_forgets_an_outlier(spark, size):
    r = np.random.default_rng(3)
    x, y = r.normal(0, 0.01, 400), r.normal(0, 0.02, 400)
    x[75], y[75] = size, -2 * size
    rows = [("A", d, float(b), float(b), float(a), float(a)) for d, a, b in zip(days(400), x, y)]
    df = spark.createDataFrame(rows, "symbol string, date date, simple_return double, log_return double, benchmark_simple_return double, benchmark_log_return double")
    out = column(market.add_rolling_beta(df, (60,)), "beta_60")
    assert not any(v is not None and v != v for v in out)
    for i in (150, 300, 399):
        w = slice(i - 59, i + 1)
        assert abs(out[i] - np.cov(y[w], x[w])[0, 1] / np.var(x[w], ddof=1)) < 1e-9


def test_rolling_beta_matches_pandas(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(0, 0.01, 400)
    y = 0.7 * m + rng.normal(0, 0.02, 400)
    rows = [(d, "A", float(a), float(b)) for d, a, b in zip(days(400), y, m)]
    df = spark.createDataFrame(rows, "date date, symbol string, simple_return double, benchmark_simple_return double")
    pdf = market.add_rolling_beta(df).toPandas().sort_values("date")
    for n in (60, 126, 252):
        want = pdf["simple_return"].rolling(n).cov(pdf["benchmark_simple_return"]) / pdf["benchmark_simple_return"].rolling(n).var()
        assert np.allclose(pdf[f"beta_{n}"].astype(float), want, equal_nan=True, rtol=1e-10)


RET = "date date, symbol string, simple_return double, log_return double"


def test_alignment(spark):
    d1, d2, d3 = days(3)
    stock = [(d1, "A", 0.1, 0.1), (d2, "A", 0.2, 0.2), (d3, "A", None, None)]
    bm = [(d1, "MKT", 0.01, 0.01), (d2, "MKT", None, None), (d3, "MKT", 0.03, 0.03)]
    s, b = spark.createDataFrame(stock, RET), spark.createDataFrame(bm, RET)
    assert market.align_returns(s, b, "MKT").count() == 1
    a = market.alignment_audit(s, b, "MKT").first()
    assert (a.stock_rows_total, a.stock_valid_return_rows, a.aligned_rows) == (3, 2, 1)
    assert (a.stock_dates_without_benchmark, a.benchmark_dates_without_stock, a.stock_null_return_rows_removed) == (1, 1, 1)
    with pytest.raises(Exception, match="duplicate dates"):
        market.align_returns(s, b.unionByName(b), "MKT").collect()
    with pytest.raises(Exception, match="duplicate symbol/date"):
        market.align_returns(s.unionByName(s), b, "MKT").collect()
    with pytest.raises(Exception, match="benchmark XYZ is not in the series"):
        market.align_returns(s, b, "XYZ").collect()
    lower = [x.withColumn("symbol", F.lower("symbol")) for x in (s, b)]
    assert [r.symbol for r in market.align_returns(*lower, "mkt").collect()] == ["A"]


def test_joins_fail_on_repeated_symbols(spark):
    once = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "symbol string, provider_beta double")
    assert keys.one_row_each(once, ["symbol"], "sides").count() == 2
    with pytest.raises(Exception, match="sides contains duplicate symbol keys: A"):
        keys.one_row_each(once.union(once.limit(1)), ["symbol"], "sides").collect()
    betas = spark.createDataFrame([("A", D(2024, 1, 2), 1.0)], "symbol string, date date, beta_60 double")
    with pytest.raises(Exception, match="provider betas contains duplicate"):
        market.compare_betas(betas, once.union(once), (60,)).collect()


@pytest.mark.parametrize("add", [indicators.add_returns, indicators.add_simple_averages, indicators.add_ema, indicators.add_rsi, indicators.add_risk, indicators.add_momentum])
def test_indicators_fail_on_a_repeated_day(spark, add):
    bars = series(spark, [100.0 + i for i in range(60)])
    with pytest.raises(Exception, match="duplicate symbol/date"):
        add(bars.union(bars.limit(1))).collect()


def test_comparison_rejects_bad_prices_and_repeated_days(spark):
    rows = [(s, d, 10.0) for s in ("A", "M") for d in days(4)]
    frame = lambda x: spark.createDataFrame(x, "symbol string, date date, adjusted_close double")
    with pytest.raises(Exception, match="strictly positive"):
        market.comparison_summary(frame([*rows[:-1], ("M", days(4)[3], -5.0)]), "M").collect()
    with pytest.raises(Exception, match="duplicate symbol/date"):
        market.comparison_summary(frame([*rows, rows[0]]), "M").collect()
    short = market.comparison_summary(frame([*rows, ("B", days(1)[0], 5.0)]), "M").where("symbol = 'B'").collect()
    assert {(r.status, r.common_observations, r.stock_return) for r in short} == {("fewer than two common days", 1, None)} and len(short) == 4


def test_comparison_summary(spark):
    d = days(4)
    rows = [("A", d[0], 100.0), ("A", d[1], 105.0), ("A", d[2], 120.0), ("M", d[0], 100.0), ("M", d[2], 110.0), ("M", d[3], 111.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, adjusted_close double")
    got = market.comparison_summary(df, "M", {"3M": 3}).first()
    assert got.common_observations == 2 and got.stock_return == pytest.approx(0.2) and got.benchmark_return == pytest.approx(0.1)
    assert got.excess_return_pp == pytest.approx(10) and (got.stock_dates_excluded, got.benchmark_dates_excluded) == (1, 1)


def test_return_check(spark):
    good = indicators.add_returns(series(spark, [1, 2, 3])).withColumn("provider", F.lit("p"))
    market.assert_returns(good)
    with pytest.raises(keys.DataQualityError):
        market.assert_returns(good.withColumn("simple_return", F.col("simple_return") + 0.01))


# ---- filings -----------------------------------------------------------------------------------

FACT = "symbol string, tag string, unit string, val double, period_start date, period_end date, filed date, form string, frame string, seq int"


def _fact(val, frame, start=D(2025, 1, 1), end=D(2025, 3, 31), filed=D(2025, 5, 1), tag="Revenues", form="10-Q", seq=0, symbol="A", unit="USD"):
    return (symbol, tag, unit, val, start, end, filed, form, frame, seq)


def test_latest_fact_prefers_framed_quarters(spark):
    rows = [_fact(2.0, "CY2025Q1"), _fact(99.0, None, end=D(2025, 6, 30), seq=1), _fact(100.0, "CY2025", end=D(2025, 12, 31), seq=2)]
    got = filings.latest_facts(spark.createDataFrame(rows, FACT)).first()
    assert got.metric == "revenue" and got.val == 2.0


def test_facts_are_known_from_their_filing_day(spark):
    rows = [_fact(10.0, "CY2025Q4", end=D(2025, 12, 31), filed=D(2026, 2, 1)), _fact(12.0, "CY2026Q1", end=D(2026, 3, 31), filed=D(2026, 5, 1), seq=1)]
    facts = spark.createDataFrame(rows, FACT)
    assert filings.latest_facts(facts, as_of="2026-04-30").first().val == 10
    assert filings.latest_facts(facts, as_of="2026-05-01").first().val == 12
    asked = spark.createDataFrame([("A", D(2026, 1, 31)), ("A", D(2026, 2, 1)), ("A", D(2026, 4, 30)), ("A", D(2026, 5, 1))], "symbol string, decision_date date")
    # A row for each day and metric; nothing is known on the first day, and of the other metrics on none.
    rows = filings.point_in_time_facts(facts, asked).collect()
    assert len(rows) == 24 and all(r.val is None for r in rows if r.metric != "revenue")
    got = {r.decision_date: r.val for r in rows if r.metric == "revenue"}
    assert got == {D(2026, 1, 31): None, D(2026, 2, 1): 10, D(2026, 4, 30): 10, D(2026, 5, 1): 12}


def test_point_in_time_agrees_with_one_date_at_a_time(spark):
    import random

    rng = random.Random(4)
    rows = [
        _fact(float(i), rng.choice([None, "CY2024", "CY2024Q1", "CY2024Q2I"]), end=D(2024, rng.randint(1, 12), 1),
              filed=D(2024, rng.randint(1, 12), rng.randint(1, 28)), tag=rng.choice(["Revenues", "SalesRevenueNet", "Assets"]),
              form=rng.choice(["10-K", "10-Q", "8-K"]), seq=i)
        for i in range(80)
    ]
    facts = spark.createDataFrame(rows, FACT).cache()
    dates = [D(2024, m, 15) for m in range(1, 13)]
    asked = spark.createDataFrame([("A", d) for d in dates], "symbol string, decision_date date")
    got = {(r.decision_date, r.metric): (r.val, r.tag) for r in filings.point_in_time_facts(facts, asked).collect()}
    want = {(d, r.metric): (r.val, r.tag) for d in dates for r in filings.latest_facts(facts, as_of=d.isoformat()).collect()}
    assert {k: v for k, v in got.items() if v != (None, None)} == want and len(want) > 12
    assert len(got) == len(dates) * len({m for _, m in got}) and {m for _, m in got} > {m for _, m in want}


def _growth(spark, rows):
    symbols = spark.createDataFrame([("A",), ("Z",)], "symbol string")
    return {r.symbol: r for r in filings.company_growth(symbols, spark.createDataFrame(rows, FACT)).collect()}


def test_growth_and_margin(spark):
    rows = [
        _fact(100.0, "CY2024Q1", D(2024, 1, 1), D(2024, 3, 31), D(2024, 5, 1)), _fact(120.0, "CY2025Q1"),
        _fact(999.0, None, end=D(2025, 6, 30)), _fact(24.0, "CY2025Q1", tag="NetIncomeLoss"),
    ]
    got = _growth(spark, rows)
    assert got["A"].revenue_growth_yoy == pytest.approx(0.2) and got["A"].profit_margin == pytest.approx(0.2)
    assert got["A"].comparison_frame == "CY2024Q1" and got["A"].quality_note == ""
    assert got["Z"].quality_note == "no SEC-framed standalone quarterly revenue" and not got["Z"].revenue_growth_available


def test_unusual_margin_is_flagged_not_capped(spark):
    got = _growth(spark, [_fact(120.0, "CY2025Q1"), _fact(114.0, "CY2025Q1", tag="NetIncomeLoss")])["A"]
    assert got.profit_margin == pytest.approx(0.95) and got.unusual_margin_flag
    assert got.quality_note.startswith("same-quarter prior-year") and got.quality_note.endswith("review source fact")


def test_quarter_priority(spark):
    rows = [
        _fact(1.0, "CY2025Q1", tag="SalesRevenueNet", filed=D(2025, 9, 1)), _fact(2.0, "CY2025Q1", filed=D(2025, 5, 1)),
        _fact(3.0, "CY2025Q1", filed=D(2025, 6, 1), seq=1), _fact(4.0, "CY2025Q1", filed=D(2025, 6, 1), seq=2), _fact(9.0, "CY2025Q1", form="10-K/A"),
    ]
    assert filings.quarterly_facts(spark.createDataFrame(rows, FACT), REVENUE_TAGS).first().val == 3.0


# ---- transform, scores, labels -----------------------------------------------------------------


def test_winsorise(spark):
    rows = [(f"S{i:02}", False, float(i)) for i in range(20)] + [("MKT", True, 500.0)]
    df = spark.createDataFrame(rows, "symbol string, is_benchmark boolean, x double").withColumn("empty", F.lit(None).cast("double"))
    out = {r.symbol: r for r in transform.winsorize(df, ["x", "empty"]).collect()}
    assert out["S19"].x_winsorized == pytest.approx(18.05) and out["S19"].x_outlier_flag and out["S19"].x == 19
    assert out["MKT"].x_winsorized is None and not out["MKT"].x_outlier_flag and out["S05"].empty_winsorized is None
    bounds = {r.feature: r for r in transform.winsor_bounds(df, ["x", "empty"]).collect()}
    assert bounds["x"].upper_capped_count == 1 and bounds["empty"].lower_bound is None
    with pytest.raises(ValueError):
        transform.winsorize(df, ["x"], 0.9, 0.1)


def test_pe_validity(spark):
    rows = [("a", "-8", "2"), ("b", "0", "2"), ("c", "20", "0"), ("d", "20", "-3"), ("e", "N/A", "2"), ("f", "20", "2")]
    df = spark.createDataFrame(rows, "symbol string, PERatio string, EPS string")
    wanted = df.select("symbol").unionByName(spark.createDataFrame([("g",)], "symbol string"))
    got = {r.symbol: (r.pe_exclusion_reason, r.pe_ratio) for r in transform.provider_valuation(wanted, df).collect()}
    assert got == {
        "a": ("provider P/E nonpositive", None), "b": ("provider P/E nonpositive", None), "c": ("provider EPS nonpositive", None),
        "d": ("provider EPS nonpositive", None), "e": ("provider P/E missing", None), "f": ("", 20.0), "g": ("provider overview missing", None),
    }


def test_percentiles(spark):
    df = spark.createDataFrame([("t", 1.0), ("t", 1.0), ("t", 3.0), ("t", 4.0), ("n", 10.0), ("n", 20.0), ("n", None), ("n", 30.0)], "g string, value double")
    got = sorted((r.g, r.value if r.value is not None else -1, r.percentile, r.rank_position, r.eligible_count) for r in scoring.percentile_ranks(df, ["g"]).collect())
    assert got[0][2:] == (None, None, None) and [g[2] for g in got[1:4]] == pytest.approx([100 / 3, 200 / 3, 100]) and got[1][4] == 3
    assert [g[2] for g in got[4:]] == [37.5, 37.5, 75, 100] and got[4][3] == 1.5


def test_weighted_score(spark):
    df = spark.createDataFrame([(80.0, None, 60.0)], "a double, b double, c double")
    score, cover = scoring.weighted_score({"a": 0.4, "b": 0.4, "c": 0.2}, require_all=False)
    strict, _ = scoring.weighted_score({"a": 0.4, "b": 0.4, "c": 0.2})
    got = df.select(score.alias("s"), cover.alias("c"), strict.alias("x")).first()
    assert got.s == pytest.approx(220 / 3) and got.c == pytest.approx(0.6) and got.x is None
    with pytest.raises(ValueError):
        scoring.weighted_score({"a": 0.5})


SCORES = "symbol string, momentum_21d_score double, momentum_63d_score double, momentum_126d_score double, growth_score double, profitability_score double, valuation_score double"


def test_composite_and_labels(spark):
    rows = [("A", 90.0, 80.0, 70.0, 60.0, 80.0, 50.0), ("B", 90.0, 80.0, 70.0, None, 80.0, 50.0), ("C", 90.0, 80.0, 70.0, 60.0, 80.0, None), ("D", None, None, None, None, None, None)]
    out = {r.symbol: r for r in scoring.add_labels(scoring.composite_scores(spark.createDataFrame(rows, SCORES))).collect()}
    a = out["A"]
    assert (a.momentum_subscore, a.quality_subscore, a.composite_score) == (pytest.approx(78), 70, pytest.approx(69.2))
    assert a.overall_display_label == "Positive" and not a.incomplete_score_flag
    assert out["B"].score_coverage == pytest.approx(0.6) and not out["B"].score_eligible and out["B"].score_rank is None
    assert out["B"].overall_display_label == "Positive (Incomplete: 60% coverage)" and out["B"].signal_note.startswith("Below minimum")
    assert out["C"].score_eligible and out["C"].score_rank == 1 and a.score_rank == 2
    assert out["D"].overall_display_label == "Unavailable" and out["D"].composite_score is None


# ---- statistics --------------------------------------------------------------------------------


def test_missing_report(spark):
    rows = [("A", False, 100.0), ("B", False, None), ("MKT", True, None)]
    df = spark.createDataFrame(rows, "symbol string, is_benchmark boolean, revenue double")
    r = statistics.missing_report(df).first()
    assert (r.eligible_rows, r.missing_count, r.missing_rate, r.benchmark_not_applicable) == (2, 1, 0.5, True)
    assert statistics.missing_report(df).count() == len({r.feature for r in statistics.missing_report(df).collect()})
    assert [x.symbol for x in statistics.missing_by_symbol(df).collect()] == ["B"]


def test_long_symbol_lists_continue_in_blocks(spark):
    df = spark.range(2500).selectExpr("'f' AS feature", "format_string('S%05d', id) AS symbol")
    parts = statistics.listed_in_blocks(df, ["feature"], "symbol", "symbols").orderBy("list_part").collect()
    assert [len(p.symbols.split(",")) for p in parts] == [1000, 1000, 500]
    assert ",".join(p.symbols for p in parts).split(",") == [f"S{i:05}" for i in range(2500)]


def test_correlations(spark):
    rows = [(1.0, 2.0, 1.0, 7.0), (2.0, 4.0, None, 7.0), (3.0, 6.0, 2.0, 7.0), (4.0, 8.0, 0.0, 7.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    pairs = {(r.feature_1, r.feature_2): r for r in statistics.ranked_pairs(df, {"a": "a", "b": "b", "c": "c", "k": "k"}).collect()}
    assert pairs["a", "b"].correlation == pytest.approx(1) and pairs["a", "c"].pairwise_observations == 3
    assert pairs["a", "k"].correlation is None
    m = {r.feature: r for r in statistics.correlation_matrix(df, {"a": "a", "b": "b"}).collect()}
    assert m["a"].a == pytest.approx(1) and m["b"].a == pytest.approx(1)


def test_distribution(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (1.0, 2.0), (10.0, 2.0), (None, 2.0)], "x double, k double")
    got = {r.feature: r for r in statistics.distribution_statistics(df, ["x", "k"]).collect()}
    assert got["x"].available_count == 4 and got["x"].missing_rate == pytest.approx(0.2)
    assert got["x"].skewness == pytest.approx(2.0) and got["x"].strong_skew_flag and got["k"].skewness == 0


# ---- research, screening, explanation, portfolio -----------------------------------------------


def test_research_panel(spark):
    rows = [(f"S{i:02}", d, 100 * (1 + 0.0003 + i * 0.00008) ** k) for i in range(20) for k, d in enumerate(days(110))]
    obs = research.momentum_observations(spark.createDataFrame(rows, "symbol string, date date, adjusted_close double"), "MKT").cache()
    per = obs.groupBy("date", "quintile").count()
    assert per.where("count <> 4").count() == 0 and obs.select("date").distinct().count() == 110 - 63 - 21
    spread = research.spread_by_date(obs)
    assert spread.where("top_minus_bottom <= 0").count() == 0
    summary = research.quintile_summary(obs).orderBy("quintile").collect()
    assert [r.observations for r in summary] == [104] * 5 and all(r.hit_rate == 1 for r in summary)
    assert research.momentum_observations(spark.createDataFrame(rows[:110 * 9], "symbol string, date date, adjusted_close double"), "MKT").count() == 0


SCREEN = "symbol string, company_name string, rsi_14 double, volatility_pct double, trend_above_sma50 boolean, momentum_63d_raw_pct double, pe_ratio_raw double, overall_label string, composite_score double, signal string"


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        ("AAA", "Alpha", 55.0, 20.0, True, 12.0, 30.0, "Strong", 85.0, "Bullish"), ("BBB", None, 45.0, 30.0, False, -3.0, None, "Weak", 30.0, "Bearish"),
        ("CCC", "a.b(c", None, 30.0, False, 5.0, 10.0, None, None, "Neutral"), ("SPY", "Index", 50.0, 10.0, True, 4.0, None, None, None, "Neutral"),
    ]
    return spark.createDataFrame(data, SCREEN).cache()


def _names(df):
    return [r.symbol for r in df.orderBy("symbol").collect()]


def test_screen(rows):
    assert _names(screening.screen(rows)) == ["AAA", "BBB", "SPY"]
    assert _names(screening.screen(rows, search=" ALPH ")) == ["AAA"]
    assert _names(screening.screen(rows, numeric_filters={"pe_ratio_raw": ("<=", 35.0)})) == ["AAA"]
    assert _names(screening.screen(rows, labels=[])) == [] and _names(screening.screen(rows, labels=["Weak"])) == ["BBB"]
    assert _names(screening.screen(rows, trend="Below SMA 50", include_benchmark=False)) == ["BBB"]
    assert [r.symbol for r in screening.screen(rows, sort_by="composite_score").collect()] == ["AAA", "BBB", "SPY"]
    for bad in ({"numeric_filters": {"nope": (">=", 1.0)}}, {"numeric_filters": {"rsi_14": ("==", 1.0)}}, {"sort_by": "nope"}):
        with pytest.raises(ValueError):
            screening.screen(rows, **bad)
    assert _names(screening.screen_any_label(rows)) == ["AAA", "BBB", "CCC"]
    assert _names(screening.screen_any_label(rows, search="b(c")) == ["CCC"]


def test_signal_maps_and_kpis(rows):
    assert tuple(screening.signal_map_counts(rows).first()) == (1, 3)
    quad = {r.symbol: r for r in screening.quadrant_map(rows).collect()}
    assert quad["AAA"].quadrant == "higher P/E, stronger RSI" and quad["CCC"].reasons == "RSI N/A" and quad["AAA"].pe_axis_cap == 50
    none = screening.quadrant_map(rows.where("symbol = 'BBB'")).first()
    assert none.pe_divider == 25 and none.reasons == "P/E not meaningful"
    kpi = screening.screener_kpis(screening.screen(rows, include_benchmark=False), rows).first()
    assert (kpi.rows_shown, kpi.universe, kpi.bullish, kpi.median_rsi) == (2, 3, 1, 50.0)
    empty = screening.screener_kpis(rows.where("false"), rows).first()
    assert empty.rows_shown == 0 and empty.median_rsi is None


def test_market_breadth(rows):
    df = rows.withColumn("daily_return_pct", F.lit(1.0))
    b = screening.market_breadth(df).first()
    assert (b.stocks, b.positive_momentum, b.beating_benchmark, b.favorable_labels, b.regime) == (3, 2, 2, 1, "UPTREND")


def test_peers_and_evidence(rows, spark):
    got = {r.symbol: r for r in explain.peer_percentiles(rows, ["volatility_pct"]).collect()}
    assert got["AAA"].peer_percentile == pytest.approx(100 / 3) and got["SPY"].peer_percentile == 0 and got["SPY"].band == "low"
    one = spark.createDataFrame([("A", "Strong", "Weak", None, 1.8, 0.8, None)], "symbol string, momentum_label string, fundamentals_label string, valuation_label string, beta_252_raw double, score_coverage double, overall_display_label string")
    e = explain.evidence_lists(one).first()
    assert e.strengths == ["Momentum: Strong"] and e.cautions == ["Fundamentals: Weak", "Beta 1.80: historically more market-sensitive than the benchmark"]
    assert e.data_gaps == ["Valuation score unavailable", "Composite score uses only 80% of intended component weight"] and e.overall == "Unavailable"


def test_portfolio(spark):
    alloc = spark.createDataFrame([("o", "A", 100.0), ("o", "B", 50.0), ("o", "C", 10.0)], "owner string, symbol string, amount double")
    prices = spark.createDataFrame([("A", 10.0, 12.0), ("B", 5.0, 4.0), ("C", None, 3.0)], "symbol string, price double, next_price double")
    cash = spark.createDataFrame([("o", 200.0)], "owner string, cash double")
    moves = portfolio.mark_to_market(alloc, prices)
    got = portfolio.worth(moves, cash).first()
    assert (got.cash_left, got.worth_before, got.worth_after) == (40, 190, 200) and (got.best_symbol, got.worst_symbol) == ("A", "B")


def test_lookahead_audit(spark):
    df = spark.createDataFrame([("A", D(2024, 1, 5))], "symbol string, date date")
    f = spark.createDataFrame([(D(2024, 2, 1), D(2024, 1, 1))], "assets_filed date, assets_period_end date")
    bad = audit.lookahead_audit(df, df, f)
    assert {(r.column_name, r.violations) for r in bad.collect()} == {("date", 0), ("assets_filed", 1), ("assets_period_end", 0)}
    with pytest.raises(keys.DataQualityError):
        audit.assert_no_lookahead(bad)


def test_first_and_latest(spark):
    df = series(spark, [1, 2, 3]).unionByName(series(spark, [5], "B"))
    assert {(r.symbol, r.close) for r in snapshot.latest_per_symbol(df).collect()} == {("A", 3.0), ("B", 5.0)}
    assert {(r.symbol, r.close) for r in snapshot.first_per_symbol(df).collect()} == {("A", 1.0), ("B", 5.0)}
