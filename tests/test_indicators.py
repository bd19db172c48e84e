import math

import numpy as np
import pandas as pd
import pytest
from helpers import column, series

from tickerloom.operators import indicators as ind


def test_returns_golden_and_symbol_isolation(spark):
    df = series(spark, [10, 11]).unionByName(series(spark, [20, 18], "B"))
    out = ind.add_returns(df)
    assert column(out, "simple_return", "A") == [None, pytest.approx(0.1)]
    assert column(out, "simple_return", "B") == [None, pytest.approx(-0.1)]
    assert column(out, "log_return", "A")[1] == pytest.approx(math.log(1.1))


def test_returns_with_gap_are_not_filled(spark):
    out = column(ind.add_returns(series(spark, [100, None, 110, 121])), "simple_return")
    assert out[:3] == [None, None, None] and out[3] == pytest.approx(0.1)


def test_nonpositive_close_fails(spark):
    with pytest.raises(Exception, match="strictly positive"):
        ind.add_returns(series(spark, [1, 0, 2])).collect()


def test_moving_averages_and_warm_up(spark):
    out = ind.add_ema(ind.add_simple_averages(series(spark, range(1, 56)))).cache()
    sma20, sma50, ema = column(out, "sma_20"), column(out, "sma_50"), column(out, "ema_20")
    assert sma20[:19] == [None] * 19 and sma20[19] == pytest.approx(10.5)
    assert sma50[:49] == [None] * 49 and sma50[49] == pytest.approx(25.5)
    assert ema[:19] == [None] * 19
    expected = pd.Series(range(1, 56), dtype=float).ewm(span=20, adjust=False, min_periods=20).mean()
    assert ema[19:] == pytest.approx(list(expected[19:]), rel=1e-12)


def test_ema_discounts_history_over_gaps(spark):
    rng = np.random.default_rng(3)
    values = list(rng.uniform(50, 150, 120))
    for i in (0, 30, 31, 70):
        values[i] = None
    expected = pd.Series(values, dtype=float).ewm(span=20, adjust=False, min_periods=20).mean()
    out = column(ind.add_ema(series(spark, values)), "ema_20")
    for got, want in zip(out, expected):
        assert (got is None) == math.isnan(want)
        if got is not None:
            assert got == pytest.approx(want, rel=1e-12)


def test_recurrence_over_long_series(spark):
    rng = np.random.default_rng(5)
    values = rng.uniform(50, 150, 12000)
    out = column(ind.add_ema(series(spark, values)), "ema_20")
    expected = pd.Series(values).ewm(span=20, adjust=False, min_periods=20).mean()
    assert np.allclose(np.array(out[19:], float), expected[19:], rtol=1e-12, atol=0)


WILDER = [54.8, 56.8, 57.85, 59.85, 60.57, 61.1, 62.17, 60.6, 62.35, 62.15, 62.35, 61.45, 62.8, 61.37, 62.5]


def test_rsi_golden(spark):
    out = column(ind.add_rsi(series(spark, WILDER)), "rsi_14")
    assert out[:14] == [None] * 14
    assert out[14] == pytest.approx(74.21383647798743, abs=1e-10)


@pytest.mark.parametrize("values,expected", [(range(1, 17), 100.0), (range(16, 0, -1), 0.0), ([5] * 16, 50.0)])
def test_rsi_edges(spark, values, expected):
    assert column(ind.add_rsi(series(spark, values)), "rsi_14")[-1] == expected


def test_rsi_short_series_and_gap(spark):
    assert column(ind.add_rsi(series(spark, range(1, 15))), "rsi_14") == [None] * 14
    values = WILDER + [63.0, None, 64.0, 65.0]
    out = column(ind.add_rsi(series(spark, values)), "rsi_14")
    assert out[15] is not None and out[16:] == [None, None, None]


def test_risk_features(spark):
    out = ind.add_risk(series(spark, [100, 120, 90, 80, 121]))
    drawdown, worst = column(out, "drawdown"), column(out, "max_drawdown_to_date")
    assert drawdown[-1] == 0 and worst[-1] == pytest.approx(80 / 120 - 1)
    gap = column(ind.add_risk(series(spark, [100, None, 90])), "max_drawdown_to_date")
    assert gap[1] is None and gap[2] == pytest.approx(-0.1)
    flat = column(ind.add_risk(series(spark, [7] * 30)), "volatility_20d_annualized")
    assert flat[:20] == [None] * 20 and flat[20] == 0
    with pytest.raises(ValueError):
        ind.add_risk(series(spark, [1, 2]), window=1)


def test_momentum(spark):
    out = ind.add_momentum(series(spark, range(1, 131))).cache()
    m = column(out, "momentum_21d")
    assert m[:21] == [None] * 21 and m[21] == pytest.approx(22 / 1 - 1)
    assert column(out, "momentum_126d_n_obs")[125:128] == [125, 126, 126]
    with pytest.raises(ValueError):
        ind.add_momentum(out, ())


def test_null_counts_of_the_full_chain(spark):
    rng = np.random.default_rng(1)
    df = series(spark, rng.uniform(10, 20, 60)).unionByName(series(spark, rng.uniform(10, 20, 60), "B"))
    out = ind.add_all(df).toPandas()
    counts = out.isna().sum()
    expected = {"simple_return": 1, "sma_20": 19, "sma_50": 49, "ema_20": 19, "rsi_14": 14, "volatility_20d_annualized": 20}
    for name, n in expected.items():
        assert counts[name] == 2 * n, name
    assert out["rsi_14"].dropna().between(0, 100).all() and out["drawdown"].between(-1, 0).all()


def test_full_chain_plan_has_one_shuffle_and_no_python(spark):
    plan = ind.add_all(series(spark, range(1, 60)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1
    assert "SinglePartition" not in plan and "Python" not in plan


def test_repeated_days_fail(spark):
    df = series(spark, range(1, 30))
    with pytest.raises(Exception, match="duplicate symbol/date keys: A"):
        ind.add_momentum(df.unionByName(df)).collect()


def test_momentum_looks_up_the_day_and_the_number_of_a_row_once(spark):
    out = ind.add_momentum(series(spark, [10, 11, None, 12, 15]), (1, 3))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number()") == 1 and plan.count("lag(date") == 1 and plan.count("Window [") == 1
    assert column(out, "momentum_1d") == [None, pytest.approx(0.1), None, None, pytest.approx(0.25)]
    assert column(out, "momentum_3d") == [None, None, None, pytest.approx(0.2), pytest.approx(15 / 11 - 1)]
    assert column(out, "momentum_3d_n_obs") == [0, 1, 2, 3, 3]
    assert out.columns == ["symbol", "date", "close", "momentum_1d", "momentum_1d_n_obs", "momentum_3d", "momentum_3d_n_obs"]


def test_indicators_order_rows_once_and_again_for_each_recurrence(spark):
    bars = series(spark, range(1, 60))
    plan = ind.add_all(bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [symbol") == 3
    one_by_one = ind.add_momentum(ind.add_risk(ind.add_rsi(ind.add_ema(ind.add_simple_averages(ind.add_returns(bars))))))
    assert ind.add_all(bars).columns == one_by_one.columns
    assert ind.add_all(bars).orderBy("date").collect() == one_by_one.orderBy("date").collect()


@pytest.mark.parametrize("windows", [(20, 50), (3, 7), (4,)])
def test_averages_add_a_price_once_a_block(spark, windows):
    rng = np.random.default_rng(11)
    values = list(rng.uniform(50, 150, 160))
    for i in (5, 6, 90, 131):
        values[i] = None
    values[40] = 1e12  # leaves no trace once it is out of the window
    out = ind.add_simple_averages(series(spark, values), windows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f"RowFrame, -{max(windows) - 1}, currentrow" not in plan or len(windows) == 1
    for n in windows:
        got, seen = column(out, f"sma_{n}"), pd.Series(values, dtype=float)
        for i in range(len(values)):
            part = seen[max(0, i - n + 1) : i + 1]
            want = None if len(part) < n or part.isna().any() else part.mean()
            assert got[i] == (want if want is None else pytest.approx(want, rel=1e-12))
    assert out.columns == ["symbol", "date", "close", *[f"sma_{n}" for n in windows]]
