"""Per-symbol indicators over daily bars.

Every function takes one row per (symbol, day); a symbol's window therefore holds at most one row
per calendar day, whatever the size of the panel. All windows share one partitioning and one order,
so a chain of these functions costs a single exchange on the symbol. Missing values are never filled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.constants import MOMENTUM_PERIODS, TRADING_DAYS
from tickerloom.operators.keys import require_columns
from tickerloom.operators.recurrence import linear_recurrence


def by_symbol() -> WindowSpec:
    return W.partitionBy("symbol").orderBy("date")


def last_rows(n: int) -> WindowSpec:
    return by_symbol().rowsBetween(-(n - 1), 0)


def so_far() -> WindowSpec:
    return by_symbol().rowsBetween(W.unboundedPreceding, 0)


def _full_window(value: Column, n: int, result: Column) -> Column:
    """``result`` only where all of the last ``n`` values are present."""
    return F.when(F.count(value).over(last_rows(n)) == n, result)


def _change(value: Column, n: int) -> Column:
    return F.try_divide(value, F.lag(value, n).over(by_symbol())) - 1


def positive(value: Column, what: str) -> Column:
    """The value itself; the job fails on a value at or below zero. Null passes."""
    return F.when(value <= 0, F.raise_error(F.lit(f"{what} must be strictly positive")).cast("double")).otherwise(value)


def repeated_day() -> Column:
    """A second row of the same symbol and day."""
    return F.lag("date", 1).over(by_symbol()) == F.col("date")


def once_per_day(value: Column, what: str, repeated: Column | None = None) -> Column:
    """The value itself; a second row of the same symbol and day fails the job. Uses the window that
    the indicators need anyway, so the check costs no exchange. ``repeated`` is a column that knows already."""
    repeated = repeated_day() if repeated is None else repeated
    error = F.raise_error(F.concat(F.lit(f"{what} contains duplicate symbol/date keys: "), F.col("symbol")))
    return F.when(repeated, error.cast("double")).otherwise(value)


def _returns(close: str) -> dict[str, Column]:
    price = F.col(close)
    return {
        "simple_return": once_per_day(_change(price, 1), "returns input"),
        "log_return": F.ln(price) - F.ln(F.lag(price, 1).over(by_symbol())),
    }


def add_returns(bars: DataFrame, close: str = "close") -> DataFrame:
    require_columns(bars, ["symbol", "date", close], "returns input")
    return bars.withColumn(close, positive(F.col(close), close)).withColumns(_returns(close))


def _average_blocks(windows: Sequence[int], close: str) -> dict[str, Column]:
    """First pass of the averages: sum and number of the prices of the last rows, as many as divide every window."""
    price, block = F.col(close), last_rows(math.gcd(*windows))
    return {"_block_sum": F.sum(price).over(block), "_block_n": once_per_day(F.count(price).over(block), "moving-average input")}


def _simple_averages(windows: Sequence[int]) -> dict[str, Column]:
    """Second pass: a window is the block that ends here and those that end whole blocks before, so a price is not added
    again for every row of a long window, and nothing is subtracted. Before the first full window a block is absent."""
    block = math.gcd(*windows)

    def total(column: str, n: int) -> Column:
        ended = [F.lag(column, at).over(by_symbol()) for at in range(block, n, block)]
        return sum(ended, F.col(column))

    return {f"sma_{n}": F.when(total("_block_n", n) == n, total("_block_sum", n) / n) for n in windows}


def add_simple_averages(bars: DataFrame, windows: Sequence[int] = (20, 50), close: str = "close") -> DataFrame:
    require_columns(bars, ["symbol", "date", close], "moving-average input")
    return bars.withColumns(_average_blocks(windows, close)).withColumns(_simple_averages(windows)).drop("_block_sum", "_block_n")


def _ema_rows(close: str) -> dict[str, Column]:
    """First pass of the exponential average: each row's number, that of the price before it, prices seen."""
    price = F.col(close)
    row = F.row_number().over(by_symbol())
    before = by_symbol().rowsBetween(W.unboundedPreceding, -1)
    return {
        "_row": row,
        "_prev": F.last(F.when(price.isNotNull(), row), ignorenulls=True).over(before),
        "_seen": once_per_day(F.count(price).over(so_far()).cast("double"), "moving-average input"),
    }


def _ema_keep(span: int, close: str) -> Column:
    alpha = 2.0 / (span + 1.0)
    held = F.pow(F.lit(1.0 - alpha), (F.col("_row") - F.col("_prev")).cast("double"))
    return F.when(F.col(close).isNotNull() & F.col("_prev").isNotNull(), held / (held + alpha))


def _ema_steps(span: int, close: str) -> dict[str, Column]:
    """Second pass: what a price adds and how far older ones have decayed."""
    price, alpha = F.col(close), 2.0 / (span + 1.0)
    # Rows without a gap before them all decay alike: counting them is exact, summing logs is not.
    regular = (F.col("_row") - F.col("_prev")) == 1
    steps = F.count(F.when(F.col("_keep").isNotNull() & regular, 1)).over(so_far())
    gaps = F.coalesce(F.sum(F.when(~regular, F.ln("_keep"))).over(so_far()), F.lit(0.0))
    return {
        "_impulse": F.when(price.isNotNull() & F.col("_prev").isNull(), price).when(
            price.isNotNull(), price * (1 - F.col("_keep"))
        ),
        "_ema_decay": steps * F.lit(math.log(1.0 - alpha)) + gaps,
    }


def _ema(df: DataFrame, span: int) -> DataFrame:
    df = linear_recurrence(df, ["symbol"], "date", {"_ema": "_impulse"}, "_ema_decay")
    return df.withColumn(f"ema_{span}", F.when(F.col("_seen") >= span, F.col("_ema"))).drop(
        "_row", "_prev", "_seen", "_keep", "_impulse", "_ema_decay", "_ema"
    )


def add_ema(bars: DataFrame, span: int = 20, close: str = "close") -> DataFrame:
    """Exponential average seeded with the first price, shown once ``span`` prices have been seen.

    After a gap the older average is discounted by the number of rows skipped, and the rows of the
    gap repeat it.
    """
    require_columns(bars, ["symbol", "date", close], "moving-average input")
    rows = bars.withColumns(_ema_rows(close)).withColumn("_keep", _ema_keep(span, close))
    return _ema(rows.withColumns(_ema_steps(span, close)), span)


def _rsi_rows(close: str) -> dict[str, Column]:
    """First pass of the strength index: moves, and how many rows came before."""
    w = by_symbol()
    move = F.col(close) - F.lag(close, 1).over(w)
    return {"_move": once_per_day(move, "RSI input"), "_at": F.row_number().over(w) - 1}


def _rsi_moves() -> dict[str, Column]:
    return {"_gain": F.greatest(F.col("_move"), F.lit(0.0)), "_loss": F.greatest(-F.col("_move"), F.lit(0.0))}


def _rsi_steps(period: int) -> dict[str, Column]:
    """Second pass: what a move adds to the averages and how far older ones have decayed."""
    first_moves = so_far()
    start = F.col("_at") == period
    later = F.col("_at") > period

    def impulse(column: str) -> Column:
        # The first row has no move and counts as zero, so the running sum is that of the first moves.
        return F.when(start, F.sum(column).over(first_moves) / period).when(later, F.col(column) / period)

    # "no gain" and "no loss" are decided by counting moves: a smoothed sum is never exactly zero.
    return {
        "_known": F.count("_move").over(first_moves) == F.col("_at"),
        "_ug": impulse("_gain"),
        "_ul": impulse("_loss"),
        "_rsi_decay": F.col("_at") * F.lit(math.log((period - 1) / period) if period > 1 else -700.0),
        "_up": F.count(F.when(F.col("_gain") > 0, 1)).over(first_moves) > 0,
        "_down": F.count(F.when(F.col("_loss") > 0, 1)).over(first_moves) > 0,
    }


def _rsi(df: DataFrame, period: int) -> DataFrame:
    df = linear_recurrence(df, ["symbol"], "date", {"_avg_gain": "_ug", "_avg_loss": "_ul"}, "_rsi_decay")
    gain, loss = F.col("_avg_gain"), F.col("_avg_loss")
    rsi = (
        F.when(~F.col("_known") | (F.col("_at") < period), None)
        .when(~F.col("_up") & ~F.col("_down"), 50.0)
        .when(~F.col("_down"), 100.0)
        .when(~F.col("_up"), 0.0)
        .otherwise(100.0 - 100.0 / (1.0 + gain / loss))
    )
    return df.withColumn(f"rsi_{period}", rsi).drop(
        "_move", "_at", "_gain", "_loss", "_known", "_ug", "_ul", "_rsi_decay", "_avg_gain", "_avg_loss", "_up", "_down"
    )


def add_rsi(bars: DataFrame, period: int = 14, close: str = "close") -> DataFrame:
    """Wilder's relative strength: simple average of the first ``period`` moves, then smoothing.

    A missing close spoils every later value of its symbol, as there is no defined move to smooth.
    """
    if period < 1:
        raise ValueError("RSI period must be positive")
    require_columns(bars, ["symbol", "date", close], "RSI input")
    return _rsi(bars.withColumns(_rsi_rows(close)).withColumns(_rsi_moves()).withColumns(_rsi_steps(period)), period)


def _volatility(window: int, trading_days: int) -> dict[str, Column]:
    r = F.col("log_return")
    spread = F.stddev_samp(r).over(last_rows(window)) * F.lit(math.sqrt(trading_days))
    return {f"volatility_{window}d_annualized": once_per_day(_full_window(r, window, spread), "risk input")}


def _drawdown(close: str) -> dict[str, Column]:
    return {"drawdown": F.col(close) / F.max(close).over(so_far()) - 1}


def _worst_drawdown() -> dict[str, Column]:
    return {"max_drawdown_to_date": F.when(F.col("drawdown").isNotNull(), F.min("drawdown").over(so_far()))}


def add_risk(bars: DataFrame, window: int = 20, trading_days: int = TRADING_DAYS, close: str = "close") -> DataFrame:
    """Annualised volatility of log returns, drawdown, and the worst drawdown so far."""
    if window < 2 or trading_days < 1:
        raise ValueError("window must be at least 2 and trading_days positive")
    require_columns(bars, ["symbol", "date", close], "risk input")
    if "log_return" not in bars.columns:
        bars = bars.withColumn("log_return", F.ln(close) - F.ln(F.lag(close, 1).over(by_symbol())))
    return bars.withColumns(_volatility(window, trading_days) | _drawdown(close)).withColumns(_worst_drawdown())


def _momentum_rows(periods: Sequence[int], close: str) -> dict[str, Column]:
    """What momentum reads of the rows before."""
    return {"_repeated": repeated_day(), "_row": F.row_number().over(by_symbol())} | {
        f"_before_{n}": F.lag(close, n).over(by_symbol()) for n in periods
    }


def _momentum(periods: Sequence[int], close: str, rows: dict[str, Column] | None = None) -> dict[str, Column]:
    """``rows`` are the columns that hold what was read of the rows before, where that is done already."""
    rows = rows or _momentum_rows(periods, close)
    columns: dict[str, Column] = {}
    for n in periods:
        change = F.try_divide(close, rows[f"_before_{n}"]) - 1
        columns[f"momentum_{n}d"] = once_per_day(change, "momentum input", rows["_repeated"])
        columns[f"momentum_{n}d_n_obs"] = F.least(rows["_row"] - 1, F.lit(n)).cast("long")
    return columns


def add_momentum(bars: DataFrame, periods: Sequence[int] = MOMENTUM_PERIODS, close: str = "close") -> DataFrame:
    """Price change over ``n`` observations, and how many of them were available. The day's check and a row's number
    are looked up once for all periods."""
    if not periods or any(n < 1 for n in periods):
        raise ValueError("momentum periods must be positive integers")
    require_columns(bars, ["symbol", "date", close], "momentum input")
    rows = _momentum_rows(periods, close)
    return bars.withColumns(rows).withColumns(_momentum(periods, close, {c: F.col(c) for c in rows})).drop(*rows)


def add_forward_return(bars: DataFrame, window: int = 21, price: str = "adjusted_close") -> DataFrame:
    """Outcome column: change to the price ``window`` observations later."""
    ahead = F.lead(price, window).over(by_symbol())
    return bars.withColumn(f"forward_return_{window}d", F.try_divide(ahead, F.col(price)) - 1)


def add_all(bars: DataFrame) -> DataFrame:
    """Every indicator, over one shared exchange on the symbol: the same columns as the functions above give one after the
    other, but rows are ordered once for all first and second passes together and once for each recurrence."""
    require_columns(bars, ["symbol", "date", "close"], "indicator input")
    first = _returns("close") | _average_blocks((20, 50), "close") | _ema_rows("close") | _rsi_rows("close") | _drawdown("close")
    second = _simple_averages((20, 50)) | _ema_steps(20, "close") | _rsi_steps(14) | _volatility(20, TRADING_DAYS) | _worst_drawdown()
    rows = bars.withColumn("close", positive(F.col("close"), "close")).withColumns(first | _momentum(MOMENTUM_PERIODS, "close"))
    steps = rows.withColumns({"_keep": _ema_keep(20, "close")} | _rsi_moves()).withColumns(second)
    added = [
        *_returns("close"), "sma_20", "sma_50", "ema_20", "rsi_14", *_volatility(20, TRADING_DAYS), "drawdown", "max_drawdown_to_date",
        *_momentum(MOMENTUM_PERIODS, "close"),
    ]
    return _rsi(_ema(steps, 20), 14).select(*bars.columns, *[c for c in added if c not in bars.columns])
