"""Benchmark alignment, rolling beta and indexed comparison."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.constants import BETA_WINDOWS, TIMEFRAME_MONTHS
from tickerloom.functions.scalars import symbol_text
from tickerloom.operators.indicators import by_symbol, last_rows, once_per_day, positive, repeated_day, so_far
from tickerloom.operators.keys import DataQualityError, keyed, one_row_each, require_columns

RETURNS = ["simple_return", "log_return"]


def _one_row_per_day(series: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One benchmark row per calendar day, by construction: some 36,525 rows per century, so the
    result can be broadcast whatever the size of its input. A repeated day fails the job."""
    single = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("benchmark contains duplicate dates")).cast("boolean"))
    return F.broadcast(
        series.groupBy("date")
        .agg(*[F.max(c).alias(c) for c in columns], single.alias("_single"))
        .where(F.col("_single").isNull())
        .drop("_single")
    )


def extract_benchmark(features: DataFrame, benchmark: str) -> DataFrame:
    columns = ["date", "symbol", "close", "simple_return", "log_return", "provider"]
    require_columns(features, columns, "feature panel")
    return features.where(F.upper("symbol") == benchmark.upper()).select(columns).withColumns(
        {"symbol": F.upper("symbol"), "provider": F.lower("provider")}
    )


def return_mismatches(series: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Recompute both returns from the close: rows, duplicates, bad closes and mismatches per symbol."""
    w = by_symbol()
    expected = {
        "simple_return": F.col("close") / F.lag("close").over(w) - 1,
        "log_return": F.ln("close") - F.ln(F.lag("close").over(w)),
    }
    df = series.withColumns({f"_{c}": e for c, e in expected.items()})

    def off(c: str) -> Column:
        close_enough = F.abs(F.col(c) - F.col(f"_{c}")) <= F.lit(atol) + F.lit(rtol) * F.abs(F.col(f"_{c}"))
        both_null = F.col(c).isNull() & F.col(f"_{c}").isNull()
        return F.count_if(~(both_null | F.coalesce(close_enough, F.lit(False)))).alias(f"{c}_mismatches")

    per_symbol = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("simple_return").alias("return_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_if(F.col("close").isNull() | (F.col("close") <= 0)).alias("bad_close_rows"),
        (F.count(F.lit(1)) - F.count_distinct("date")).alias("duplicate_dates"),
        off("simple_return"),
        off("log_return"),
    )
    return per_symbol


def assert_returns(series: DataFrame) -> None:
    bad = return_mismatches(series).where(
        "bad_close_rows + duplicate_dates + simple_return_mismatches + log_return_mismatches > 0"
    ).take(3)
    if bad:
        raise DataQualityError(f"stored returns do not follow from the closes: {[r.asDict() for r in bad]}")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("symbol", symbol_text(F.col("symbol")))


def _nothing_if_present(series: DataFrame, benchmark: str, like: DataFrame) -> DataFrame:
    """No rows, with the columns of ``like``; the job fails if the benchmark has no row in ``series``.

    A count over everything has a row even where nothing is, so the check runs before an empty join side is skipped.
    """
    there = _named(series).where(F.col("symbol") == benchmark.upper()).agg(F.count(F.lit(1)).alias("_n"))
    absent = F.raise_error(F.lit(f"benchmark {benchmark.upper()} is not in the series")).cast("boolean")
    none = there.where(F.when(F.col("_n") == 0, absent).otherwise(F.col("_n") < 0))
    # The join key is no null: rows with a null key would be dropped, and the check with them.
    values = {"date": F.lit("1970-01-01")}
    return none.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def align_returns(
    features: DataFrame, benchmark_rows: DataFrame, benchmark: str, tasks: int | None = None, tidy: bool = False
) -> DataFrame:
    """Inner join of every other symbol to the benchmark on the same day; no fill, no nearest match.

    Symbols are compared in upper case. A repeated day of a symbol or an absent benchmark fails the job. ``tasks`` fixes the
    number of tasks, those of later windows on the symbol too. ``tidy`` says that the symbols of ``features`` are in upper case
    and trimmed already: rows that are dealt out by symbol then stay where they lie.
    """
    for df, what in ((features, "stock features"), (benchmark_rows, "benchmark")):
        require_columns(df, ["date", "symbol", *RETURNS], what)
    named = features if tidy else _named(features)
    stocks = named.where(F.col("symbol") != benchmark.upper()).select("symbol", "date", *RETURNS).dropna(subset=RETURNS)
    stocks = keyed(stocks, tasks).withColumn("simple_return", once_per_day(F.col("simple_return"), "stock returns"))
    returns = _benchmark_returns(benchmark_rows, benchmark)
    return stocks.join(F.broadcast(returns.union(_nothing_if_present(benchmark_rows, benchmark, returns))), "date")


def _benchmark_returns(rows: DataFrame, benchmark: str) -> DataFrame:
    renamed = _named(rows).where(F.col("symbol") == benchmark.upper()).dropna(subset=RETURNS).select(
        "date", *[F.col(c).alias(f"benchmark_{c}") for c in RETURNS]
    )
    return _one_row_per_day(renamed, [f"benchmark_{c}" for c in RETURNS])


def alignment_audit(features: DataFrame, benchmark_rows: DataFrame, benchmark: str) -> DataFrame:
    """What the alignment kept and left out, per symbol; the benchmark's own days are never crossed
    with the symbols: its unmatched days are its valid days minus the matched ones."""
    valid = F.col("simple_return").isNotNull() & F.col("log_return").isNotNull()
    market = _benchmark_returns(benchmark_rows, benchmark).select("date", F.lit(True).alias("_in_market"))
    features = _named(features)
    days = _named(benchmark_rows).where(F.col("symbol") == benchmark.upper()).dropna(subset=RETURNS).agg(
        F.count_distinct("date").alias("n")
    )
    matched = valid & F.col("_in_market").isNotNull()
    per_symbol = (
        features.where(F.col("symbol") != benchmark.upper())
        .join(market, "date", "left")
        .groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("stock_rows_total"),
            F.count_if(valid).alias("stock_valid_return_rows"),
            F.count_if(matched).alias("aligned_rows"),
            F.count_if(valid & F.col("_in_market").isNull()).alias("stock_dates_without_benchmark"),
        )
    )
    return per_symbol.withColumn("benchmark_valid_return_rows", days.scalar()).withColumns(
        {
            "benchmark_dates_without_stock": F.col("benchmark_valid_return_rows") - F.col("aligned_rows"),
            "stock_null_return_rows_removed": F.col("stock_rows_total") - F.col("stock_valid_return_rows"),
            "fill_method": F.lit("none"),
            "join_method": F.lit("exact-date inner join"),
        }
    )


def _blocks(windows: Sequence[int]) -> dict[int, list[tuple[int, int]]]:
    """For each window the blocks of rows, of at most two sizes, that it is made of: (rows, how many rows before this one it ends)."""
    least = math.gcd(*windows)

    def parts(n: int, size: int) -> list[tuple[int, int]]:
        whole = n // size * size
        return [(size, at) for at in range(0, whole, size)] + [(least, at) for at in range(whole, n, least)]

    def cost(size: int) -> int:
        used = {p for n in windows for p in parts(n, size)}
        return sum({s for s, _ in used}) + 2 * len(used)

    size = min(range(least, max(windows) + 1, least), key=cost)
    return {n: parts(n, size) for n in windows}


def add_rolling_beta(
    aligned: DataFrame,
    windows: Sequence[int] = BETA_WINDOWS,
    stock: str = "simple_return",
    market: str = "benchmark_simple_return",
) -> DataFrame:
    """Covariance over variance of the last ``n`` pairs; null unless all are present and vary."""
    if not windows or any(n < 2 for n in windows):
        raise ValueError("beta windows must be integers of at least 2")
    require_columns(aligned, ["symbol", "date", stock, market], "aligned returns")
    y, x, w = F.col(stock), F.col(market), by_symbol()
    pair = y.isNotNull() & x.isNotNull()
    held = {"_x": x, "_xx": x * x, "_y": F.when(pair, y), "_xy": F.when(pair, x * y)}
    df = aligned.withColumns(held | {"_row": F.row_number().over(w), "_changed": ~x.eqNullSafe(F.lag(x, 1).over(w))})
    # Short blocks of rows over one order, summed anew for each row; a window is blocks that end one before the other, so
    # nothing is subtracted and a row outside it leaves no trace, however large. Numbers of rows are exact differences.
    blocks = _blocks(windows)
    places = sorted({p for parts in blocks.values() for p in parts})
    sums = {"_last_change": F.max(F.when(F.col("_changed"), F.col("_row"))).over(so_far()), "_repeated": repeated_day()}
    sums |= {f"_seen{k}": F.count(k).over(so_far()) for k in ("_x", "_y")}
    sums |= {f"{k}_{size}_0": F.sum(k).over(last_rows(size)) for size in sorted({size for size, _ in places}) for k in held}
    ended = {f"{k}_{size}_{at}": F.lag(f"{k}_{size}_0", at).over(w) for size, at in places if at for k in held}
    ended |= {f"{k}{n}": F.lag(k, n, 0).over(w) for k in ("_seen_x", "_seen_y") for n in windows}
    df = df.withColumns(sums).withColumns(ended)
    columns: dict[str, Column] = {}
    for n in windows:
        s = {k: sum((F.col(f"_{k}_{size}_{at}") for size, at in blocks[n][1:]), F.col(f"_{k}_{blocks[n][0][0]}_0")) for k in ("x", "xx", "y", "xy")}
        s |= {"n": F.col("_seen_x") - F.col(f"_seen_x{n}"), "np": F.col("_seen_y") - F.col(f"_seen_y{n}")}
        variance = F.when(s["n"] == n, F.greatest((s["xx"] - s["x"] * s["x"] / n) / (n - 1), F.lit(0.0)))
        # Decided by the rows, not by a rounded sum: no change inside the window, no variance.
        flat = F.col("_last_change") <= F.col("_row") - (n - 1)
        variance = F.when(flat & variance.isNotNull(), F.lit(0.0)).otherwise(variance)
        covariance = (s["xy"] - s["x"] * s["y"] / n) / (n - 1)
        beta = F.when((s["np"] == n) & ~flat, F.try_divide(covariance, variance))
        columns[f"beta_{n}"] = once_per_day(beta, "aligned returns", F.col("_repeated"))
        columns[f"beta_{n}_n_obs"] = s["np"]
        columns[f"benchmark_variance_{n}"] = variance
    return df.withColumns(columns).select(*aligned.columns, *columns)


def latest_rolling_beta(
    aligned: DataFrame,
    windows: Sequence[int] = BETA_WINDOWS,
    stock: str = "simple_return",
    market: str = "benchmark_simple_return",
) -> DataFrame:
    """``symbol, date`` and the betas of each symbol's last day, as the last row of ``add_rolling_beta`` has them: only the
    last rows of a symbol are looked at, once, and summed up."""
    require_columns(aligned, ["symbol", "date", stock, market], "aligned returns")
    y, x = F.col(stock), F.col(market)
    from_end = W.partitionBy("symbol").orderBy(F.desc("date"))
    unique = F.when(
        F.lag("date").over(from_end) == F.col("date"), F.raise_error(F.lit("aligned returns contains duplicate symbol/date keys")).cast("double")
    ).otherwise(x)
    recent = aligned.select("symbol", "date", y.alias("_y"), unique.alias("_x"), F.row_number().over(from_end).alias("_age")).where(
        F.col("_age") <= max(windows)
    )
    sums: dict[str, Column] = {"date": F.max("date")}
    for n in windows:
        inside = F.col("_age") <= n
        xn, yn = F.when(inside, F.col("_x")), F.when(inside & F.col("_x").isNotNull(), F.col("_y"))
        both = F.when(yn.isNotNull(), xn * yn)
        sums |= {f"_n{n}": F.count(xn), f"_np{n}": F.count(yn), f"_x{n}": F.sum(xn), f"_xx{n}": F.sum(xn * xn), f"_y{n}": F.sum(yn), f"_xy{n}": F.sum(both)}
        sums |= {f"_flat{n}": F.min(xn) == F.max(xn)}
    df = recent.groupBy("symbol").agg(*[e.alias(c) for c, e in sums.items()])
    columns: list[Column] = [F.col("symbol"), F.col("date")]
    for n in windows:
        s = {k: F.col(f"_{k}{n}") for k in ("n", "np", "x", "xx", "y", "xy", "flat")}
        variance = (s["xx"] - s["x"] * s["x"] / n) / (n - 1)
        covariance = (s["xy"] - s["x"] * s["y"] / n) / (n - 1)
        whole = (s["n"] == n) & (s["np"] == n) & ~s["flat"]
        columns += [F.when(whole, F.try_divide(covariance, F.greatest(variance, F.lit(0.0)))).alias(f"beta_{n}"), s["np"].alias(f"beta_{n}_n_obs")]
    return df.select(*columns)


def compare_betas(calculated: DataFrame, provider: DataFrame, windows: Sequence[int] = BETA_WINDOWS) -> DataFrame:
    """Own betas beside the provider's; differences are descriptive only."""
    require_columns(calculated, ["symbol", "date", *[f"beta_{n}" for n in windows]], "calculated beta table")
    df = calculated.join(one_row_each(provider, ["symbol"], "provider betas"), "symbol", "left")
    columns: dict[str, Column] = {}
    for n in windows:
        gap = F.col(f"beta_{n}") - F.col("provider_beta")
        columns[f"difference_beta_{n}"] = gap
        columns[f"absolute_difference_beta_{n}"] = F.abs(gap)
    return df.withColumns(columns).withColumns(
        {
            "methodology_comparable": F.lit(False),
            "comparison_note": F.lit("Provider lookback and method may differ from the stated window."),
        }
    )


def _timeframes(months: dict[str, int]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("timeframe"), F.lit(m).alias("months")) for k, m in months.items()]))


def lookback(history: DataFrame, months: dict[str, int] | None = None, end: Column | None = None) -> DataFrame:
    """Each row once per timeframe that contains it. The end defaults to the symbol's last day."""
    last = end if end is not None else F.max("date").over(W.partitionBy("symbol"))
    return (
        history.withColumn("_end", last)
        .withColumn("_tf", _timeframes(months or TIMEFRAME_MONTHS))
        .withColumn("timeframe", F.col("_tf.timeframe"))
        .where(F.col("date") >= F.add_months("_end", -F.col("_tf.months")))
        .drop("_tf", "_end")
    )


def lookback_days(history: DataFrame, days: dict[str, int]) -> DataFrame:
    """As ``lookback`` with a fixed number of days before the symbol's last day."""
    return (
        history.withColumn("_end", F.max("date").over(W.partitionBy("symbol")))
        .withColumn("_tf", _timeframes(days))
        .withColumn("timeframe", F.col("_tf.timeframe"))
        .where(F.col("date") >= F.date_sub("_end", F.col("_tf.months")))
        .drop("_tf", "_end")
    )


def add_timeframe_drawdown(sliced: DataFrame, price: str = "adjusted_close") -> DataFrame:
    """Drawdown from the highest price inside the slice."""
    w = W.partitionBy("symbol", "timeframe").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return sliced.withColumn("timeframe_drawdown", F.col(price) / F.max(price).over(w) - 1)


def deep_dive(history: DataFrame, months: dict[str, int] | None = None) -> DataFrame:
    needed = ["symbol", "date", "adjusted_close", "sma_20", "sma_50", "rsi_14", "volatility_20d_annualized"]
    require_columns(history, needed, "deep-dive input")
    return add_timeframe_drawdown(lookback(history, months)).withColumns(
        {
            "volatility_20d_annualized_pct": F.col("volatility_20d_annualized") * 100,
            "timeframe_drawdown_pct": F.col("timeframe_drawdown") * 100,
        }
    )


def max_drawdown(sliced: DataFrame) -> DataFrame:
    return sliced.groupBy("symbol", "timeframe").agg((F.min("timeframe_drawdown") * 100).alias("max_drawdown_pct"))


def _priced(history: DataFrame) -> DataFrame:
    """symbol, date, adjusted_close; a price at or below zero or a repeated day fails the job."""
    require_columns(history, ["symbol", "date", "adjusted_close"], "comparison input")
    price = once_per_day(positive(F.col("adjusted_close"), "adjusted_close"), "comparison input")
    return history.select("symbol", "date", price.alias("adjusted_close"))


def _market_series(prices: DataFrame, benchmark: str) -> DataFrame:
    rows = prices.where(F.col("symbol") == benchmark)
    return _one_row_per_day(
        rows.select("date", F.col("adjusted_close").alias("benchmark_adjusted_close"), F.lit(True).alias("_listed")),
        ["benchmark_adjusted_close", "_listed"],
    )


def _market_days(prices: DataFrame, benchmark: str) -> Column:
    """Sorted days of the benchmark, one calendar's worth, as a scalar subquery; the last is its end."""
    return prices.where(F.col("symbol") == benchmark).agg(F.array_sort(F.collect_set("date")).alias("days")).scalar()


def _compare_window(prices: DataFrame, benchmark: str, months: dict[str, int]) -> DataFrame:
    """Common-day pairs per symbol and timeframe, with what each side had in the window."""
    stock = prices.where(F.col("symbol") != benchmark).select("symbol", "date", F.col("adjusted_close").alias("stock_adjusted_close"))
    stock = stock.withColumn("_days", _market_days(prices, benchmark)).withColumn("_market_end", F.try_element_at("_days", F.lit(-1))).drop("_days")
    end = F.greatest(F.max("date").over(W.partitionBy("symbol")), F.col("_market_end"))
    return lookback(stock, months, end).drop("_market_end").join(_market_series(prices, benchmark), "date", "left")


def indexed_comparison(history: DataFrame, benchmark: str, months: dict[str, int] | None = None) -> DataFrame:
    """Both series on their common days, each indexed to 100 at the first of them; for every symbol
    and timeframe with at least two common days."""
    pairs = _compare_window(_priced(history), benchmark, months or TIMEFRAME_MONTHS).dropna(
        subset=["stock_adjusted_close", "benchmark_adjusted_close"]
    )
    w = W.partitionBy("symbol", "timeframe").orderBy("date")
    both = F.count(F.lit(1)).over(W.partitionBy("symbol", "timeframe"))
    return (
        pairs.withColumn("_n", both)
        .where(F.col("_n") >= 2)
        .withColumns(
            {
                "stock_indexed": F.col("stock_adjusted_close") / F.first("stock_adjusted_close").over(w) * 100,
                "benchmark_indexed": F.col("benchmark_adjusted_close") / F.first("benchmark_adjusted_close").over(w) * 100,
            }
        )
        .drop("_n", "_listed")
    )


def comparison_summary(history: DataFrame, benchmark: str, months: dict[str, int] | None = None) -> DataFrame:
    """Returns over the common days, the excess in points, and the days left out on each side.

    Every symbol has a row per timeframe; ``status`` says where fewer than two common days leave nothing to compare.
    """
    months = months or TIMEFRAME_MONTHS
    prices = _priced(history)
    rows = _compare_window(prices, benchmark, months)
    common = F.col("stock_adjusted_close").isNotNull() & F.col("benchmark_adjusted_close").isNotNull()
    s, b = F.col("stock_adjusted_close"), F.col("benchmark_adjusted_close")
    at = F.when(common, F.col("date"))
    per_pair = rows.groupBy("symbol", "timeframe").agg(
        F.count(F.lit(1)).alias("_stock_days"),
        F.count_if(common).alias("common_observations"),
        F.min(at).alias("first_common_date"),
        F.max(at).alias("last_common_date"),
        (F.max_by(s, at) / F.min_by(s, at) - 1).alias("stock_return"),
        (F.max_by(b, at) / F.min_by(b, at) - 1).alias("benchmark_return"),
    )
    pairs = (
        prices.where(F.col("symbol") != benchmark).groupBy("symbol").agg(F.max("date").alias("_last"))
        .withColumn("_days", _market_days(prices, benchmark))
        .withColumn("_end", F.greatest(F.col("_last"), F.try_element_at("_days", F.lit(-1))))
        .withColumn("_tf", _timeframes(months))
        .select(
            "symbol",
            F.col("_tf.timeframe").alias("timeframe"),
            F.size(F.filter("_days", lambda d: d >= F.add_months("_end", -F.col("_tf.months")))).cast("long").alias("_market_days"),
        )
    )
    n = F.coalesce("common_observations", F.lit(0).cast("long"))
    enough = n >= 2
    return pairs.join(per_pair, ["symbol", "timeframe"], "left").select(
        "symbol",
        F.lit(benchmark).alias("benchmark"),
        "timeframe",
        F.when(enough, F.lit("compared")).otherwise("fewer than two common days").alias("status"),
        F.when(enough, F.col("stock_return")).alias("stock_return"),
        F.when(enough, F.col("benchmark_return")).alias("benchmark_return"),
        F.when(enough, (F.col("stock_return") - F.col("benchmark_return")) * 100).alias("excess_return_pp"),
        n.alias("common_observations"),
        "first_common_date",
        "last_common_date",
        (F.coalesce("_stock_days", F.lit(0).cast("long")) - n).alias("stock_dates_excluded"),
        (F.col("_market_days") - n).alias("benchmark_dates_excluded"),
    )


def indexed_comparison_days(history: DataFrame, benchmark: str, days: dict[str, int]) -> DataFrame:
    """Day-count variant: the window ends on the stock's own last day; one summary per pair."""
    history = _priced(history)
    market = _one_row_per_day(
        history.where((F.col("symbol") == benchmark) & F.col("adjusted_close").isNotNull()).select(
            "date", F.col("adjusted_close").alias("benchmark_adjusted_close")
        ),
        ["benchmark_adjusted_close"],
    )
    stock = history.where(F.col("symbol") != benchmark).select("symbol", "date", "adjusted_close")
    pairs = lookback_days(stock, days).dropna(subset=["adjusted_close"]).join(market, "date")
    s, b = F.col("adjusted_close"), F.col("benchmark_adjusted_close")
    per_pair = pairs.groupBy("symbol", "timeframe").agg(
        F.count(F.lit(1)).alias("n_days"),
        ((F.max_by(s, "date") / F.min_by(s, "date")) * 100 - 100).alias("stock_change_pct"),
        ((F.max_by(b, "date") / F.min_by(b, "date")) * 100 - 100).alias("benchmark_change_pct"),
    )
    return per_pair.where("n_days >= 2").withColumn(
        "excess_pct", F.col("stock_change_pct") - F.col("benchmark_change_pct")
    )


def comparison_long(indexed: DataFrame) -> DataFrame:
    """Two indexed series per pair stacked into rows; the suffix goes away in the series name."""
    return (
        indexed.select("symbol", "timeframe", "date", "stock_indexed", "benchmark_indexed")
        .unpivot(["symbol", "timeframe", "date"], ["stock_indexed", "benchmark_indexed"], "series", "indexed_value")
        .withColumn("series", F.regexp_replace("series", "_indexed$", ""))
    )
