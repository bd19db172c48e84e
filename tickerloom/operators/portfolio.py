"""Valuation of holdings between two price points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mark_to_market(allocations: DataFrame, prices: DataFrame) -> DataFrame:
    """Moves and contributions per symbol.

    ``allocations``: owner, symbol, amount. ``prices``: symbol, price, next_price. Units are bought
    only where amount and price are positive.
    """
    bought = allocations.groupBy("owner", "symbol").agg(
        F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0.0)).alias("amount")
    )
    price, following = F.coalesce("price", F.lit(0.0)), F.coalesce("next_price", F.lit(0.0))
    usable = (F.col("amount") > 0) & (price > 0)
    df = bought.join(prices, "symbol", "left").withColumn(
        "units", F.when(usable, F.try_divide("amount", "price")).otherwise(0.0)
    )
    both = (price != 0) & (following != 0)
    return df.select(
        "owner", "symbol", "amount", "units", "price", "next_price",
        F.when(both, (F.try_divide("next_price", "price") - 1) * 100).otherwise(0.0).alias("change_pct"),
        (F.col("units") * (following - price)).alias("contribution"),
        (F.col("units") > 0).alias("held"),
    )


def worth(moves: DataFrame, cash: DataFrame) -> DataFrame:
    """Cash left after buying, and worth before and after the move; a missing next price keeps the old."""
    price = F.coalesce("price", F.lit(0.0))
    after = F.when(F.coalesce("next_price", F.lit(0.0)) != 0, F.col("next_price")).otherwise(price)
    held = F.when(F.col("held"), F.struct(F.col("contribution"), F.col("symbol")))
    totals = moves.groupBy("owner").agg(
        F.sum("amount").alias("invested"),
        F.sum(F.col("units") * price).alias("_before"),
        F.sum(F.col("units") * after).alias("_after"),
        F.max_by("symbol", held).alias("best_symbol"),
        F.min_by("symbol", held).alias("worst_symbol"),
    )
    left = F.col("cash") - F.coalesce("invested", F.lit(0.0))
    return cash.join(totals, "owner", "left").select(
        "owner",
        left.alias("cash_left"),
        (left + F.coalesce("_before", F.lit(0.0))).alias("worth_before"),
        (left + F.coalesce("_after", F.lit(0.0))).alias("worth_after"),
        "best_symbol",
        "worst_symbol",
    )
