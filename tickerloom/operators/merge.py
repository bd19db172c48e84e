"""Merging dated rows of one symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.operators.keys import keyed


def merge_states(asked: DataFrame, parts: Sequence[DataFrame], highest: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """``symbol, at`` of every day in ``asked`` with each state of ``parts`` as of that day.

    Every part has ``symbol, at`` and state columns. A state is the last one set on or before the day, or the greatest
    so far where it is named in ``highest``. Days asked for twice have one row; what was never set is null. ``tasks``
    fixes the number of tasks, where the caller knows how many rows there are.
    """
    states = [c for p in parts for c in p.columns if c not in ("symbol", "at")]
    rows = asked.select("symbol", "at", F.lit(True).alias("_asked"))
    for part in parts:
        rows = rows.unionByName(part, allowMissingColumns=True)
    rows = keyed(rows, tasks)
    order = ["at", F.col("_asked").asc_nulls_first()]
    in_order = W.partitionBy("symbol").orderBy(*order)
    so_far = in_order.rowsBetween(W.unboundedPreceding, 0)
    again = F.lag("_asked").over(in_order) & (F.lag("at").over(in_order) == F.col("at"))
    found = {c: (F.max(c) if c in highest else F.last(c, ignorenulls=True)).over(so_far) for c in states}
    return rows.select("symbol", "at", "_asked", again.alias("_again"), *[e.alias(c) for c, e in found.items()]).where(
        F.col("_asked") & ~F.coalesce("_again", F.lit(False))
    ).drop("_asked", "_again")
