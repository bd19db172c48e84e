"""First-order linear recurrences as window sums.

``y[k] = p[k] * y[k-1] + u[k]`` with ``0 < p <= 1`` equals ``exp(L[k]) * sum(u[i] * exp(-L[i]))`` for
``i <= k``, where ``L`` is the running sum of ``ln p``. The exponent is reset every ``SPAN`` units of
decay so that nothing overflows; one reset span shrinks older values by ``exp(-SPAN)``, below double
precision, so only the span just before can still be felt and one carried value is enough. A short
span also keeps the exponents, and with them the rounding error of ``exp``, small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN = 40.0


def linear_recurrence(
    df: DataFrame, keys: Sequence[str], order: str, pairs: dict[str, str], log_decay: str
) -> DataFrame:
    """Add one column per ``output -> impulse`` pair.

    ``log_decay`` is the running sum ``L`` (zero or negative, never rising within a key). Rows with a
    null impulse add nothing. A key holds one row per calendar day, so its window is small.
    """
    L = F.col(log_decay)
    df = df.withColumn("_span", F.floor(-L / F.lit(SPAN)).cast("long"))
    inside = W.partitionBy(*keys, "_span").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys, "_span").orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    base = -F.col("_span") * F.lit(SPAN)
    local = {
        out: F.coalesce(F.sum(F.col(u) * F.exp(base - L)).over(inside), F.lit(0.0)) * F.exp(L - base)
        for out, u in pairs.items()
    }
    df = df.withColumns(
        {f"_{out}": e for out, e in local.items()}
        | {"_last_row": F.row_number().over(inside) == F.count(F.lit(1)).over(whole)}
    )
    # Spans never go back, so this is the order of ``order`` alone, and rows lie in it already.
    before = W.partitionBy(*keys).orderBy("_span", order).rowsBetween(W.unboundedPreceding, -1)

    def carried(column: str):
        ended = F.when(F.col("_last_row"), F.struct(F.col("_span"), L.alias("l"), F.col(column).alias("y")))
        return F.last(ended, ignorenulls=True).over(before)

    df = df.withColumns({f"_c{out}": carried(f"_{out}") for out in pairs})
    result = {
        out: F.col(f"_{out}")
        + F.when(
            F.col(f"_c{out}")["_span"] < F.col("_span"), F.col(f"_c{out}")["y"] * F.exp(L - F.col(f"_c{out}")["l"])
        ).otherwise(F.lit(0.0))
        for out in pairs
    }
    scratch = ["_span", "_last_row", *(f"_{o}" for o in pairs), *(f"_c{o}" for o in pairs)]
    return df.withColumns(result).drop(*scratch)
