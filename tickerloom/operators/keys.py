"""Schema and key checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class DataQualityError(ValueError):
    """Input breaks a rule that must not be repaired silently."""


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    """Analysis-time check; runs no job."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} missing columns: {missing}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with the number of rows. Null keys compare equal."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """One job; shows at most three offending keys."""
    bad = duplicate_keys(df, keys).select(*keys).take(3)
    if bad:
        raise DataQualityError(f"{what} contains duplicate {'/'.join(keys)} keys: {[tuple(r) for r in bad]}")


def one_row_each(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The rows of ``df``; a second row of a key fails the job that reads them. No job of its own, and no
    exchange that a join on the same keys would not need."""
    again = F.row_number().over(W.partitionBy(*keys).orderBy(*keys)) > 1
    error = F.raise_error(F.concat_ws(" ", F.lit(f"{what} contains duplicate {'/'.join(keys)} keys:"), *[F.col(k).cast("string") for k in keys]))
    return df.withColumn("_again", again).where(F.when(F.col("_again"), error.cast("boolean")).otherwise(True)).drop("_again")


def keyed(df: DataFrame, tasks: int | None, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The rows of ``df`` dealt out by their key over a fixed number of tasks, which adaptive execution leaves as it is: it
    would merge partitions by their compressed bytes down to one a core, and windows hold a task's rows many times over."""
    return df.repartition(tasks, *keys) if tasks else df


def assert_positive(df: DataFrame, column: str, what: str, allow_null: bool = True) -> None:
    bad = F.col(column) <= 0
    if not allow_null:
        bad = bad | F.col(column).isNull()
    if df.where(bad).take(1):
        raise DataQualityError(f"{what} requires {'' if allow_null else 'complete and '}positive {column}")
