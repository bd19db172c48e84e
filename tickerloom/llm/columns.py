"""Columns of a caller whose names an operator needs for itself."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """`df` with the columns of these names (in any case) under names of no other column, and how to rename them back."""
    wanted, taken = {n.lower() for n in names}, {c.lower() for c in df.columns}
    away = {}
    for column in df.columns:
        if column.lower() in wanted:
            name = f"_aside{column}"
            while name.lower() in taken | wanted:
                name += "_"
            taken.add(name.lower())
            away[column] = name
    return df.withColumnsRenamed(away), {held: column for column, held in away.items()}
