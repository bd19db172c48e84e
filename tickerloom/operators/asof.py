"""The latest state of several dated tables on every decision day.

All tables and the decisions are merged once per symbol in order of days: one exchange, however many tables
and decision days there are, and no row is paired with the decisions after it. A symbol's window holds its
dated rows, which the calendar and its filings bound.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.constants import FACT_METRICS
from tickerloom.functions.scalars import symbol_text
from tickerloom.operators.cleaning import clean_fundamentals
from tickerloom.operators.filings import fact_events, growth_columns, growth_events, snapshot_columns
from tickerloom.operators.keys import one_row_each
from tickerloom.operators.merge import merge_states
from tickerloom.operators.snapshot import FUNDAMENTAL_COLUMNS, GROWTH_COLUMNS, add_availability


def period_ends(dated: DataFrame, unit: str = "quarter", months: int = 3) -> DataFrame:
    """``symbol, as_of``: every symbol on every last day of a period that any row falls in, before its first row too."""
    first = F.date_trunc(unit, "date").cast("date")
    ends = dated.select(F.date_sub(F.add_months(first, months), 1).alias("end")).agg(F.array_sort(F.collect_set("end")).alias("ends"))
    # The days of a calendar: 400 quarters a century.
    return dated.select(symbol_text(F.col("symbol")).alias("symbol")).distinct().withColumn("ends", ends.scalar()).select(
        "symbol", F.explode("ends").alias("as_of")
    )


def _decided_on(decisions: DataFrame, day: Column) -> Column:
    """The first decision day of any symbol on or after ``day``; null after the last.

    Looked up in an array with an element per day of the calendar from the first decision to the last.
    """
    days = F.col("days")
    before = lambda d, i: F.when(i == 0, F.date_sub(d, 1)).otherwise(F.get(days, i - 1))
    upto = F.flatten(F.transform(days, lambda d, i: F.array_repeat(d, F.datediff(d, before(d, i)))))
    calendar = decisions.agg(F.array_sort(F.collect_set("as_of")).alias("days")).select(F.struct(F.get(days, 0).alias("first"), upto.alias("upto"))).scalar()
    return F.get(calendar["upto"], F.greatest(F.datediff(day, calendar["first"]), F.lit(0)))


def _dated(df: DataFrame, name: str, columns: Sequence[str], decisions: DataFrame) -> DataFrame:
    """The rows that a decision can see: a symbol's last between two decision days. A row without a day comes before all."""
    day = F.col("date")
    last = F.max_by(F.struct(*columns), F.struct(day.alias("day")))  # a null order is never picked, a struct of one is
    # Grouped by the symbol as it is: rows that come out of windows on it are not exchanged again.
    between = df.withColumns({"_dated": day.isNotNull(), "_decided": F.when(day.isNotNull(), _decided_on(decisions, day))})
    kept = between.groupBy("symbol", "_dated", "_decided").agg(
        F.max(day).alias("at"), last.alias(name)
    )
    return kept.select(symbol_text(F.col("symbol")).alias("symbol"), "at", name)


def master_as_of(
    decisions: DataFrame,
    technical: DataFrame,
    betas: DataFrame,
    momentum: DataFrame,
    facts: DataFrame,
    identity: DataFrame,
    benchmark: str,
    tasks: int | None = None,
) -> DataFrame:
    """The master table on every decision day (``symbol, as_of``): the last row of the dated tables up to that
    day, fundamentals and growth from the facts filed by then. A symbol has no row before its first technical one.

    Of the dated tables only a symbol's last row between two decision days enters the merge. ``tasks`` fixes its number of
    tasks. On a single day this is the table that ``build_master`` makes of the latest rows.
    """
    beta = [c for c in betas.columns if c.startswith("beta_")]
    trend = [c for c in momentum.columns if c.startswith("momentum_")]
    rest = [c for c in technical.columns if c not in ("symbol", *beta, *trend)]
    named = facts.withColumn("symbol", symbol_text(F.col("symbol")))
    parts = [
        _dated(technical, "technical", rest, decisions), _dated(betas, "beta", beta, decisions),
        _dated(momentum, "momentum", trend, decisions),
        fact_events(named), growth_events(named),
    ]
    asked = decisions.select(symbol_text(F.col("symbol")).alias("symbol"), F.col("as_of").alias("at"))
    states = merge_states(asked, parts, highest=list(FACT_METRICS), tasks=tasks).where(F.col("technical").isNotNull())
    known = reduce(lambda a, b: a | b, (F.col(m).isNotNull() for m in FACT_METRICS))
    wide = states.select(
        "symbol", F.col("at").alias("as_of"), "technical.*", "beta.*", "momentum.*", known.alias("_filed"),
        "growth", *snapshot_columns(FACT_METRICS, "f"),
    ).withColumn("is_benchmark", F.col("symbol") == benchmark.upper())
    kept = [c for c in FUNDAMENTAL_COLUMNS if c in identity.columns]
    who = one_row_each(identity.withColumn("symbol", symbol_text(F.col("symbol"))), ["symbol"], "identity").select(
        "symbol", *[F.col(c).alias(f"_{c}") for c in kept]
    )
    named_rows = clean_fundamentals(wide, validate=False).join(who, "symbol", "left").withColumns(
        {c: F.when(F.col("_filed"), F.col(f"_{c}")) for c in kept}
    )
    grown = growth_columns(F.col("growth"))
    full = named_rows.withColumns({c: F.when(~F.col("is_benchmark"), grown[c]) for c in GROWTH_COLUMNS})
    return add_availability(full.select("symbol", "as_of", *rest, "is_benchmark", *FUNDAMENTAL_COLUMNS, *beta, *trend, *GROWTH_COLUMNS))
