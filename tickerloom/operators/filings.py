"""Facts as they were known: latest fact, standalone quarters, growth and margin.

A flat fact has ``symbol, tag, unit, val, period_start, period_end, filed, form, frame, seq`` where
``seq`` is its place in the filing document. Choices among facts are aggregates (``max_by`` over a
struct), so a symbol with very many facts is combined before the shuffle instead of being sorted in
one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.constants import FACT_METRICS, FILING_FORMS, INCOME_TAGS, REVENUE_TAGS
from tickerloom.functions.scalars import frame_quarter, frame_year, is_quarter_frame, prior_year_frame
from tickerloom.operators.merge import merge_states

PAYLOAD = ["val", "period_end", "filed", "form", "tag"]
FACT = ["val", "period_start", "period_end", "filed", "form", "tag", "frame"]


def _lookup(table: dict[str, object], key: Column) -> Column:
    items: list[Column] = []
    for k, v in table.items():
        items += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*items), key)


def known_facts(facts: DataFrame, as_of: str | Column | None = None) -> DataFrame:
    """Facts from the accepted forms with a filing date, filed no later than ``as_of``."""
    df = facts.where(F.col("form").isin(FILING_FORMS) & F.col("filed").isNotNull())
    if as_of is not None:
        limit = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
        df = df.where(F.col("filed") <= limit)
    return df


def _metric_facts(facts: DataFrame, metrics: dict[str, tuple[Sequence[str], str]]) -> DataFrame:
    metric_of, rank_of = {}, {}
    for metric, (tags, unit) in metrics.items():
        for rank, tag in enumerate(tags):
            metric_of[f"{tag}|{unit}"] = metric
            rank_of[f"{tag}|{unit}"] = rank
    all_tags = sorted({t for tags, _ in metrics.values() for t in tags})
    key = F.concat_ws("|", "tag", "unit")
    framed = F.col("frame").isNotNull() & (F.col("frame") != "")
    pool = F.when(is_quarter_frame(F.col("frame")), 2).when(framed, 1).otherwise(0)
    return (
        facts.where(F.col("tag").isin(all_tags))
        .withColumns({"metric": _lookup(metric_of, key), "_tag_rank": _lookup(rank_of, key), "_pool": pool})
        .where(F.col("metric").isNotNull())
    )


def _recency() -> Column:
    """Later period, then later filing, then the preferred tag, then the earlier place in the document."""
    return F.struct(
        F.col("period_end").alias("end"), F.col("filed").alias("filed"),
        (-F.col("_tag_rank")).alias("tag"), (-F.col("seq")).alias("seq"),
    )


def _payload() -> Column:
    return F.struct(*[F.col(c) for c in PAYLOAD])


def latest_facts(
    facts: DataFrame,
    metrics: dict[str, tuple[Sequence[str], str]] | None = None,
    as_of: str | Column | None = None,
) -> DataFrame:
    """Latest known fact per (symbol, metric): standalone quarters first, then framed, then any."""
    rows = _metric_facts(known_facts(facts, as_of), metrics or FACT_METRICS)
    best = F.max_by(_payload(), F.struct(F.col("_pool").alias("pool"), _recency().alias("r")))
    return rows.groupBy("symbol", "metric").agg(best.alias("fact")).select("symbol", "metric", "fact.*")


def fundamentals_snapshot(
    facts: DataFrame,
    metrics: dict[str, tuple[Sequence[str], str]] | None = None,
    as_of: str | Column | None = None,
) -> DataFrame:
    """One row per symbol; each metric with its period end, filing date, form and tag."""
    metrics = metrics or FACT_METRICS
    # A fact is compared once, for its own metric; a symbol has a row per metric after that.
    chosen = latest_facts(facts, metrics, as_of).select(
        "symbol", "metric", F.struct(*PAYLOAD).alias("f")
    )
    picks = [F.struct(F.max_by("f", F.when(F.col("metric") == m, F.col("metric"))).alias("f")).alias(m) for m in metrics]
    return chosen.groupBy("symbol").agg(*picks).select("symbol", *snapshot_columns(metrics, "f"))


def snapshot_columns(metrics: Sequence[str], field: str) -> list[Column]:
    """Each metric's value, period end, filing date, form and tag out of the struct in its column."""
    columns: list[Column] = []
    for m in metrics:
        columns += [
            F.col(f"{m}.{field}.val").alias(m),
            F.col(f"{m}.{field}.period_end").alias(f"{m}_period_end"),
            F.col(f"{m}.{field}.filed").alias(f"{m}_filed"),
            F.col(f"{m}.{field}.form").alias(f"{m}_form"),
            F.col(f"{m}.{field}.tag").alias(f"{m}_tag"),
        ]
    return columns


def fact_events(facts: DataFrame, metrics: dict[str, tuple[Sequence[str], str]] | None = None) -> DataFrame:
    """``symbol, at`` and a column per metric: each fact on its filing day, as a struct whose greatest so far is the fact
    known best (the highest pool seen so far wins)."""
    metrics = metrics or FACT_METRICS
    known = F.struct(F.col("_pool").alias("pool"), _recency().alias("r"), _payload().alias("f"))
    return _metric_facts(known_facts(facts), metrics).select(
        "symbol", F.col("filed").alias("at"), *[F.when(F.col("metric") == m, known).alias(m) for m in metrics]
    )


def point_in_time_facts(
    facts: DataFrame,
    decisions: DataFrame,
    metrics: dict[str, tuple[Sequence[str], str]] | None = None,
) -> DataFrame:
    """For each (symbol, decision date) and metric, the latest fact filed by that day; nulls where none was.

    One merge per symbol carries a state of all metrics, which becomes a row per metric afterwards: one exchange, and
    decisions enter it once. No fact is paired with the decisions after it.
    """
    metrics = metrics or FACT_METRICS
    asked = decisions.select("symbol", F.col("decision_date").alias("at"))
    states = merge_states(asked, [fact_events(facts, metrics)], highest=list(metrics))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}.f").alias("f")) for m in metrics])
    return states.select("symbol", F.col("at").alias("decision_date"), F.inline(rows)).select("symbol", "decision_date", "metric", "f.*")


def quarterly_facts(
    facts: DataFrame, tags: Sequence[str], unit: str = "USD", as_of: str | Column | None = None
) -> DataFrame:
    """One row per (symbol, year, quarter): the preferred tag wins, then the latest filing."""
    rows = _quarter_rows(known_facts(facts, as_of), tags, unit)
    return (
        rows.groupBy("symbol", "year", "quarter")
        .agg(F.max_by(F.struct(*FACT), "preference").alias("fact"))
        .select("symbol", "year", "quarter", "fact.*")
    )


def _quarter_rows(known: DataFrame, tags: Sequence[str], unit: str = "USD") -> DataFrame:
    """Facts of standalone quarters with their quarter and ``preference``, greatest for the fact to choose."""
    rank = _lookup({t: i for i, t in enumerate(tags)}, F.col("tag"))
    usable = F.col("tag").isin(list(tags)) & (F.col("unit") == unit) & is_quarter_frame(F.col("frame")) & F.col("val").isNotNull()
    return known.where(usable).withColumns(
        {
            "year": frame_year(F.col("frame")), "quarter": frame_quarter(F.col("frame")),
            "preference": F.struct((-rank).alias("tag"), F.col("filed").alias("filed"), (-F.col("seq")).alias("seq")),
        }
    )


def year_on_year(quarters: DataFrame) -> DataFrame:
    """Each quarter beside the same quarter of the year before; a gap stays null."""
    prior = quarters.select(
        "symbol", (F.col("year") + 1).alias("year"), "quarter",
        F.col("val").alias("prior_val"), F.col("tag").alias("prior_tag"), F.col("filed").alias("prior_filed"),
    )
    usable = F.col("prior_val") > 0
    return (
        quarters.join(prior, ["symbol", "year", "quarter"], "left")
        .withColumn("comparison_frame", prior_year_frame(F.col("year"), F.col("quarter")))
        .withColumn("growth_yoy", F.when(usable, F.try_divide("val", "prior_val") - 1))
    )


def match_income(revenue: DataFrame, income: DataFrame) -> DataFrame:
    """Income of exactly the same start and end as the revenue row; the last quarter wins."""
    inc = income.groupBy("symbol", F.col("period_start").alias("_s"), F.col("period_end").alias("_e")).agg(
        F.max_by(F.struct(F.col("val").alias("income"), F.col("tag").alias("income_tag"), F.col("filed").alias("income_filed")),
                 F.struct("year", "quarter")).alias("_i")
    ).withColumnRenamed("symbol", "_sym")
    same = (
        (F.col("symbol") == F.col("_sym"))
        & F.col("period_start").eqNullSafe(F.col("_s"))
        & F.col("period_end").eqNullSafe(F.col("_e"))
    )
    return revenue.join(inc, same, "left").select(*revenue.columns, "_i.*")


def growth_events(facts: DataFrame) -> DataFrame:
    """``symbol, at, growth``: after each filing day that touches it, the latest standalone revenue quarter known by then,
    beside the same quarter of the year before and the income of the same frame and period, each as known by then.

    A fact takes part under its own quarter and, as the year before, under the quarter a year later; running maxima over
    the quarter's filing days give its state, a running maximum over the symbol's which quarter is the latest. Two windows
    on the symbol, no join.
    """
    known = known_facts(facts)
    revenue, income = _quarter_rows(known, REVENUE_TAGS), _quarter_rows(known, INCOME_TAGS)
    place = F.col("year") * 4 + F.col("quarter")
    fact = F.struct("preference", "year", "quarter", *FACT)

    def event(rows: DataFrame, at: Column, name: str) -> DataFrame:
        return rows.select("symbol", F.col("filed").alias("at"), at.cast("long").alias("_place"), fact.alias(name))

    rows = event(revenue, place, "_now").unionByName(event(revenue, place + 4, "_before"), allowMissingColumns=True).unionByName(
        event(income, place, "_income"), allowMissingColumns=True
    )
    # Ordered without a row frame: facts of the same day count together.
    quarter, symbol = W.partitionBy("symbol", "_place").orderBy("at"), W.partitionBy("symbol").orderBy("at")
    latest = F.max(F.when(F.col("_now").isNotNull(), F.col("_place"))).over(symbol)
    states = rows.select("symbol", "at", "_place", latest.alias("_latest"), *[F.max(c).over(quarter).alias(c) for c in ("_now", "_before", "_income")])
    same = F.col("_income.period_start").eqNullSafe(F.col("_now.period_start")) & F.col("_income.period_end").eqNullSafe(F.col("_now.period_end"))
    growth = F.struct(
        *[F.col(f"_now.{c}").alias(c) for c in ("year", "quarter", *FACT)],
        F.col("_before.val").alias("prior_val"),
        F.when(same, F.col("_income.val")).alias("income"), F.when(same, F.col("_income.tag")).alias("income_tag"),
    )
    return states.where(F.col("_place") == F.col("_latest")).select("symbol", "at", growth.alias("growth"))


def growth_columns(q: Column, margin_limit: float = 0.75) -> dict[str, Column]:
    """Growth, margin and notes from a struct of the latest revenue quarter; a null struct is a company without one."""
    has_growth = F.coalesce(q["prior_val"] > 0, F.lit(False))
    has_margin = F.coalesce(q["income"].isNotNull() & (q["val"] != 0), F.lit(False))
    margin = F.when(has_margin, F.try_divide(q["income"], q["val"]))
    unusual = F.coalesce(F.abs(margin) > margin_limit, F.lit(False))
    notes = F.concat_ws(
        "; ",
        F.when(~has_growth, "same-quarter prior-year revenue unavailable or nonpositive"),
        F.when(unusual, "absolute quarterly profit margin exceeds 75%; review source fact")
        .when(~has_margin, "same-period quarterly net income unavailable or revenue zero"),
    )
    framed = q["frame"].isNotNull()
    return {
        "revenue_growth_yoy": F.when(has_growth, F.try_divide(q["val"], q["prior_val"]) - 1),
        "profit_margin": margin,
        "latest_revenue": q["val"],
        "prior_year_revenue": F.when(has_growth, q["prior_val"]),
        "latest_net_income": F.when(has_margin, q["income"]),
        "latest_frame": F.coalesce(q["frame"], F.lit("")),
        "comparison_frame": F.when(framed, prior_year_frame(q["year"], q["quarter"])).otherwise(""),
        "revenue_tag": F.coalesce(q["tag"], F.lit("")),
        "net_income_tag": F.coalesce(F.when(has_margin, q["income_tag"]), F.lit("")),
        "period_start": q["period_start"],
        "period_end": q["period_end"],
        "latest_revenue_filed": q["filed"],
        "revenue_growth_available": has_growth,
        "profit_margin_available": has_margin,
        "unusual_margin_flag": unusual,
        "quality_note": F.when(framed, notes).otherwise("no SEC-framed standalone quarterly revenue"),
    }


def company_growth(
    symbols: DataFrame, facts: DataFrame, as_of: str | Column | None = None, margin_limit: float = 0.75
) -> DataFrame:
    """Revenue growth and margin of the latest standalone quarter, with quality notes, per symbol."""
    revenue = year_on_year(quarterly_facts(facts, REVENUE_TAGS, as_of=as_of))
    income = quarterly_facts(facts, INCOME_TAGS, as_of=as_of)
    picked = [c for c in revenue.columns if c != "symbol"]
    latest = revenue.groupBy("symbol").agg(
        F.max_by(F.struct(*picked), F.struct("year", "quarter")).alias("q")
    ).select("symbol", "q.*")
    matched = match_income(latest, income)
    states = matched.select("symbol", F.struct(*[c for c in matched.columns if c != "symbol"]).alias("q"))
    df = symbols.select("symbol").join(states, "symbol", "left")
    return df.select("symbol", *[e.alias(c) for c, e in growth_columns(F.col("q"), margin_limit).items()])
