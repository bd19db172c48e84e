"""Cross-sectional percentiles, weighted scores, ranks and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.constants import (
    COMPOSITE_WEIGHTS,
    MINIMUM_COVERAGE,
    MOMENTUM_WEIGHTS,
    QUALITY_WEIGHTS,
    RANK_POLICY,
)
from tickerloom.functions.scalars import direction_adjusted, score_label
from tickerloom.operators.keys import one_row_each, require_columns
from tickerloom.operators.order_stats import join_ranks, rank_table
from tickerloom.operators.transform import long_features


def percentile_ranks(values: DataFrame, group: Sequence[str], value: str = "value") -> DataFrame:
    """Average-rank percentile 0-100, rank position and eligible count; null values stay null.

    Ranks are worked out once per distinct value and joined back; a large cross-section is never gathered.
    """
    ranks = rank_table(values, group, value)
    position = F.col("n_less") + (F.col("n_equal") + 1) / F.lit(2.0)
    scored = ranks.select(
        *group,
        value,
        position.alias("rank_position"),
        (position / F.col("n_group") * 100).alias("percentile"),
        F.col("n_group").alias("eligible_count"),
    )
    return join_ranks(values, scored, group, value)


def feature_percentiles(
    master: DataFrame, policy: dict[str, tuple] | None = None, ids: Sequence[str] = ("symbol", "date"), by: Sequence[str] = ()
) -> DataFrame:
    """Raw value, scored value, percentile, rank and count of every feature, side by side. ``ids`` name a row; rows are
    ranked with those of the same ``by`` (such as an as-of day, part of the result), all together without it."""
    policy = policy or RANK_POLICY
    require_columns(master, [c for f, (s, _, _) in policy.items() for c in (f, s)], "percentile input")
    stocks = master.where(~F.col("is_benchmark"))
    ids = [*ids, *[c for c in by if c not in ids]]
    sources = {f: s for f, (s, _, _) in policy.items()}
    pairs = [
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("raw"), F.col(s).cast("double").alias("value"))
        for f, s in sources.items()
    ]
    ranked = percentile_ranks(stocks.select(*ids, F.inline(F.array(*pairs))), [*by, "feature"])
    picked = F.struct("raw", "value", "percentile", "rank_position", "eligible_count")
    wide = ranked.groupBy(*ids).agg(
        *[F.first(F.when(F.col("feature") == f, picked), ignorenulls=True).alias(f"_{f}") for f in policy]
    )
    columns: list[Column] = [F.col(c) for c in ids]
    for f, (_, direction, score) in policy.items():
        columns += [
            F.col(f"_{f}.raw").alias(f"{f}_raw"),
            F.col(f"_{f}.value").alias(f"{f}_scoring_value"),
            F.col(f"_{f}.percentile").alias(f"{f}_percentile"),
            F.col(f"_{f}.rank_position").alias(f"{f}_rank_position"),
            F.col(f"_{f}.eligible_count").alias(f"{f}_eligible_count"),
        ]
        adjusted = direction_adjusted(F.col(f"_{f}.percentile"), direction)
        if score and adjusted is not None:
            columns.append(adjusted.alias(score))
    return wide.select(*columns)


def policy_table(master: DataFrame, policy: dict[str, tuple] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """How each feature is ranked and how many points one rank step is worth, per value of ``by`` where it is given."""
    policy = policy or RANK_POLICY
    stocks = master.where(~F.col("is_benchmark"))
    values = long_features(stocks, [s for s, _, _ in policy.values()], ids=by)
    counts = values.groupBy(*by, F.col("feature").alias("scoring_source")).agg(F.count("value").alias("eligible_count"))
    rows = [
        F.struct(
            F.lit(f).alias("feature"), F.lit(s).alias("source"), F.lit(d).alias("direction"),
            F.lit(score or "none").alias("direction_adjusted_score"),
        )
        for f, (s, d, score) in policy.items()
    ]
    return (
        counts.withColumn("_p", F.explode(F.array(*rows)))
        .where(F.col("_p.source") == F.col("scoring_source"))
        .select(
            *by, "_p.feature", "scoring_source", "_p.direction", "_p.direction_adjusted_score", "eligible_count",
            F.try_divide(F.lit(100.0), F.col("eligible_count")).alias("approximate_rank_step_points"),
            F.lit(True).alias("magnitude_preserved_in_raw_column"),
        )
    )


def weighted_score(weights: dict[str, float], require_all: bool = True) -> tuple[Column, Column]:
    """Score and coverage columns: the weighted mean over the available inputs.

    Completeness is decided by counting inputs, not by comparing a sum of weights with one.
    """
    if abs(sum(weights.values()) - 1.0) > 1e-12:
        raise ValueError("weights must sum to 1")
    zero = F.lit(0.0)
    present = {c: F.col(c).isNotNull() for c in weights}
    n_present = sum((F.when(p, 1).otherwise(0) for p in present.values()), F.lit(0))
    partial = sum((F.when(present[c], F.lit(w)).otherwise(zero) for c, w in weights.items()), zero)
    coverage = F.when(n_present == len(weights), F.lit(1.0)).otherwise(partial)
    total = sum((F.when(present[c], F.col(c) * w).otherwise(zero) for c, w in weights.items()), zero)
    score = F.when(n_present > 0, total / coverage)
    if require_all:
        score = F.when(n_present == len(weights), score)
    return score, coverage


def add_subscores(percentiles: DataFrame) -> DataFrame:
    momentum, momentum_cover = weighted_score(MOMENTUM_WEIGHTS)
    quality, quality_cover = weighted_score(QUALITY_WEIGHTS)
    df = percentiles.withColumns(
        {
            "momentum_subscore": momentum,
            "momentum_subscore_coverage": momentum_cover,
            "quality_subscore": quality,
            "quality_subscore_coverage": quality_cover,
            "valuation_subscore": F.col("valuation_score"),
            "valuation_subscore_coverage": F.col("valuation_score").isNotNull().cast("double"),
        }
    )
    composite, coverage = weighted_score(COMPOSITE_WEIGHTS, require_all=False)
    available = sum((F.col(c).isNotNull().cast("long") for c in COMPOSITE_WEIGHTS), F.lit(0).cast("long"))
    return df.withColumns(
        {
            "composite_score": composite,
            "score_coverage": coverage,
            "intended_components_available": available,
            "incomplete_score_flag": available < len(COMPOSITE_WEIGHTS),
            # Sums of weights need not be exact in binary, hence the small allowance.
            "score_eligible": coverage >= MINIMUM_COVERAGE - 1e-9,
        }
    )


def add_score_rank(scores: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Rank 1 for the highest eligible composite; equal scores share the better rank."""
    df = scores.withColumn("_eligible_score", F.when(F.col("score_eligible"), F.col("composite_score")))
    ranks = rank_table(df, group, "_eligible_score").select(
        *group, "_eligible_score", (F.col("n_group") - F.col("n_less") - F.col("n_equal") + 1).alias("score_rank")
    )
    return join_ranks(df, ranks, group, "_eligible_score").drop("_eligible_score")


CONTEXT_COLUMNS = [
    "beta_252", "volatility_20d_annualized", "rsi_14", "drawdown",
    "drawdown_resilience_score", "pe_exclusion_reason", "unusual_margin_flag",
]


def composite_scores(percentiles: DataFrame, context: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Scores and ranks; with ``by`` each of its values (such as an as-of day) is a ranking of its own."""
    df = add_score_rank(add_subscores(percentiles), by)
    if context is not None:
        keys = ["symbol", *by]
        kept = [c for c in CONTEXT_COLUMNS if c in context.columns and c not in df.columns]
        df = df.join(one_row_each(context.select(*keys, *kept), keys, "score context"), keys, "left")
    return df.withColumns(
        {
            "beta_role": F.lit("risk/sensitivity context; excluded from composite"),
            "score_interpretation": F.lit(
                "experimental relative attractiveness; inspect raw values, coverage, and risk context"
            ),
        }
    )


def percent_text(share: Column) -> Column:
    return F.format_string("%.0f%%", F.bround(share.cast("double") * 100, 0))


def add_labels(scores: DataFrame) -> DataFrame:
    needed = [
        "symbol", "momentum_subscore", "quality_subscore", "valuation_subscore",
        "composite_score", "score_coverage", "incomplete_score_flag", "score_eligible",
    ]
    require_columns(scores, needed, "signal input")
    df = scores.withColumns(
        {
            "momentum_label": score_label(F.col("momentum_subscore")),
            "fundamentals_label": score_label(F.col("quality_subscore")),
            "valuation_label": score_label(F.col("valuation_subscore")),
            "overall_label": score_label(F.col("composite_score")),
            "signal_is_eligible": F.col("score_eligible") & F.col("composite_score").isNotNull(),
        }
    )
    partial = F.concat(F.col("overall_label"), F.lit(" (Incomplete: "), percent_text(F.col("score_coverage")), F.lit(" coverage)"))
    return df.withColumns(
        {
            "overall_display_label": F.when(F.col("composite_score").isNull(), "Unavailable")
            .when(F.col("incomplete_score_flag"), partial)
            .otherwise(F.col("overall_label")),
            "signal_note": F.when(~F.col("signal_is_eligible"), "Below minimum score coverage; do not rank")
            .when(
                F.col("incomplete_score_flag"),
                "Composite renormalized because one or more sub-scores are unavailable",
            )
            .otherwise("Full intended score coverage"),
            "risk_context_note": F.lit("Beta, volatility, RSI, and drawdown are context; not label inputs"),
        }
    )


def label_distribution(labels: DataFrame, column: str = "overall_label") -> DataFrame:
    return labels.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
