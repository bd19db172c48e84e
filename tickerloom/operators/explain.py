"""Plain-language context of one row against its peers, for all rows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.constants import CONCLUSION_PROMPT, RSI_LINES
from tickerloom.functions.scalars import kept
from tickerloom.operators.order_stats import join_ranks, rank_table
from tickerloom.operators.scoring import percent_text

# key -> (column, label, suffix of the shown value, meaning)
CONTEXTS = {
    "valuation": (
        "pe_ratio_raw", "P/E", "",
        "A higher P/E means investors pay more per dollar of earnings and may increase downside risk if growth slows.",
    ),
    "profitability": (
        "profit_margin_raw_pct", "Profit margin %", "%",
        "A higher margin indicates more profit retained per dollar of revenue, but durability still needs investigation.",
    ),
    "risk": (
        "volatility_pct", "20D annualized volatility %", "%",
        "Higher volatility means a wider range of recent price outcomes, not necessarily a worse company.",
    ),
}


def peer_percentiles(df: DataFrame, columns: list[str], benchmark: str = "SPY") -> DataFrame:
    """Share of the stocks (benchmark excluded) at or below each row's value, times 100, and its band.

    The benchmark row is measured against the stocks too. Output: ``symbol, field, value, n_peers,
    peer_percentile, band``.
    """
    stacked = [F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in columns]
    values = df.select("symbol", F.inline(F.array(*stacked)))
    peers = F.col("symbol") != benchmark
    ranks = rank_table(values.where(peers), ["field"], "value").select(
        "field", "value", (F.col("n_less") + F.col("n_equal")).alias("at_or_below"), F.col("n_group").alias("n_peers")
    )
    members = join_ranks(values.where(peers), ranks, ["field"], "value")
    # The benchmark has one value per field, so peers at or below it are counted, not ranked.
    base = values.where(~peers).groupBy("field").agg(F.max("value").alias("v"))
    outside = (
        values.where(peers).join(F.broadcast(base), "field")  # one row per field
        .groupBy("field")
        .agg(F.count_if(F.col("value") <= F.col("v")).alias("at_or_below"), F.count("value").alias("n_peers"))
    )
    benchmark_rows = values.where(~peers).join(F.broadcast(outside), "field", "left")
    share = F.when(F.col("value").isNotNull(), F.try_divide("at_or_below", "n_peers") * 100)
    return (
        members.unionByName(benchmark_rows)
        .withColumn("peer_percentile", share)
        .withColumn("band", band(F.col("peer_percentile")))
        .drop("at_or_below")
    )


def band(percentile: Column) -> Column:
    return F.when(percentile >= 67, "high").when(percentile <= 33, "low").when(percentile.isNotNull(), "middle-range")


def context_texts(df: DataFrame, benchmark: str = "SPY") -> DataFrame:
    """``symbol, context, label, value, status, peer_position, meaning`` for three measures and RSI."""
    columns = {key: spec[0] for key, spec in CONTEXTS.items()}
    ranked = peer_percentiles(df, list(columns.values()), benchmark)
    suffix = {spec[0]: spec[2] for spec in CONTEXTS.values()}
    key_of = {spec[0]: key for key, spec in CONTEXTS.items()}

    def by_field(table: dict[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for field, text in table.items():
            out = F.when(F.col("field") == field, F.lit(text)).otherwise(out)
        return out

    missing, alone = F.col("value").isNull(), F.col("peer_percentile").isNull()
    meaning = by_field({spec[0]: spec[3] for spec in CONTEXTS.values()})
    relative = ranked.select(
        "symbol",
        by_field(key_of).alias("context"),
        by_field({spec[0]: spec[1] for spec in CONTEXTS.values()}).alias("label"),
        F.when(missing, "N/A").otherwise(F.concat(F.format_string("%.1f", F.col("value")), by_field(suffix))).alias("value_text"),
        F.when(missing, "Unavailable").when(alone, "Context unavailable").otherwise(F.initcap("band")).alias("status"),
        F.when(missing, "Peer position cannot be calculated.")
        .when(alone, "No valid peer observations are available.")
        .otherwise(
            F.concat(
                F.lit("Higher than approximately "),
                F.format_string("%.0f%%", F.bround("peer_percentile", 0)),
                F.lit(" of "), F.col("n_peers").cast("string"), F.lit(" valid stocks."),
            )
        ).alias("peer_position"),
        F.when(missing, "Missing data is not treated as zero or favorable evidence.").otherwise(meaning).alias("meaning"),
    )
    return relative.unionByName(df.select("symbol", *_rsi_context()))


def context_lines(df: DataFrame, benchmark: str = "SPY") -> DataFrame:
    """``symbol, context, line, conclusion_prompt``: each context as one sentence."""
    texts = context_texts(df, benchmark)
    number = F.regexp_extract("value_text", "^-?[0-9.]+", 0)
    share = F.regexp_extract("peer_position", "([0-9]+%) of ([0-9]+)", 1)
    peers = F.regexp_extract("peer_position", "([0-9]+%) of ([0-9]+)", 2)
    relative = (
        F.when(F.col("status") == "Unavailable", F.lit(": unavailable; do not infer a zero or a favorable result."))
        .when(F.col("status") == "Context unavailable", F.concat(F.lit(": "), number, F.lit("; peer context unavailable.")))
        .otherwise(F.concat(
            F.lit(": "), number, F.lit(" ("), F.lower("status"), F.lit("; higher than about "), share, F.lit(" of this "), peers,
            F.lit("-stock universe). "), F.col("meaning"),
        ))
    )
    rsi = (
        F.when(F.col("status") == "Unavailable", F.lit(": unavailable because there is insufficient usable price history."))
        .when(F.col("status") == "Above 70", F.concat(F.lit(": "), number, F.lit(RSI_LINES["above"])))
        .when(F.col("status") == "Below 30", F.concat(F.lit(": "), number, F.lit(RSI_LINES["below"])))
        .otherwise(F.concat(F.lit(": "), number, F.lit(RSI_LINES["between"])))
    )
    line = F.concat(F.col("label"), F.when(F.col("context") == "momentum", rsi).otherwise(relative))
    return texts.select("symbol", "context", line.alias("line"), F.lit(CONCLUSION_PROMPT).alias("conclusion_prompt"))


def _rsi_context() -> list[Column]:
    rsi = F.col("rsi_14")
    zones = [
        (rsi.isNull(), "Unavailable", "No RSI position is inferred.", "Insufficient usable price history."),
        (rsi >= 70, "Above 70", "Above the conventional upper reference zone.",
         "Recent gains are strong, but the move may be overextended; this is not an automatic sell signal."),
        (rsi <= 30, "Below 30", "Below the conventional lower reference zone.",
         "Selling pressure is strong; this is not automatically a buy signal."),
        (F.lit(True), "30–70 range", "Neither conventional RSI reference extreme is active.",
         "Momentum is not currently in an extreme reference zone."),
    ]

    def pick(position: int) -> Column:
        return F.coalesce(*[F.when(zone[0], F.lit(zone[position])) for zone in zones])

    return [
        F.lit("momentum").alias("context"),
        F.lit("RSI 14").alias("label"),
        F.when(rsi.isNull(), "N/A").otherwise(F.format_string("%.1f", rsi)).alias("value_text"),
        pick(1).alias("status"), pick(2).alias("peer_position"), pick(3).alias("meaning"),
    ]


def evidence_lists(df: DataFrame) -> DataFrame:
    """Strengths, cautions and data gaps of each row as arrays of text."""
    labelled = {"Momentum": "momentum_label", "Fundamentals": "fundamentals_label", "Valuation": "valuation_label"}
    strengths, cautions, gaps = [], [], []
    for name, column in labelled.items():
        label = F.col(column)
        text = F.concat(F.lit(f"{name}: "), label)
        strengths.append(F.when(label.isin("Strong", "Positive"), text))
        cautions.append(F.when(label.isin("Weak", "Very Weak"), text))
        gaps.append(F.when(label.isNull() | (label == "Unavailable"), F.lit(f"{name} score unavailable")))
    beta, cover = F.col("beta_252_raw"), F.col("score_coverage")
    gaps.append(F.when(beta.isNull(), "252-day beta unavailable"))
    cautions.append(
        F.when(beta > 1.5, F.format_string("Beta %.2f: historically more market-sensitive than the benchmark", beta))
    )
    gaps.append(
        F.when(cover.isNull(), "Composite-score coverage unavailable").when(
            cover < 1,
            F.concat(F.lit("Composite score uses only "), percent_text(cover), F.lit(" of intended component weight")),
        )
    )
    return df.select(
        "symbol",
        kept(strengths).alias("strengths"),
        kept(cautions).alias("cautions"),
        kept(gaps).alias("data_gaps"),
        F.coalesce("overall_display_label", F.lit("Unavailable")).alias("overall"),
    )
