"""A corpus from raw documents to training sequences.

Stages in order: quality rules, toxicity, line dedup, similarity join, packing. Each takes the documents that
the one before kept; all but the last return the columns of documents. n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import jaccard_join, line_dedup, packing, quality, toxicity
from tickerloom.llm.staging import Stages


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the compression bands and the base rules."""
    return quality.filter_quality(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score below one half; the classifier learns from the labelled ones among them."""
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return toxicity.filter_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without runs of lines that an earlier one has. Those of which nothing is left go."""
    cut = line_dedup.dedup_lines(docs)
    left = cut.filter((F.col("n_removed") == 0) | (F.col("n_lines") > F.col("n_removed")))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Power-of-two pieces of token ids, a sequence each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("packing", pack),
]

#: Compressors, learned scores and tokenizers have no SQL form; tests/llm/test_pipeline.py holds the stages to their rules.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The last stage's rows over the documents table; each stage is written and read again."""
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stages.put(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
