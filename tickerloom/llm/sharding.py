"""Sharding by rendezvous hashing of record keys over weighted shards.

Shard i of weight w draws `-ln(u) / w` from the hash u of (key, i); the smallest draw wins. A key's draws
for other shards do not change when shards come or go, so one more shard takes rows only into itself, and
a shard's share is its weight's.

A null key is a key of its own (all such rows share a shard). Repeated rows go to the same shard and get
slots of their own. Null text has size 1 and the checksum of the empty text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickerloom.llm.columns import set_aside
from tickerloom.llm.staging import Stages


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that wins the key."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("every shard needs a weight above zero")

    def draw(i: int, weight: float) -> Column:
        high = F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11)
        uniform = (high.cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(uniform) / weight).alias("draw"), F.lit(i).alias("shard"))

    draws = [draw(i, w) for i, w in enumerate(weights)]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def assign(docs: DataFrame, key: str, weights: Sequence[float], spare_weight: float = 1.0) -> DataFrame:
    """`docs` with `shard`, `slot` (gapless from 0 in each shard) and `grown_shard` (with one more shard).

    Slots: rows are numbered inside (input partition, shard), groups that an input split bounds, and a running
    sum of one count per (partition, shard) gives where each begins. The numbered rows are staged first, since
    a recomputed partition could hold other rows.
    """
    docs, back = set_aside(docs, ["_part", "_row", "_local", "_begin", "_n"])
    spark = docs.sparkSession
    key = next((held for held, column in back.items() if column == key), key)
    grown = [*weights, spare_weight]
    drawn = (
        docs.withColumn("shard", shard_of(F.col(key), weights))
        .withColumn("grown_shard", shard_of(F.col(key), grown))
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    staged = Stages(spark, "sharding").put(drawn)
    begins = (
        staged.groupBy("_part", "shard").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_begin", F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n"))
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy("_part", "shard").orderBy("_row")) - 1
    return (
        staged.withColumn("_local", local)
        .join(begins, ["_part", "shard"])
        .withColumn("slot", (F.col("_begin") + F.col("_local")).cast("long"))
        .select(*[c for c in docs.columns if c not in ("shard", "slot", "grown_shard")], "shard", "slot", "grown_shard")
        .withColumnsRenamed(back)
    )


def write_shards(docs: DataFrame, path: str, key: str, weights: Sequence[float]) -> None:
    """One folder of Parquet files per shard."""
    docs.withColumn("shard", shard_of(F.col(key), weights)).write.partitionBy("shard").parquet(path)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size and checksum of each document; only these leave the scan."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
