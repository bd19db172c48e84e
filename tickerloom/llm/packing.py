"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many of the longest length as fit,
then the binary digits of what is left, largest first. A piece is a sequence of its own, so no sequence holds
two documents and none is padded. Pieces of equal length form a bucket; a training job draws each batch from
one bucket, and `write_buckets` lays them out that way.

Null and empty texts have the end id only: one piece of length 1. Repeated rows give pieces of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import tokens
from tickerloom.llm import words as W

LONGEST = 2048
END = 1


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that sum to n: full pieces, then the binary digits of the rest."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if (n % longest) >> b & 1]


def pack(docs: DataFrame, vocabulary: str | None = None, longest: int = LONGEST, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket (log2 of the length), sequence_id, offset, ids.

    ids are little-endian unsigned 32-bit. No exchange: pieces leave the task that read their document, and a
    sequence number is made of the input partition and the row in it.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    vocabulary = vocabulary or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokens.load(vocabulary)
        for batch in W.slices(batches, "text"):
            source, start, length, total, held = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = tokens.encode(encoding, text, end)
                at = 0
                for size in piece_lengths(len(ids), longest):
                    source.append(row)
                    start.append(at)
                    length.append(size)
                    total.append(len(ids))
                    held.append(ids[at : at + size].tobytes())
                    at += size
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(source, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(total, pa.int64()), pa.array(np.log2(length).astype(np.int32)), pa.array(held, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "bucket", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, bucket int, ids binary"
    return (
        docs.select("doc_id", "text").mapInArrow(run, schema)
        .withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder of Parquet files per length."""
    packed.write.partitionBy("bucket").parquet(path)
