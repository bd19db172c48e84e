"""Packed token matrices by best-fit-decreasing.

Token ids of documents fill rows of a fixed length. A document longer than a row is cut into full rows and a
rest, nothing is lost. Pieces go in order of falling length into the open row with the least room that still
holds them; a segment tree over amounts of room finds it. Beside its ids a row has the cumulative lengths of its
segments, as attention kernels take them, and positions that begin again at each segment.

A task packs stretches of at most `buffer_tokens` of its input. Rows of different stretches do not mix, which
leaves a few rows per stretch partly filled, and needs neither an exchange nor more memory for more input.

Null and empty texts have the end id only. Repeated rows are packed each.
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

ROW = 2048
END = 50256
BUFFER_TOKENS = 2_000_000


class RoomTree:
    """Segment tree over amounts of room: how many open rows have each, and the least amount from some need on."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += n
            i >>= 1

    def at_least(self, need: int) -> int:
        """The least room that is no less than the need, or -1."""
        i = self.leaves + need
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, row: int) -> list[list[int]]:
    """Pieces of each row, in order of placement; no length may exceed the row."""
    tree, open_rows, rows = RoomTree(row), [[] for _ in range(row + 1)], []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[piece])
        room = tree.at_least(length)
        if room < 0:
            rows.append([])
            target, room = len(rows) - 1, row
        else:
            target = open_rows[room].pop()
            tree.add(room, -1)
        rows[target].append(piece)
        if room > length:
            open_rows[room - length].append(target)
            tree.add(room - length, 1)
    return rows


def pack_rows(docs: DataFrame, vocabulary: str | None = None, row: int = ROW, end: int | None = END, pad: int = 0, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """One matrix row each: sequence_id, n_tokens, ids (`row` little-endian unsigned 32-bit ids, padded behind),
    doc_ids, starts (of each segment in its document), cumulative (0 and the end of each segment), positions.
    """
    vocabulary = vocabulary or tokenizer_path("byte_bpe_50k.json")

    def packed(pieces: list[tuple]) -> pa.RecordBatch:
        lengths = np.array([len(p[2]) for p in pieces])
        columns: list[list] = [[] for _ in range(6)]
        for chosen in best_fit_decreasing(lengths, row):
            held = np.full(row, pad, dtype="<u4")
            edges = np.concatenate([[0], np.cumsum(lengths[chosen])])
            positions = np.arange(row, dtype=np.int32)
            for piece, a, b in zip(chosen, edges[:-1], edges[1:]):
                held[a:b] = pieces[piece][2]
                positions[a:b] -= a
            positions[edges[-1] :] = 0
            for column, value in zip(columns, (int(edges[-1]), held.tobytes(), [pieces[p][0] for p in chosen], [pieces[p][1] for p in chosen], edges.tolist(), positions)):
                column.append(value)
        kinds = (pa.int64(), pa.binary(), pa.list_(doc_kind), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n_tokens", "ids", "doc_ids", "starts", "cumulative", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, pieces, held = tokens.load(vocabulary), [], 0
        for batch in W.slices(batches, "text"):
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = tokens.encode(encoding, text, end)
                for start in range(0, len(ids), row):
                    pieces.append((key, start, ids[start : start + row]))
                    held += len(pieces[-1][2])
                    if held >= buffer_tokens:
                        yield packed(pieces)
                        pieces, held = [], 0
        if pieces:
            yield packed(pieces)

    kind = docs.schema["doc_id"].dataType.simpleString()
    doc_kind = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = f"n_tokens bigint, ids binary, doc_ids array<{kind}>, starts array<bigint>, cumulative array<int>, positions array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("sequence_id", F.monotonically_increasing_id())


def write_matrix(rows: DataFrame, path: str) -> None:
    """Parquet with one matrix row per record; `ids` and `positions` have a fixed length."""
    rows.select("sequence_id", "n_tokens", "ids", "cumulative", "positions", "doc_ids", "starts").write.parquet(path)
