"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

Spark cuts texts into words by the tokenizer's pattern and hands each task batches of word lists. A task
keeps one row per distinct word: the recursive query holds (word, position, id) rows, joins adjacent ids with
the merge table, contracts each word's leftmost pair of least rank, and ends when no word has a pair left. Equal
pairs of that rank further right are contracted in the same round, each free of the one before it: no pair that
this makes can have a lower rank, except for tokens that the merge table itself shows to be part of an earlier
one; for those a round contracts one pair. Only the last state of a word is kept, and only words that still have a
pair take part in a round, so memory follows the bytes of a round (`ROUND_BYTES`), whatever the words are like.
Decoding joins ids with the vocabulary and concatenates their bytes in order of position. A document is its
words in order, so ids and bytes of documents are put together from those of words.

A word that is a token itself is that token, as in the tiktoken library. A single word above `LONG_WORD` bytes without
any break would keep a task in the query for minutes (200,000 random letters: over one); such a word is merged with a
heap instead, with the same result.

Null text counts as empty: no ids, no bytes. Repeated rows give equal rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import os
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from public_tokenizers import PATTERN
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the words of one recursive query (or one word), bytes of words that a task remembers, words of one slice of documents.
ROUND_BYTES = 400_000
REMEMBERED_BYTES = 16 << 20
SLICE_WORDS = 400_000
LONG_WORD = 16_384

MERGE_QUERY = """
WITH RECURSIVE step(word, pos, id) USING KEY (word, pos) AS (
    SELECT word, pos, id FROM bytes_of_words
    UNION ALL
    (
        WITH pairs AS (
            SELECT word, pos, id, lead(pos) OVER w AS next_pos, lead(id) OVER w AS next_id, row_number() OVER w AS place
            FROM step WHERE id >= 0 WINDOW w AS (PARTITION BY word ORDER BY pos)
        ), found AS (
            SELECT p.word, p.pos, p.next_pos, p.place, m.rank, m.alone FROM pairs p JOIN merges m ON m.left_id = p.id AND m.right_id = p.next_id
        ), best AS (
            SELECT word, min(rank) AS least FROM found GROUP BY word
        ), equal_pairs AS (
            SELECT f.*, f.place - row_number() OVER w AS chain, row_number() OVER w AS nth
            FROM found f JOIN best b ON b.word = f.word AND b.least = f.rank WINDOW w AS (PARTITION BY f.word ORDER BY f.pos)
        ), taken AS (
            SELECT word, pos, next_pos, rank
            FROM (SELECT *, row_number() OVER (PARTITION BY word, chain ORDER BY pos) AS link FROM equal_pairs)
            WHERE CASE WHEN alone THEN nth = 1 ELSE link % 2 = 1 END
        ), changed AS (
            SELECT word, pos, rank AS id FROM taken UNION ALL SELECT word, next_pos, -1 FROM taken
        )
        SELECT p.word, p.pos, coalesce(c.id, p.id) FROM pairs p SEMI JOIN best ON best.word = p.word LEFT JOIN changed c ON c.word = p.word AND c.pos = p.pos
    )
)
SELECT word, pos, id FROM step WHERE id >= 0
"""

DECODE_QUERY = """
SELECT t.word, count(*) AS n, string_agg(t.id::VARCHAR, ' ' ORDER BY t.pos) AS ids,
       unhex(string_agg(v.hex, '' ORDER BY t.pos)) AS bytes
FROM tokens t JOIN vocabulary v ON v.id = t.id
GROUP BY t.word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: a heap of pairs by (rank, position) over a linked list of parts."""
    ends = list(range(1, len(word) + 1))
    after = [*range(1, len(word)), -1]
    before = list(range(-1, len(word) - 1))
    alive = [True] * len(word)
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (rank := ranks.get(word[i : ends[j]])) is not None:
            heapq.heappush(heap, (rank, i, ends[i], ends[j]))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, middle, end = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or ends[i] != middle or ends[j] != end:
            continue
        ends[i], after[i], alive[j] = end, after[j], False
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : ends[i]]] for i in range(len(word)) if alive[i]]


class WordCoder:
    """Merge table and vocabulary in a DuckDB connection of this process, with the words coded so far."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        merges = [
            (left, right, rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
        ]
        #: Tokens that are part of an earlier one.
        early = {part for left, right, rank in merges for part in (left, right) if rank < part}
        # What a very long word needs beyond the memory goes to this process's own temporary folder.
        spill = os.path.join(tempfile.gettempdir(), f"merges-{os.getpid()}")
        self.connection = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": spill})
        kinds = pa.int32()
        merge_rows = pa.table([pa.array(c, kinds) for c in zip(*merges)] if merges else [pa.array([], kinds)] * 3, ["left_id", "right_id", "rank"])
        merge_rows = merge_rows.append_column("alone", pa.array([rank in early for _, _, rank in merges], pa.bool_()))
        vocabulary_rows = pa.table({"id": pa.array(self.ranks.values(), kinds), "hex": [token.hex() for token in self.ranks]})
        for name, rows in (("merges", merge_rows), ("vocabulary", vocabulary_rows)):
            self.connection.register("rows", rows)
            self.connection.sql(f"CREATE TABLE {name} AS SELECT * FROM rows")
        self.connection.unregister("rows")
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.known_bytes = 0

    def merge(self, words: list[bytes]) -> pa.Table:
        """(word, pos, id) of every token; word is the position in the list."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rows = pa.table({
            "word": pa.array(np.repeat(np.arange(len(words)), lengths), pa.int32()),
            "pos": pa.array(place, pa.int32()),
            "id": pa.array(self.byte_id[data], pa.int32()),
        })
        self.connection.register("bytes_of_words", rows)
        return self.connection.sql(MERGE_QUERY).to_arrow_table()

    def tokens_of(self, words: list[bytes]) -> pa.Table:
        """Token rows of words: whole tokens, what the query makes of the others, and very long words."""
        ready = [(i, 0, self.ranks[w]) for i, w in enumerate(words) if w in self.ranks]
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                ready += [(i, pos, rank) for pos, rank in enumerate(merge_by_heap(w, self.ranks))]
        rest = np.array([i for i, w in enumerate(words) if len(w) <= LONG_WORD and w not in self.ranks], dtype=np.int32)
        parts = [pa.table([pa.array(c, pa.int32()) for c in zip(*ready)], ["word", "pos", "id"])] if ready else []
        if len(rest):
            merged = self.merge([words[i] for i in rest])
            parts.append(merged.set_column(0, "word", pa.array(rest[merged.column("word").to_numpy()])))
        return pa.concat_tables(parts)

    def code(self, words: list[str]) -> list[tuple[int, str, bytes]]:
        """Number of ids, ids joined by a space, and bytes decoded from those ids, of each word."""
        if self.known_bytes > REMEMBERED_BYTES:
            self.known, self.known_bytes = {}, 0
        known = self.known
        new = [w.encode() for w in words if w not in known]
        ends = np.cumsum([len(w) for w in new])
        start = 0
        while start < len(new):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + ROUND_BYTES, side="right")))
            part = new[start:stop]
            self.connection.register("tokens", self.tokens_of(part))
            coded = self.connection.sql(DECODE_QUERY).to_arrow_table()
            for word, n, ids, decoded in zip(*(coded.column(c).to_pylist() for c in ("word", "n", "ids", "bytes"))):
                known[part[word].decode()] = (n, ids, decoded)
            self.known_bytes += int(ends[stop - 1] - before)
            start = stop
        return [known[w] for w in words]


@functools.lru_cache(maxsize=1)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def words_of(text: Column) -> Column:
    """The matches of the tokenizer's pattern, in order; white space and classes as in Unicode."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + PATTERN), F.lit(0))


def _documents(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list]]:
    """Slices of documents with their word numbers, the bounds of documents in them, and the coded words."""
    words = coder(path)
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_WORDS, side="right")))
            part = batch.slice(start, stop - start)
            flat = part.column("words").flatten().dictionary_encode()
            bounds = np.concatenate([[0], np.cumsum(sizes[start:stop])])
            yield part, flat.indices.to_numpy(zero_copy_only=False), bounds, words.code(flat.dictionary.to_pylist())
            start = stop


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, word, bounds, coded in _documents(batches, path):
            ids = [np.array(c[1].split(), dtype=np.int32) for c in coded]
            rows = [np.concatenate([ids[w] for w in word[a:b]]) if b > a else np.zeros(0, np.int32) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", words_of(F.col("text")).alias("words")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text bytes of each row of ids; a null list gives no bytes, an unknown id fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connection, known = coder(path).connection, coder(path).byte_id
        assert known is not None
        for batch in batches:
            lists = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            connection.register("tokens", pa.table({"word": pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()), "pos": pa.array(place, pa.int32()), "id": flat}))
            rows = connection.sql(DECODE_QUERY).to_arrow_table()
            if pc.sum(rows.column("n")).as_py() not in (len(flat), None if not len(flat) else -1):
                raise ValueError("an id is not in the vocabulary")
            found = dict(zip(rows.column("word").to_pylist(), rows.column("bytes").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([found.get(i, b"") for i in range(len(sizes))], pa.binary())], ["doc_id", "bytes"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids in decimal and of the bytes decoded from them; no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, word, bounds, coded in _documents(batches, path):
            count = np.array([c[0] for c in coded], dtype=np.int64)
            ids = np.array([c[1] for c in coded], dtype=object)
            decoded = np.array([c[2] for c in coded], dtype=object)
            n, of_ids, of_bytes = [], [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = word[a:b]
                n.append(int(count[own].sum()) if b > a else 0)
                of_ids.append(hashlib.sha256(" ".join(ids[own]).encode() if b > a else b"").hexdigest())
                of_bytes.append(hashlib.sha256(b"".join(decoded[own]) if b > a else b"").hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", words_of(F.col("text")).alias("words")).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
