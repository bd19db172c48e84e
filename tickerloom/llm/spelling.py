"""Spelling variants: Gram matrices of letter counts in blocks of words.

A word is a vector of letter counts. One inserted, deleted or replaced letter moves it by a squared distance of 1 or 2,
so NumPy products of blocks of such vectors (a Gram matrix gives all squared distances of two blocks) leave few pairs, and
only pairs of equal or adjacent length at most two apart are compared letter by letter.

Which words share a block: letters are dealt into five groups. An edit changes the counts of at most two letters, so of
at most two groups; two near words agree on the counts of three groups at least. Each word is therefore posted under
each choice of three groups with its counts there (ten postings), sorted by length, and a pair is taken from the first
choice on which it agrees. This is exact for any words. A choice held by very many words is cut into parts, and pairs of
parts go to different tasks; a task holds two parts at a time.

Words are runs of the letters A-Z, a-z and U+00C0-U+00FF with A-Z lower-cased. Null and empty texts have none; a null
doc_id counts as empty text in the checksum; repeated rows count again; ties of the largest n go to the smallest word in
code-point order. Words of any length are whole.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import words as w
from tickerloom.llm.staging import Stages

#: Fixed values of the contract: the shortest word, the rarest, one run in so many that loses a letter, and how many
#: times as frequent a form is.
LEAST_LETTERS = 7
LEAST_COUNT = 2
DROP_ONE_IN = 31
FORM_RATIO = 10

LETTERS = 26 + 64
GROUPS = 5
SHARED = 3
TILE = 512
#: Words of one choice beyond which it is cut into parts of about half as many.
HOT = 4096
#: Words up to this length are compared in one padded matrix, longer ones pair by pair.
PADDED = 48

_CHOICES = list(itertools.combinations(range(GROUPS), SHARED))
#: By which groups agree (a bit each): the first choice that does.
_FIRST = np.array([next((i for i, c in enumerate(_CHOICES) if all(bits >> g & 1 for g in c)), -1) for bits in range(1 << GROUPS)])

_IN_RUN = np.zeros(256, dtype=bool)
_IN_RUN[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


# ---- words of texts ----


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def _checksums(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span's bytes, going on from the checksum of what stands before it."""
    crc, order = state ^ np.uint32(0xFFFFFFFF), np.argsort(starts - ends, kind="stable")
    crc, starts, lengths = crc[order], starts[order], (ends - starts)[order]
    alive, j = len(order), 0
    while alive:
        part = crc[:alive]
        crc[:alive] = _CRC[(part ^ data[starts[:alive] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
        j += 1
        alive = int(np.searchsorted(-lengths[:alive], -j, side="left")) if alive else 0
    out = np.empty(len(order), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of letters: first byte, byte after the last, number of the text, length in code points."""
    inside = _IN_RUN[data]
    lead = np.flatnonzero(data == 0xC3)  # U+00C0-U+00FF are the characters that begin with this byte
    inside[lead] = True
    inside[lead + 1] = True
    starts, ends, text = w.spans(inside, bounds)
    pairs = np.searchsorted(lead, ends) - np.searchsorted(lead, starts)
    return starts, ends, text, ends - starts - pairs


def _pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as one column of strings."""
    lengths = ends - starts
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - starts, lengths)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[at].tobytes()))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in w.slices(batches, "text", 4 * w.SLICE_BYTES):
        data, bounds = w.text_bytes(part.column("text"), fold_case=True)
        starts, ends, text, letters = runs(data, bounds)
        long = letters >= LEAST_LETTERS
        starts, ends, text, letters = starts[long], ends[long], text[long], letters[long]
        if not len(starts):
            continue
        prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in part.column("id").to_pylist()], dtype=np.uint32)
        crc = _checksums(prefix[text], data, starts, ends)
        hit = crc % DROP_ONE_IN == 0
        whole = _pieces(data, starts[~hit], ends[~hit])
        cut = []
        for a, b, c, n in zip(starts[hit].tolist(), ends[hit].tolist(), crc[hit].tolist(), letters[hit].tolist()):
            if n > LEAST_LETTERS:
                run = data[a:b].tobytes().decode()
                cut.append(run[: c % n] + run[c % n + 1 :])
        counts = pc.value_counts(pa.concat_arrays([whole, pa.array(cut, pa.large_string())]))
        yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], names=["word", "n"])


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`word, n`: words of at least LEAST_LETTERS letters that occur LEAST_COUNT times or more."""
    source = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- blocks ----


class _Words:
    """Letters of words as codes 0-89, counts of letters, and one number for the counts of each group."""

    def __init__(self, column: pa.Array):
        data, bounds = w.text_bytes(column)
        lead = data == 0xC3
        upto = np.concatenate([[0], np.cumsum(~lead)])
        self.start = upto[bounds]
        codes = data[~lead].astype(np.int64)
        self.codes = np.where(codes < 0x80, codes - 0x61, codes - 0x80 + 26).astype(np.uint8)
        self.length = np.diff(self.start)
        row = np.repeat(np.arange(len(column)), self.length)
        self.counts = np.bincount(row * LETTERS + self.codes, minlength=len(column) * LETTERS).reshape(-1, LETTERS)
        # Letter l belongs to group l % GROUPS: neighbours in the alphabet go to different groups.
        marked = (self.counts.astype(np.uint64) * _MARK).reshape(len(column), LETTERS // GROUPS, GROUPS)
        self.groups = marked.sum(axis=1, dtype=np.uint64)


#: A 64-bit number for each letter; the counts of a group become one sum.
_MARK = w.mix(np.arange(1, LETTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ten postings of each word."""
    for part in w.slices(batches, "word"):
        found = _Words(part.column("word"))
        n = part.num_rows
        for i, choice in enumerate(_CHOICES):
            key = np.full(n, i + 1, np.uint64)
            for g in choice:
                key = w.mix(key + found.groups[:, g])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(found.length.astype(np.int64)), part.column("word"), part.column("n")],
                names=["block", "letters", "word", "n"],
            )


class _Block:
    """Postings of one stretch of sorted rows."""

    def __init__(self, batch: pa.RecordBatch):
        self.words = batch.column("word")
        self.n = batch.column("n").to_numpy()
        self.cell = np.stack([batch.column(c).to_numpy() for c in ("block", "low", "high")], axis=1)
        self.key = np.ascontiguousarray(self.cell[:, 0])
        self.part = batch.column("part").to_numpy()
        self.letters = batch.column("letters").to_numpy()
        found = _Words(self.words)
        self.groups, self.codes, self.start = found.groups, found.codes, found.start
        # Counts are whole numbers; single precision holds their products up to 2**24.
        kind = np.float32 if self.letters.max() < 1 << 11 else np.float64
        counts = found.counts.astype(kind)
        square = (counts * counts).sum(axis=1)[:, None]
        one = np.ones_like(square)
        # One product of `left` and `right` is the matrix of squared distances: a.a + b.b - 2 a.b.
        self.left, self.right = np.hstack([counts, square, one]), np.hstack([-2 * counts, one, square])
        self.padded = np.full((batch.num_rows, PADDED + 2), 255, np.uint8)
        short = np.flatnonzero(self.letters <= PADDED)
        size = self.letters[short]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.padded[np.repeat(short, size), place] = self.codes[np.repeat(self.start[short], size) + place]


def _one_edit_long(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the words differ in one letter; `a` is not longer than `b`."""
    n = len(a)
    if n == len(b):
        return int((a != b).sum()) == 1
    differ = np.flatnonzero(a != b[:n])
    return not len(differ) or bool((a[differ[0] :] == b[differ[0] + 1 :]).all())


def _near(a: _Block, i: np.ndarray, b: _Block, j: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart; word i is not longer than word j, by one at most."""
    out = np.zeros(len(i), dtype=bool)
    long = b.letters[j] > PADDED
    for k in np.flatnonzero(long):
        out[k] = _one_edit_long(a.codes[a.start[i[k]] : a.start[i[k] + 1]], b.codes[b.start[j[k]] : b.start[j[k] + 1]])
    at = np.flatnonzero(~long)
    n = a.letters[i[at]]
    width = int(n.max(initial=0)) + 2
    x, y = a.padded[i[at], :width], b.padded[j[at], :width]
    same = x[:, :-1] == y[:, :-1]
    inside = np.arange(width - 1) < n[:, None]
    replaced = (~same & inside).sum(axis=1) == 1
    before = np.logical_and.accumulate(same | ~inside, axis=1).sum(axis=1)  # past the end nothing differs
    shifted = x[:, :-1] == y[:, 1:]
    after = np.logical_and.accumulate((shifted | ~inside)[:, ::-1], axis=1).sum(axis=1)
    inserted = before + after >= width - 1
    out[at] = np.where(b.letters[j[at]] == n, replaced, inserted)
    return out


def _tile_pairs(a: _Block, rows: slice, b: _Block, columns: slice, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of two tiles, from the Gram matrix of their letter counts."""
    distance = a.left[rows] @ b.right[columns].T
    i, j = np.divmod(np.flatnonzero(distance.ravel() <= 2), distance.shape[1])
    i, j = i + rows.start, j + columns.start
    if same:
        later = i < j
        i, j = i[later], j[later]
    # Rows of one cell are in order of length. Parts of one choice meet in the cell of the two; inside a part only in its own.
    ok = np.flatnonzero(a.key[i] == b.key[j])
    i, j = i[ok], j[ok]
    ok = (a.cell[i] == b.cell[j]).all(axis=1) & ((a.part[i] != b.part[j]) | (a.cell[i, 1] == a.cell[i, 2])) & (b.letters[j] - a.letters[i] <= 1)
    i, j = i[ok], j[ok]
    agree = ((a.groups[i] == b.groups[j]) << np.arange(GROUPS)).sum(axis=1)
    keys = np.full(len(i), 1, np.uint64) + _FIRST[agree].astype(np.uint64)
    chosen = np.stack([np.array(c) for c in _CHOICES])[_FIRST[agree]] if len(i) else np.zeros((0, SHARED), np.int64)
    for g in range(SHARED):
        keys = w.mix(keys + a.groups[i, chosen[:, g]])
    first = keys.view(np.int64) == a.cell[i, 0]
    i, j = i[first], j[first]
    near = _near(a, i, b, j)
    return i[near], j[near]


def _pairs_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`word, n_near, near_n, near`: for each word of a stretch, how many near words it met and the best of them.

    Rows come sorted by cell and length. Stretches are kept only while a later row can still be near: of the same cell
    and at most one letter longer.
    """
    kept: list[_Block] = []
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            block = _Block(batch.slice(at, TILE))
            found = []
            head, least = block.cell[0], block.letters[0]
            kept = [k for k in kept if (k.cell[-1] == head).all() and k.letters[-1] >= least - 1]
            for other in kept:
                # Of the same cell as the first row here: a stretch at the start; a length beyond one more is no partner.
                end = int(np.searchsorted(~(block.cell == head).all(axis=1), True))
                begin = int(np.argmax((other.cell == head).all(axis=1)))
                i, j = _tile_pairs(other, slice(begin, len(other.n)), block, slice(0, end), False)
                found.append((other, i, block, j))
            i, j = _tile_pairs(block, slice(0, len(block.n)), block, slice(0, len(block.n)), True)
            found.append((block, i, block, j))
            kept.append(block)
            yield from _links(found)


def _links(found: list) -> Iterator[pa.RecordBatch]:
    word, near, near_n = [], [], []
    for a, i, b, j in found:
        for x, p, y, q in ((a, i, b, j), (b, j, a, i)):
            if len(p):
                word.append(x.words.take(pa.array(p)))
                near.append(y.words.take(pa.array(q)))
                near_n.append(y.n[q])
    if not word:
        return
    table = pa.table({"word": pa.concat_arrays(word), "near": pa.concat_arrays(near), "near_n": np.concatenate(near_n)})
    table = table.sort_by([("word", "ascending"), ("near_n", "descending"), ("near", "ascending")])
    column = table.column("word").combine_chunks()
    first = np.flatnonzero(np.append(True, pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)))
    best = table.take(pa.array(first)).combine_chunks()
    best = best.append_column("n_near", pa.array(np.diff(np.append(first, len(column))).astype(np.int64)))
    yield from best.select(["word", "n_near", "near_n", "near"]).to_batches()


def near_words(counted: DataFrame) -> DataFrame:
    """`word, n_near, near_n, near`: how many words are one edit away, and the most frequent of them."""
    posted = counted.mapInArrow(_post, "block long, letters long, word string, n long")
    salt = F.pmod(F.xxhash64("word"), F.lit(16))
    hot = (
        posted.groupBy("block").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > HOT)
        .select("block", F.ceil(F.col("held") * 2 / HOT).cast("int").alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    )
    spread = posted.withColumn("salt", salt.cast("int")).join(hot, ["block", "salt"], "left")
    parts = F.coalesce("parts", F.lit(1))
    part: Column = F.pmod(F.xxhash64("word", F.lit(1)), parts).cast("int")
    celled = spread.withColumns({"parts": parts, "part": part}).select(
        "block", "letters", "word", "n", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    )
    celled = celled.select(
        "block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "letters", "word", "n", "part"
    )
    tasks = celled.repartition("block", "low", "high").sortWithinPartitions("block", "low", "high", "letters")
    met = tasks.mapInArrow(_pairs_of_task, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.near").alias("near")
    )


# ---- forms ----


def variants(counted: DataFrame) -> DataFrame:
    """`word, form, root, n, n_near, form_n` of words with their counts (`word, n`; words distinct).

    A form is at least FORM_RATIO times as frequent, so chains of forms are short (19 steps at most with 64-bit counts):
    roots double their reach each round and are whole after five.
    """
    stages = Stages(counted.sparkSession, "spelling")
    words = stages.put(counted)
    joined = words.join(near_words(words), "word", "left")
    is_form = F.col("near_n") >= FORM_RATIO * F.col("n")
    formed = stages.put(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"),
    ))
    stages.drop(words)
    reach = stages.put(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    for _ in range(5):
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = stages.put(reach.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        moved = further.where("moved").limit(1).count()
        stages.drop(reach)
        reach = further.select("word", "root")
        reach._stage_path = further._stage_path
        if not moved:
            break
    return formed.join(reach, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Words of `docs` (`doc_id`, `text`) with their forms."""
    return variants(count_words(docs))
