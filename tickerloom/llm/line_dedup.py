"""Line dedup by winnowing over line hashes.

A line is a stretch between line feeds that holds a word. A unit is the shortest run of lines from some line
on that has at least `unit_words` words. A window is the shortest run from some line on that has at least
`window_words`; of the units inside a window the one with the least hash (the last, if several) is its
fingerprint. Two documents that share a run of at least `window_words` words share a window and so a
fingerprint, however their other lines differ.

Each fingerprint found more than once is joined to its first position in (doc_id, key, line) order, and so is each
fingerprint together with its window: where a unit is common, its first position may share nothing else. From there
the match is extended line by line both ways, and the run in the later place is removed. Removed lines always
equal lines in an earlier place and have at least `unit_words` words together, and what stays has no run of
`window_words` words that equals an earlier run. Short repeated lines stay.

Null texts stay null and empty ones empty. Rows equal in doc_id and text count as one document and are cut
alike. Other columns pass through. Null doc_ids come first in the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import words as W
from tickerloom.llm.columns import set_aside
from tickerloom.llm.staging import Stages

UNIT_WORDS = 25
WINDOW_WORDS = 50


def _runs_of(total: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
    """For each line the last line of the shortest run from it with `least` words; -1 if its text has none.

    total: words before each line and after the last one; last: the last line of each line's text.
    """
    end = np.searchsorted(total[1:], total[:-1] + least, side="left")
    return np.where(end <= last, end, -1)


def winnow(texts: pa.Array, unit_words: int, window_words: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Line hashes and fingerprints (line of the text; hash of the unit, or of the window with it) of many texts, each with the text's number."""
    data, bounds = W.text_bytes(texts)
    starts, ends, of = W.spans(data != 0x0A, bounds)
    word_starts = W.words(data, bounds)[0]
    size = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
    starts, ends, of, size = (x[size > 0] for x in (starts, ends, of, size))
    n = len(starts)
    lines = W.hash_spans(data, starts, ends)
    first = np.searchsorted(of, of, side="left")
    last = np.searchsorted(of, of, side="right") - 1
    total = np.concatenate([[0], np.cumsum(size)])
    unit_end = _runs_of(total, last, unit_words)
    window_end = _runs_of(total, last, window_words)

    units = np.flatnonzero(unit_end >= 0)
    unit_hash = np.zeros(n, dtype=np.uint64)
    unit_hash[units] = W.hash_spans(lines, units, unit_end[units] + 1)

    windows = np.flatnonzero(window_end >= 0)
    best, reach, step = windows.copy(), window_end[windows], 1
    open_ = np.arange(len(windows))
    while len(open_):
        j = windows[open_] + step
        fits = j < n
        fits[fits] = (unit_end[j[fits]] >= 0) & (unit_end[j[fits]] <= reach[open_[fits]]) & (of[j[fits]] == of[windows[open_[fits]]])
        open_, j = open_[fits], j[fits]
        lower = unit_hash[j] <= unit_hash[best[open_]]
        best[open_[lower]] = j[lower]
        step += 1
    prints = np.unique(best)
    # A window is its fingerprint in context: its first position has all of its lines, not only the unit.
    context = W.mix(W.hash_spans(lines, windows, window_end[windows] + 1) + unit_hash[best])
    at, hashes = np.concatenate([prints, windows]), np.concatenate([unit_hash[prints], context])
    order = np.argsort(at, kind="stable")
    at, hashes = at[order], hashes[order]
    return {"lines": (lines, of), "prints": (at - first[at], of[at]), "print_hashes": (hashes, of[at])}


def _line_table(docs: DataFrame, unit_words: int, window_words: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            found = winnow(batch.column("text"), unit_words, window_words)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("doc_id"),
                 W.lists(found["lines"][0].view(np.int64), found["lines"][1], n, pa.int64()),
                 W.lists(found["prints"][0], found["prints"][1], n, pa.int32()),
                 W.lists(found["print_hashes"][0].view(np.int64), found["print_hashes"][1], n, pa.int64())],
                ["_key", "doc_id", "lines", "at", "hash"])

    return docs.select("_key", "doc_id", "text").mapInArrow(
        run, f"_key bigint, doc_id {kind}, lines array<bigint>, at array<int>, hash array<bigint>")


def extend(later: np.ndarray, earlier: np.ndarray, seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (first line, line after the last) of the later text around seeds, as far as both texts agree."""
    runs, covered = [], {}
    for at, source in sorted(seeds):
        if covered.get(at - source, -1) > at:
            continue
        low = 0
        while low < min(at, source) and later[at - low - 1] == earlier[source - low - 1]:
            low += 1
        room = min(len(later) - at, len(earlier) - source)
        differs = np.flatnonzero(later[at : at + room] != earlier[source : source + room])
        high = int(differs[0]) if len(differs) else room
        covered[at - source] = at + high
        runs.append((at - low, at + high))
    return runs


def _extended(matches: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for later, earlier, seeds in zip(*(batch.column(c) for c in ("lines", "source_lines", "seeds"))):
                pairs = [(s["at"], s["source_at"]) for s in seeds.as_py()]
                runs = extend(later.values.to_numpy(), earlier.values.to_numpy(), pairs)
                out.append([{"low": a, "high": b} for a, b in runs])
            kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(out, kind)], ["_key", "runs"])

    return matches.mapInArrow(run, "_key bigint, runs array<struct<low:int,high:int>>")


def repeated_runs(keyed: DataFrame, unit_words: int = UNIT_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """_key and the runs of lines to remove, for documents that have any. keyed: _key, doc_id, text."""
    stages = Stages(keyed.sparkSession, "line-dedup")
    table = stages.put(_line_table(keyed, unit_words, window_words).dropDuplicates(["_key"]))
    prints = table.select("_key", "doc_id", F.explode(F.arrays_zip("at", "hash")).alias("p")).select(
        "_key", "doc_id", F.col("p.at").alias("at"), F.col("p.hash").alias("hash"))
    # Staged, so that the join below reads plain exchanges on both sides and can split a hot fingerprint.
    firsts = stages.put(
        prints.groupBy("hash").agg(F.min(F.struct("doc_id", "_key", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("hash", F.col("first._key").alias("source"), F.col("first.at").alias("source_at"))
    )
    seeds = (
        prints.join(firsts, "hash").filter("_key <> source OR at <> source_at")
        .groupBy("_key", "source").agg(F.collect_list(F.struct("at", "source_at")).alias("seeds"))
    )
    lines = table.select("_key", "lines")
    matches = (
        stages.put(seeds).join(lines, "_key")
        .join(lines.select(F.col("_key").alias("source"), F.col("lines").alias("source_lines")), "source")
        .select("_key", "lines", "source_lines", "seeds")
    )
    return _extended(matches).groupBy("_key").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def cut(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int]:
    """Text without the runs, its number of lines, and how many were removed. Empty lines inside a run go too."""
    parts = text.split("\n")
    full = [i for i, part in enumerate(parts) if part.strip(" \t\n\v\f\r")]
    gone, removed = set(), set()
    for low, high in runs:
        removed.update(range(low, high))
        gone.update(range(full[low], full[high - 1] + 1))
    return "\n".join(part for i, part in enumerate(parts) if i not in gone), len(full), len(removed)


def dedup_lines(docs: DataFrame, unit_words: int = UNIT_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """`docs` with repeated runs cut out of `text`, and `n_lines`, `n_removed` behind the other columns."""
    docs, back = set_aside(docs, ["_key", "_runs"])
    through = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*through, F.xxhash64("doc_id", "text").alias("_key"))
    runs = repeated_runs(keyed.select("_key", "doc_id", "text"), unit_words, window_words)
    joined = keyed.join(runs.withColumnRenamed("runs", "_runs"), "_key", "left").select(*through, "_runs")
    at = through.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            done = [
                (None, 0, 0) if text is None else cut(text, [(r["low"], r["high"]) for r in found or ()])
                for text, found in zip(texts, batch.column("_runs").to_pylist())
            ]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array([d[0] for d in done], pa.string())
            counts = [pa.array([d[i] for d in done], pa.int64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*columns, *counts], [*through, "n_lines", "n_removed"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-1]]
    return joined.mapInArrow(run, ", ".join([*kinds, "n_lines bigint", "n_removed bigint"])).withColumnsRenamed(back)
