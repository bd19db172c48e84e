"""Quality rules: bands of compression ratios over whole texts and fixed chunks.

The ratio is UTF-8 bytes to zstandard bytes. Repetitive text compresses too well, random or encoded text
hardly at all; both limits depend on the length, because a short text gives a compressor little to work
with. Lower limits lie between base64 or random letters (in one piece or broken into words) and the least of the
documents of 20 words or more in any of the four languages of the tables. Below 192 bytes both ranges meet. Hex
compresses like prose (1.3 to 2.0) and is not told by its ratio. Word counts and the two base rules stand beside the bands.

Null text counts as empty. Empty text has no words and fails the base rules. Every row gives one row;
repeated rows give equal rows; other columns pass through `filter_quality` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import words as W


@dataclass(frozen=True)
class Band:
    """Accepted ratios of texts of fewer than `below` bytes (and no fewer than the band before)."""

    below: float
    least: float
    most: float

    def holds(self, ratio: float) -> bool:
        return self.least <= ratio <= self.most


@dataclass(frozen=True)
class Rules:
    bands: tuple[Band, ...] = (
        Band(128, 1.0, 4.0),
        Band(192, 1.05, 4.0),
        Band(256, 1.15, 4.0),
        Band(384, 1.2, 4.0),
        Band(512, 1.28, 4.0),
        Band(1024, 1.36, 4.0),
        Band(2048, 1.5, 4.0),
        Band(4096, 1.6, 4.5),
        Band(8192, 1.6, 4.5),
        Band(32768, 1.6, 5.0),
        Band(float("inf"), 1.6, 6.0),
    )
    chunk_bytes: int = 4096
    #: Limits of chunks, by the length of the chunk: the last one is shorter. A few bytes tell nothing.
    chunk_bands: tuple[Band, ...] = (
        Band(128, 0.0, float("inf")),
        Band(192, 1.05, 6.0),
        Band(256, 1.15, 6.0),
        Band(384, 1.2, 6.0),
        Band(512, 1.28, 6.0),
        Band(1024, 1.36, 6.0),
        Band(2048, 1.5, 6.0),
        Band(float("inf"), 1.55, 6.0),
    )
    #: Share of the bytes in chunks outside their limits from which a text is rejected.
    chunk_share: float = 0.25
    level: int = 3
    least_words: int = 20
    #: Percent of words inside repeated windows that is still accepted.
    most_repeat_percent: int = 30
    repeat_window: int = 8


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Marked bytes of each text."""
    running = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=running[1:])
    return np.diff(running[bounds])


def count_rules(texts: pa.Array, window: int = 8) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    data, bounds = W.text_bytes(texts)
    n = len(bounds) - 1
    inside = W.word_bytes(data)
    starts, ends, of = W.words(data, bounds)
    per_text = np.bincount(of, minlength=n)

    line_starts, line_ends, line_of = W.spans(data != 0x0A, bounds)
    if len(line_starts):
        words_before = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(inside, out=words_before[1:])
        full = words_before[line_ends] > words_before[line_starts]
        line_starts, line_ends, line_of = line_starts[full], line_ends[full], line_of[full]
    lines = W.within(W.hash_spans(data, line_starts, line_ends), line_of)
    first = np.unique(lines, return_index=True)[1]
    dup_lines = np.bincount(line_of, minlength=n) - np.bincount(line_of[first], minlength=n)

    chain, at = W.chains(W.hash_spans(data, starts, ends), of, window)
    repeat = np.zeros(n, dtype=np.int64)
    if len(chain):
        chain = W.within(chain, of[at])
        ordered = np.sort(chain)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            place = np.minimum(np.searchsorted(twice, chain), len(twice) - 1)
            hit = at[twice[place] == chain]
            edge = np.bincount(hit, minlength=len(of) + 1) - np.bincount(hit + window, minlength=len(of) + 1)[: len(of) + 1]
            covered = np.cumsum(edge)[: len(of)] > 0
            repeat = np.bincount(of[covered], minlength=n)
    return {
        "n_words": per_text,
        "word_chars": _sums(inside & ((data & 0xC0) != 0x80), bounds),
        "n_symbols": _sums(_SYMBOL[data], bounds),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat,
    }


def _band(bands: tuple[Band, ...], size: int) -> Band:
    return next(b for b in bands if size < b.below)


def _ratios(texts: pa.Array, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ratio of each whole text, share of its bytes in chunks outside the chunk limits, verdict of the bands."""
    squeeze = zstandard.ZstdCompressor(level=rules.level)
    data, bounds = W.text_bytes(texts)
    raw, n = memoryview(data), len(bounds) - 1
    ratio, share, good = np.ones(n), np.zeros(n), np.zeros(n, dtype=bool)
    for i in range(n):
        low, high = int(bounds[i]), int(bounds[i + 1])
        size = high - low
        if not size:
            continue
        ratio[i] = size / len(squeeze.compress(raw[low:high]))
        bad = 0
        for c in range(low, high, rules.chunk_bytes):
            part = raw[c : min(c + rules.chunk_bytes, high)]
            bad += 0 if _band(rules.chunk_bands, len(part)).holds(ratio[i] if len(part) == size else len(part) / len(squeeze.compress(part))) else len(part)
        share[i] = bad / size
        good[i] = _band(rules.bands, size).holds(ratio[i]) and share[i] < rules.chunk_share
    return ratio, share, good


def measure(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All columns of `docs` with counts, `ratio`, `bad_chunk_share`, `base_failed`, `kept` behind them.

    Columns of `docs` with those names give way. No exchange: each text is judged on its own.
    """
    added = [*COUNTS, "ratio", "bad_chunk_share", "base_failed", "kept"]
    through = [c for c in docs.columns if c not in added]
    plain = docs.select(*through)
    kinds = [f"{c} bigint" for c in COUNTS] + ["ratio double", "bad_chunk_share double", "base_failed boolean", "kept boolean"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields), *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            counts = count_rules(batch.column("text"), rules.repeat_window)
            ratio, share, good = _ratios(batch.column("text"), rules)
            n = counts["n_words"]
            failed = (n < rules.least_words) | (100 * counts["n_repeat_words"] > rules.most_repeat_percent * n)
            columns = [*(pa.array(counts[c], pa.int64()) for c in COUNTS), pa.array(ratio), pa.array(share), pa.array(failed), pa.array(~failed & good)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *added])

    return plain.mapInArrow(run, schema)


def filter_quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of `docs` whose text is kept, with the columns of `docs`."""
    # Columns with the names of measures step aside meanwhile.
    aside = {c: f"_aside_{i}" for i, c in enumerate(docs.columns) if c in (*COUNTS, "ratio", "bad_chunk_share", "base_failed", "kept")}
    kept = measure(docs.withColumnsRenamed(aside), rules).filter("kept")
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
