"""Words and hashes of many texts at once, on the bytes of an Arrow column.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit sums over byte powers,
mixed at the end, so equal words have equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together; a longer text is worked on alone.
SLICE_BYTES = 2 << 20
BLOCK = 1 << 18

_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LIFT = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _powers(_STEP, BLOCK), _powers(_INVERSE, BLOCK)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of the batches in order, cut so that a slice holds at most `limit` bytes of text or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins and the last ends. Null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    data = data[bounds[0] : bounds[-1]]
    return _LOWER[data] if fold_case else data, bounds - bounds[0]


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of marked bytes within one text: first byte, byte after the last, number of the text."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    closes = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    first[begins] = inside[begins]
    last[closes] = inside[closes]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(_IN_WORD[data], bounds)


def word_bytes(data: np.ndarray) -> np.ndarray:
    return _IN_WORD[data]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes (or 64-bit values) of each span; starts and ends must not decrease."""
    out, i = np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        low, size = starts[i], int(ends[j - 1] - starts[i])
        up, down = (_UP, _DOWN) if size <= BLOCK else (_powers(_STEP, size), _powers(_INVERSE, size))
        part = data[low : low + size]
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((_LIFT[part] if data.dtype == np.uint8 else part) * up[:size], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def chains(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n consecutive words of one text, and the position of the first of them."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    total = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        total = total * _STEP + hashes[j : j + m]
    at = np.flatnonzero(text[:m] == text[n - 1 :])
    return mix(total[at]), at


def within(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Values that are equal only if both the value and the text are."""
    return mix(values + mix((text.astype(np.uint64) + np.uint64(1)) * _BASE))


def lists(values: np.ndarray, text: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """Values, ordered by their text, as one list per text."""
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
