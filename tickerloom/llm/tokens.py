"""Token ids of a byte-level BPE vocabulary in the JSON format of `tokenizers`.

The ids are those of that library. Merging runs in `tiktoken` on the same ranks, because it merges about four
times as fast; `tests/llm/test_tokens.py` holds the two together. The file must be readable on every executor.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import tiktoken
from public_tokenizers import PATTERN


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def load(path: str) -> tiktoken.Encoding:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("from-json", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(encoding: tiktoken.Encoding, text: str | None, end: int | None = None) -> np.ndarray:
    """Ids of the text (null: none), with `end` behind them if given."""
    ids = encoding.encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, np.uint32)
    return ids.astype("<u4") if end is None else np.append(ids, end).astype("<u4")
