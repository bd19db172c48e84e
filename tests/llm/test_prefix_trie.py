"""Prefix trie against sets of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tickerloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = (own.get(c - c % 100, [])[:h]) + own[c][h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, inside in members.items():
        below = [v for v in members if v[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in inside if len(convs[c]) == len(node))))
        leaves = [v for v in below if not any(u[:-1] == v for u in members if u)]
        out.append((
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside),
            sum(len(u) == len(node) + 1 and u[:-1] == node for u in below), len(leaves),
            sum((len(members[v]) - 1) * len(v[-1][1]) for v in below if v), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def result(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(seed, n, first=0):
    """Few different turns, so that prefixes repeat; some ids absent, some copies, some without a turn of their own."""
    r, rows = random.Random(seed), []
    for c in range(first, first + n):
        if r.random() < 0.1:
            continue
        size = r.choice([1, 1, 2, 3, 5, 8]) if r.random() < 0.9 else 1
        if r.random() < 0.3:
            rows += [(c, t, "user", f"common {t}") for t in range(8)]
            continue
        for t in range(size):
            rows.append((c, r.choice([None, t]) if t == 0 else t, r.choice(["user", None]), r.choice(["a", "bé", "long text \U0001F600", "", None])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, batch", [(0, 3), (1, 7), (2, 10000)])
def test_trie_equals_sets_of_prefixes(spark, seed, batch):
    rows = conversations(seed, 260)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert result(prefix_trie.conversation_trie(df)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert result(prefix_trie.conversation_trie(none)) == []
    assert result(prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []
    rows = [(1, None, None, None), (2, 1, "user", "x"), (2, 1, "user", "x"), (-5, 0, "user", "y" * 70000), (-5, 0, "user", "z"), (None, 0, "a", "b")]
    rows += [(7, t, "user", f"turn {t}") for t in range(40)]
    extra = spark.createDataFrame([(*r, "mine", 3) for r in rows], SCHEMA + ", key string, depth int")
    kept = [r for r in rows if r[0] != -5]
    got = result(prefix_trie.conversation_trie(extra.where("conv_id IS NULL OR conv_id <> -5")))
    assert got == brute(kept)
    assert prefix_trie.conversation_trie(extra).count() >= len(got)
    long = spark.createDataFrame([(7, t, "user", f"turn {t}") for t in range(20000)], SCHEMA)
    deep = prefix_trie.conversation_trie(long).agg({"depth": "max", "n_leaves": "max"}).first()
    assert sorted(deep) == [1, 20000 - zlib.crc32(b"7") % 6]
    # A conversation whose own turns are all left out and that has no lender is a member of the root alone.
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 2)
    got = result(prefix_trie.conversation_trie(spark.createDataFrame([(lone, 0, "user", "x")], SCHEMA)))
    assert got == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_range_minimum_searches():
    r = np.random.default_rng(1)
    values = r.integers(0, 5, 57)
    table = prefix_trie.RangeMinimum(values)
    row, depth = np.repeat(np.arange(57), 6), np.tile(np.arange(6), 57)
    right, left = table.last_right(row, depth), table.first_left(row, depth)
    for i, d, low, high in zip(row, depth, left, right):
        assert all(values[low + 1 : i + 1] >= d) and (low == 0 or values[low] < d)
        assert all(values[i + 1 : high + 1] >= d) and (high == 56 or values[high + 1] < d)
    low, high = np.minimum(row, right), np.maximum(row, right)
    assert [values[a : b + 1].min() for a, b in zip(low, high)] == table.minimum(low, high).tolist()
