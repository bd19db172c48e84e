"""Spelling variants against plain comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from tickerloom.llm import spelling

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {x: n for x, n in found.items() if n >= 2}


def brute(n):
    near = {x: [y for y in n if one_edit(x, y)] for x in n}
    form = {}
    for x, ys in near.items():
        best = min(ys, key=lambda y: (-n[y], y), default=None)
        form[x] = best if best is not None and n[best] >= 10 * n[x] else None

    def root(x):
        while form[x]:
            x = form[x]
        return x

    return sorted((x, form[x], root(x), n[x], len(near[x]), n[form[x]] if form[x] else None) for x in n)


def result(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def same(got, want):
    assert [repr(x) for x in got] == [repr(x) for x in want]


def edited(r, word, letters):
    i = r.randrange(len(word))
    return r.choice([word[:i] + word[i + 1 :], word[:i] + r.choice(letters) + word[i:], word[:i] + r.choice(letters) + word[i + 1 :]])


def texts(seed, letters="abcdeéÉzß", n=400):
    r, rows = random.Random(seed), []
    stems = ["".join(r.choice(letters) for _ in range(r.randint(7, 14))) for _ in range(40)]
    for i in range(n):
        some = []
        for _ in range(60):
            word = stems[int(40 * r.random() ** 3)]
            for _ in range(r.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
                word = edited(r, word, letters)
            some.append(r.choice([word, word.capitalize(), word.upper() if word.isascii() else word]))
        rows.append((i, r.choice([" ", "-", ", 1"]).join(some)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_variants_equal_all_pairs(spark, seed):
    rows = texts(seed)
    want = brute(counted(rows))
    assert any(x[1] for x in want) and any(x[2] != x[1] for x in want if x[1]) and len(want) > 500
    same(result(spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(7))), want)


def test_hot_block_is_cut(spark, monkeypatch):
    """Anagrams of few letters agree on everything: one block, cut into several parts."""
    r = random.Random(5)
    n = {"".join(r.sample("aaabbbcccd", 10)): r.choice([2, 3, 50]) for _ in range(1500)}
    n |= {x[:4] + x[5:]: 600 for x in list(n)[:40]}
    monkeypatch.setattr(spelling, "HOT", 300)
    monkeypatch.setattr(spelling, "TILE", 64)
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    want = brute(n)
    same(result(spelling.variants(df)), want)
    met = spelling.near_words(df)
    assert met.count() == sum(x[4] > 0 for x in want)


def test_odd_texts(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "abcdefghij" * 7000
    rows = [(1, None), (2, ""), (3, "x"), (None, "anoword anoword"), (4, "Straße straße STRASSE naïveté×÷ 日本語 Ābcdefgh \U0001f600")] * 2
    rows += [(i, f"{long} {long[:30000]}q{long[30000:]} {long[1:]}") for i in (5, 6)] + [(7, f"{long} " * 40)]
    rows += [(i, "étendue étendue ÉTENDUE") for i in range(40)]
    extra = spark.createDataFrame([(*r, "mine", 1) for r in rows], SCHEMA + ", word string, n int")
    want = brute(counted(rows))
    assert any(len(x[0]) > 60000 and x[1] for x in want)
    same(result(spelling.spelling_variants(extra)), want)
