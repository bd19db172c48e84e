"""Operators that judge, encode or cut each text on its own, against plain Python."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickerloom.llm import bpe, packing, quality, sharding, token_matrix, tokens

RANKS, VOCABULARY = path("byte_bpe_50k.tiktoken"), path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    """The five counts of the contract."""
    text = text or ""
    found = WORD.findall(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    windows = collections.Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    covered = {i + j for i in range(len(found) - 7) if windows[tuple(found[i : i + 8])] > 1 for j in range(8)}
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_counts_equal_plain_ones(spark, odd_docs, words):
    repeated = "\n".join([" ".join(words(12, 1))] * 4 + [" ".join(words(30, 2)), " ".join(words(9, 1))])
    extra = spark.createDataFrame([(50, repeated, "en", "a", 1), (51, " ".join(words(200, 3)), "en", "a", 1)], odd_docs.schema)
    docs = odd_docs.union(extra)
    rows = quality.measure(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        expected = counted(r.text)
        assert tuple(r[c] for c in quality.COUNTS) == expected
        assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r.base_failed and r.kept)


def test_compression_bands(spark, words):
    noise = np.random.default_rng(1).integers(0x4E00, 0x9FA5, 9000)
    texts = {
        "clean": " ".join(words(3000, 5)), "repetitive": " ".join(f"{a} {b}" for a, b in zip(words(7, 1) * 400, words(9, 2) * 400)),
        "random": " ".join(chr(c) + chr(d) for c, d in zip(noise[::2], noise[1::2])), "part": " ".join(words(1200, 6)) + " " + "ha he ho hi " * 1500,
    }
    rows = {r.source: r for r in quality.measure(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts.items())], "doc_id long, text string, source string")).collect()}
    assert rows["clean"].kept and not rows["repetitive"].kept and not rows["part"].kept
    assert rows["random"].ratio < rows["clean"].ratio < rows["repetitive"].ratio
    strict = quality.Rules(bands=(quality.Band(float("inf"), rows["random"].ratio + 0.01, 9.0),))
    assert not quality.measure(spark.createDataFrame([(1, texts["random"])], "doc_id long, text string"), strict).first().kept


@pytest.mark.parametrize("size", [300, 1000, 4000, 6000, 20000, 100000])
def test_random_and_encoded_texts_fail_the_rules_in_use(spark, words, size):
    r = np.random.default_rng(size)
    noise = r.integers(0, 256, 2 * size, dtype=np.uint8).tobytes()
    alphanumeric = "".join(r.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), size))
    cut = lambda s: " ".join(s[i : i + 6] for i in range(0, len(s), 6))[:size]
    texts = {"base64": base64.b64encode(noise).decode()[:size], "base64 in words": cut(base64.b64encode(noise).decode()), "random letters": cut(alphanumeric)}
    if size > 4096:
        texts |= {"encoded second chunk": " ".join(words(1000, 3))[:4096] + cut(base64.b64encode(noise).decode())[:1800]}
    rows = quality.measure(spark.createDataFrame([(t, k) for k, t in texts.items()], "text string, source string")).collect()
    assert not [r.source for r in rows if r.kept]
    # By compression alone, whatever the base rules say.
    good = quality._ratios(pa.array(list(texts.values())), quality.Rules())[2]
    assert not good.any()


def test_quality_keeps_columns_and_empty_tables(odd_docs, no_docs):
    clashing = odd_docs.withColumn("kept", F.lit("mine")).withColumn("ratio", F.lit(1))
    assert quality.filter_quality(clashing).columns == clashing.columns
    assert quality.measure(no_docs).count() == 0 and quality.filter_quality(no_docs).count() == 0


def test_ids_are_those_of_the_tokenizers_library(odd_rows):
    library, own = Tokenizer.from_file(VOCABULARY), tokens.load(VOCABULARY)
    for text in [*(r[1] for r in odd_rows if r[1]), "a<|endoftext|>b", "<|endoftext|>", "I'll we're 's'' 12 ３ ʼn\r\n \x85  x"]:
        assert tokens.encode(own, text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_cuts_powers_of_two_and_loses_nothing(odd_docs, no_docs):
    own, rows = tokens.load(VOCABULARY), collections.defaultdict(list)
    packed = packing.pack(odd_docs).collect()
    for r in packed:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.bucket == r.length.bit_length() - 1 and r.offset == 0
        rows[r.doc_id].append(r)
    assert len({r.sequence_id for r in packed}) == len(packed)
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    repeats = collections.Counter(r.doc_id for r in odd_docs.collect())
    for key, pieces in rows.items():
        expected = tokens.encode(own, texts[key], 1).tolist()
        pieces = sorted(pieces, key=lambda r: r.start)[:: repeats[key]]
        assert [i for p in pieces for i in np.frombuffer(p.ids, "<u4")] == expected
        assert {p.doc_tokens for p in pieces} == {len(expected)}
    assert set(rows) == set(texts) and packing.pack(no_docs).count() == 0
    assert packing.piece_lengths(2048 * 2 + 1025) == [2048, 2048, 1024, 1]
    with pytest.raises(ValueError):
        packing.pack(odd_docs, longest=1000)


def test_bpe_equals_tiktoken_and_decodes(spark, odd_docs, no_docs, words):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    docs = odd_docs.union(spark.createDataFrame([(60, " ".join(words(500, 9)) + "<|endoftext|>" + "ab" * 300, "en", "a", 1)], odd_docs.schema))
    texts = [r.text or "" for r in docs.collect()]
    expected = sorted((len(i := library.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(docs, RANKS).collect()) == expected
    encoded = bpe.encode(docs, RANKS)
    assert sorted(r.ids for r in encoded.collect()) == sorted(library.encode_ordinary(t) for t in texts)
    assert sorted(bytes(r.bytes) for r in bpe.decode(encoded, RANKS).collect()) == sorted(t.encode() for t in texts)
    assert bpe.digest(no_docs, RANKS).count() == 0


@pytest.mark.parametrize("letters", ["ab", "etaoin", " .!"])
def test_heap_and_query_merge_alike(letters):
    r = np.random.default_rng(3)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    coder = bpe.coder(RANKS)
    for n in (2, 7, 60, 255, 1000):
        word = "".join(r.choice(list(letters), n)).encode()
        expected = library._core_bpe.encode_single_piece(word)
        assert bpe.merge_by_heap(word, coder.ranks) == expected
        rows = coder.tokens_of([word])
        assert [i for _, i in sorted(zip(rows.column("pos").to_pylist(), rows.column("id").to_pylist()))] == expected


def test_batches_of_long_words_stay_in_memory():
    """Unspaced text: many distinct words of many bytes each, and single words of thousands."""
    r = random.Random(2)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    coder = bpe.coder(RANKS)
    some = {"".join(chr(r.randint(0x4E00, 0x8FFF)) for _ in range(r.randint(8, 80))) for _ in range(3000)}
    some |= {"".join(r.choice("etaoinshrdlucmfw") for _ in range(200)) for _ in range(300)}
    some |= {"a" * n for n in range(1, 60)} | {"ab" * n for n in range(1, 60)} | {"x" * 5000, "xy" * 2500, "".join(r.choice("acgt") for _ in range(3000))}
    some |= {"".join(r.choice("etaoin") for _ in range(bpe.LONG_WORD + 5))}
    words = sorted(some)
    for word, (n, ids, decoded) in zip(words, coder.code(words)):
        expected = library._core_bpe.encode_single_piece(word.encode())
        assert n == len(expected) and ids == " ".join(map(str, expected)) and decoded == word.encode()
    assert coder.connection.sql("SELECT count(*) FROM merges WHERE alone").fetchall()[0][0] > 0



def test_shards(spark, odd_docs, no_docs):
    weights = [1.0, 1.0, 2.0, 1.0]
    docs = spark.range(20000).withColumnRenamed("id", "doc_id").withColumn("shard", F.lit("mine"))
    rows = sharding.assign(docs, "doc_id", weights).toPandas()
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    share = rows.groupby("shard").size() / len(rows)
    assert abs(share[2] - 0.4) < 0.02 and abs(share[0] - 0.2) < 0.02
    moved = rows[rows.shard != rows.grown_shard]
    assert set(moved.grown_shard) == {4} and abs(len(moved) / len(rows) - 1 / 6) < 0.02
    alone = sharding.assign(docs.filter("doc_id % 7 = 0"), "doc_id", weights).toPandas().set_index("doc_id").shard
    assert (rows.set_index("doc_id").shard[alone.index] == alone).all()

    sized = sharding.sized(odd_docs)
    assert {(r.size, r.text_crc32) for r in sized.collect()} == {(len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect()}
    placed = sharding.assign(sized, "doc_id", [1.0] * 3).toPandas()
    assert len(placed) == odd_docs.count() and all(sorted(g.slot) == list(range(len(g))) for _, g in placed.groupby("shard"))
    assert sharding.assign(sharding.sized(no_docs), "doc_id", [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(docs, "doc_id", [1.0, 0.0])


def test_best_fit_decreasing_equals_a_plain_search():
    r = np.random.default_rng(5)
    for row in (16, 100, 2048):
        lengths = r.integers(1, row + 1, 300)
        rows = token_matrix.best_fit_decreasing(lengths, row)
        assert sorted(i for x in rows for i in x) == list(range(300)) and all(lengths[x].sum() <= row for x in rows)
        rooms = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [x for x in rooms if x >= n]
            rooms.remove(min(fits)) if fits else None
            rooms.append((min(fits) if fits else row) - n)
        assert len(rows) == len(rooms)


def test_token_matrix_loses_nothing(odd_docs, no_docs, tmp_path):
    own = tokens.load(VOCABULARY)
    rows = token_matrix.pack_rows(odd_docs, row=64, buffer_tokens=5000)
    found = collections.defaultdict(list)
    for r in rows.collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == len(r.positions) == 64 and r.cumulative[0] == 0 and r.cumulative[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        for key, start, a, b in zip(r.doc_ids, r.starts, r.cumulative, r.cumulative[1:]):
            assert r.positions[a:b] == list(range(b - a))
            found[key].append((start, ids[a:b].tolist()))
    for r in odd_docs.collect():
        pieces = sorted(found[r.doc_id])
        pieces = pieces[::2] if r.doc_id in (4, 6) else pieces
        assert [i for _, p in pieces for i in p] == tokens.encode(own, r.text, token_matrix.END).tolist()
    token_matrix.write_matrix(rows, str(tmp_path / "rows"))
    assert token_matrix.pack_rows(no_docs).count() == 0
