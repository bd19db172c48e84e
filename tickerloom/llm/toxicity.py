"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, ASCII letters lower-cased. Features of a text are the distinct buckets of
its words, its word pairs, and its pairs with one or two words between. Learning goes document by document with
a rate for each coordinate that falls with the squares of its gradients; the L1 term keeps at zero every bucket
without enough evidence, so the model that is sent to the executors is a short list of buckets and weights.

Learning takes a sample of at most `sample_rows` labelled rows, by hash of doc_id, half of them toxic if there
are so many; their features go to one task. Scoring reads every whole text where it lies.

Null and empty texts have no features and get the score of the intercept. Labels other than 0 and 1 are ignored;
a document with several labels counts as toxic if one of them says so. Without any usable label every score is
0.5. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import words as W


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    epochs: int = 3
    sample_rows: int = 16_000
    held_out_of: int = 5
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Weights of the buckets that have one."""

    bits: int
    intercept: float
    buckets: np.ndarray
    weights: np.ndarray


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word, pair and skip-gram, and the number of its text; not in order and not distinct."""
    data, bounds = W.text_bytes(texts, fold_case=True)
    starts, ends, of = W.spans(_LETTER[data], bounds)
    word = W.hash_spans(data, starts, ends)
    buckets, text = [word], [of]
    for gap in (1, 2, 3):
        if len(word) > gap:
            inside = of[:-gap] == of[gap:]
            salt = np.uint64((0x51ED270B * gap + 0x9E3779B97F4A7C15) % (1 << 64)) | np.uint64(1)
            buckets.append(W.mix((word[:-gap] * salt + W.mix(word[gap:]))[inside]))
            text.append(of[:-gap][inside])
    return (np.concatenate(buckets) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(text)


def learn(rows: list[np.ndarray], labels: np.ndarray, settings: Settings = Settings()) -> Model:
    """FTRL-proximal over rows of distinct buckets, document by document."""
    size = 1 << settings.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    alpha, beta, l1, l2 = settings.alpha, settings.beta, settings.l1, settings.l2
    order = np.random.default_rng(settings.seed)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        # The intercept, last, is not held back.
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - np.where(at == size, 0.0, l1), 0.0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    rows = [np.append(r, size) for r in rows]
    for _ in range(settings.epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - labels[i]
            before = n[at]
            n[at] = before + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(before)) / alpha * w
    final = weights(np.arange(size + 1))
    used = np.flatnonzero(final[:-1])
    return Model(settings.bits, float(final[-1]), used, final[used])


def held_out(key: Column, of: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % of == 0


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model of the labelled rows that are not held out."""
    half = settings.sample_rows // 2
    usable = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), settings.held_out_of))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = usable.filter("toxic = 1").orderBy(*by_hash).limit(half).union(usable.filter("toxic = 0").orderBy(*by_hash).limit(settings.sample_rows - half))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            bucket, text = features(batch.column("text"), settings.bits)
            both = np.unique(text << settings.bits | bucket)
            lists = W.lists(both & ((1 << settings.bits) - 1), both >> settings.bits, batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), lists], ["doc_id", "toxic", "buckets"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, label, rows = [], [], []
        for batch in batches:
            key += batch.column("doc_id").to_pylist()
            label += batch.column("toxic").to_pylist()
            # Copies, or every batch would stay in memory behind its views.
            rows += [x.values.to_numpy().astype(np.int32) for x in batch.column("buckets")]
        order = sorted(range(len(key)), key=lambda i: (key[i], label[i], len(rows[i])))
        model = learn([rows[i] for i in order], np.array([label[i] for i in order], dtype=float), settings)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(model.buckets, -1), pa.int64()), pa.array(np.append(model.weights, model.intercept), pa.float64())], ["bucket", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    bags = sample.mapInArrow(distinct, f"doc_id {kind}, toxic int, buckets array<int>")
    learned = bags.repartition(1).mapInArrow(train, "bucket bigint, weight double").toArrow()
    bucket, weight = learned.column("bucket").to_numpy(), learned.column("weight").to_numpy()
    intercept = float(weight[bucket == -1].sum())
    return Model(settings.bits, intercept, bucket[bucket >= 0], weight[bucket >= 0])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `score` behind its columns; no exchange."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    through = [c for c in docs.columns if c != "score"]
    plain = docs.select(*through)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        table = np.zeros(1 << known.bits)
        table[known.buckets] = known.weights
        for batch in W.slices(batches, "text"):
            bucket, text = features(batch.column("text"), known.bits)
            weighty = table[bucket] != 0
            both = np.unique(text[weighty] << known.bits | bucket[weighty])
            total = np.bincount(both >> known.bits, weights=table[both & ((1 << known.bits) - 1)], minlength=batch.num_rows) + known.intercept
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35.0, 35.0))))], [*through, "score"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields]
    return plain.mapInArrow(run, ", ".join([*kinds, "score double"]))


def filter_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below the threshold, with the columns of `docs`."""
    aside = {"score": "_aside_score"} if "score" in docs.columns else {}
    mild = score(docs.withColumnsRenamed(aside), model).filter(F.col("score") < threshold)
    return mild.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
