"""Similarity join of shingle sets with count-vector R-trees.

A document's set holds its distinct shingles of five words, ASCII letters lower-cased. Sets are hashed into
`GROUPS` groups; the counts per group are a point, and two sets share at most the sum of the lesser counts of
each group. An R-tree over points holds the greatest counts of each branch, so that sum against a branch bounds
the overlap with everything below it.

One tree over the corpus cannot prune: independent documents of equal size differ less in a few dozen counts
than the allowed fifth of their size. So the trees form a forest, one for each block of sets that share a
shingle of their prefix. In any fixed order of shingles, sets with Jaccard similarity of 0.8 share one among the
first `n - ceil(0.8 n) + 1` of each, so no pair is lost. Shingles known to be common come last in the order,
which keeps passages that many documents share out of prefixes.

1. Equal sets become one node.
2. A block's hub is its least node. Every node is paired with the hubs it shares most blocks with; pairs are
   bounded by points, then verified. That links large groups of near copies with a few pairs for each member.
   A pair that is a block of its own and not among those hubs is bounded and verified with the last pairs of 3.
3. Blocks that still hold several components go through the forest. First each node is paired with its best
   match of another component, which joins most of what is left; then all pairs of different components that the
   trees let pass are verified. A large block is cut into pieces, and pairs of pieces are searched apart.
4. A component's id is its least doc_id.

A text with fewer than five words has one shingle, its whole sequence; without words (null, empty) the set is
empty and linked with nothing. Rows with equal texts are linked; a null doc_id takes part and is no component id
unless nothing else is in the component. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickerloom.llm import words as W
from tickerloom.llm.components import components
from tickerloom.llm.columns import set_aside
from tickerloom.llm.staging import Stages

SHINGLE = 5
GROUPS = 128
#: Links need 5 * intersection >= 4 * union.
LEAF, FAN = 16, 8
#: Rows of a block that are searched together, and common shingles that are put last (a bound on the broadcast only).
PIECE = 512
COMMON = 1 << 19
COMMON_FROM = 16
#: Hubs that a node is paired with before the forest looks at what they leave.
HUBS = 3
#: Shingles counted together when looking for common ones, and bits of the filters.
COUNTED = 4_000_000
FILTER_BITS = 1 << 25


def needed(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of linked sets of n and m shingles: ceil(4/9 (n + m))."""
    return (4 * (n + m) + 8) // 9


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order of (text, hash), and the number of the text."""
    data, bounds = W.text_bytes(texts, fold_case=True)
    starts, ends, of = W.words(data, bounds)
    hashes = W.hash_spans(data, starts, ends)
    chain, at = W.chains(hashes, of, SHINGLE)
    counts = np.bincount(of, minlength=len(bounds) - 1)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    first = np.searchsorted(of, short, side="left")
    whole = W.hash_spans(hashes, first, first + counts[short])
    values, text = np.concatenate([chain, whole]), np.concatenate([of[at], short])
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], text[new]


def set_ids(values: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit id of each text's set, and its size."""
    sizes = np.bincount(text, minlength=n)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(values), dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return W.mix((running[ends] - running[ends - sizes]) ^ W.mix(sizes.astype(np.uint64))), sizes


class CountTree:
    """R-tree over count vectors, packed by halving the widest coordinate; search by bounded overlap."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            key = np.column_stack([points[rows], sizes[rows]])
            widest = int(np.argmax(key.max(axis=0) - key.min(axis=0)))
            rows = rows[np.argsort(key[:, widest], kind="stable")]
            todo += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
        self.order = np.concatenate(leaves)
        self.points, self.sizes = points[self.order], sizes[self.order]
        bounds = np.cumsum([0, *(len(x) for x in leaves)])
        #: From the root down: greatest counts and least size of each branch, and the range of what is below it.
        self.levels = [(np.maximum.reduceat(self.points, bounds[:-1]), np.minimum.reduceat(self.sizes, bounds[:-1]), bounds)]
        while len(self.levels[0][1]) > FAN:
            top, least, _ = self.levels[0]
            cuts = np.append(np.arange(0, len(least), FAN), len(least))
            self.levels.insert(0, (np.maximum.reduceat(top, cuts[:-1]), np.minimum.reduceat(least, cuts[:-1]), cuts))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Rows whose overlap with the point may be enough for a link."""
        at = np.arange(len(self.levels[0][1]))
        for top, least, cuts in self.levels:
            at = at[np.minimum(top[at], point).sum(axis=1) >= needed(least[at], size)]
            at = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in at]) if len(at) else at
        return self.order[at[_may_link(self.points[at], self.sizes[at], point, size)]]


def _may_link(points: np.ndarray, sizes: np.ndarray, point: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    close = (5 * sizes >= 4 * size) & (5 * size >= 4 * sizes)
    return close & (np.minimum(points, point).sum(axis=-1) >= needed(sizes, size))


def _filter_of(keys: DataFrame, column: str) -> np.ndarray:
    """Bit per residue of the keys, as bytes: at most FILTER_BITS / 8, whatever the number of keys."""
    rows = (
        keys.select(F.expr(f"pmod({column}, {FILTER_BITS}L)").alias("slot"))
        .select(F.expr("shiftright(slot, 6)").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    words = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words


def _in_filter(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.view(np.uint64) % np.uint64(FILTER_BITS)
    # pmod of a negative long by a power of two is its low bits, as here.
    return (words[(slot >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (slot & np.uint64(63))) & np.uint64(1) == 1


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, in order of hash, and the log of their number of documents.

    A task counts over stretches of its documents and passes on what it meets twice, so what is common in the
    corpus is found by many tasks. The list only orders shingles: a miss costs time, never a link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def repeated(parts: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            many = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], ["shingle", "n"])

        parts, held = [], 0
        for batch in W.slices(batches, "text"):
            values, text = shingle_sets(batch.column("text"))
            # Equal sets become one node, so within a slice each counts once.
            ids, sizes = set_ids(values, text, batch.num_rows)
            first = np.zeros(batch.num_rows, dtype=bool)
            first[np.unique(ids, return_index=True)[1]] = True
            parts.append(values[first[text]])
            held += len(parts[-1])
            if held >= COUNTED:
                yield repeated(parts)
                parts, held = [], 0
        if parts:
            yield repeated(parts)

    rows = (
        docs.select("text").mapInArrow(run, "shingle bigint, n bigint")
        .groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_FROM)
        .orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    )
    values = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], np.log2(rows.column("n").to_numpy()[order]).astype(np.uint64)


def ranks(values: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Place of each shingle in the order of prefixes: uncommon ones first, by hash; no two equal but by hash."""
    level = np.zeros(len(values), dtype=np.uint64)
    listed, levels = common
    if len(listed):
        place = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
        level = np.where(listed[place] == values, levels[place], level)
    return (level << np.uint64(57)) | (values >> np.uint64(7))


def _node_table(docs: DataFrame, common) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = common.value
        for batch in W.slices(batches, "text"):
            n = batch.num_rows
            values, text = shingle_sets(batch.column("text"))
            ids, sizes = set_ids(values, text, n)
            group = (values >> np.uint64(20)) % np.uint64(GROUPS)
            points = np.bincount(text * GROUPS + group.astype(np.int64), minlength=n * GROUPS).astype("<i4").reshape(n, GROUPS)
            rank = ranks(values, listed)
            order = np.lexsort((rank, text))
            rank, text = rank[order], text[order]
            place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            in_prefix = place < (sizes - (4 * sizes + 4) // 5 + 1)[text]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_key"), pa.array(ids.view(np.int64)), pa.array(sizes.astype(np.int64)),
                 W.lists(rank[in_prefix].view(np.int64), text[in_prefix], n, pa.int64()), pa.array([p.tobytes() for p in points], pa.binary())],
                ["doc_id", "_key", "node", "n", "prefix", "point"])

    return docs.select("doc_id", "_key", "text").mapInArrow(
        run, f"doc_id {kind}, _key bigint, node bigint, n bigint, prefix array<bigint>, point binary")


def _block_rows(nodes: DataFrame, active: np.ndarray, spark: SparkSession) -> DataFrame:
    """(key, node, place in the prefix) of prefixes whose key may be active."""
    held = spark.sparkContext.broadcast(active)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            keys = prefix.flatten().to_numpy()
            node = np.repeat(batch.column("node").to_numpy(), prefix.value_lengths().to_numpy())
            sizes = prefix.value_lengths().to_numpy()
            at = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = _in_filter(held.value, keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(node[keep]), pa.array(at[keep])], ["key", "node", "at"])

    return nodes.select("node", "prefix").mapInArrow(run, "key bigint, node bigint, at bigint")


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose points allow a link."""
    side = nodes.select("node", "n", "point")

    def named(c: str) -> DataFrame:
        return side.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"point_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p, q = (np.frombuffer(b"".join(batch.column(f"point_{c}").to_pylist()), "<i4").reshape(-1, GROUPS) for c in "ab")
            n, m = (batch.column(f"n_{c}").to_numpy() for c in "ab")
            passed = batch.filter(pa.array(_may_link(p, n, q, m)))
            yield passed.select(["a", "b"])

    return pairs.join(named("a"), "a").join(named("b"), "b").mapInArrow(run, "a bigint, b bigint")


def _sets_of(docs: DataFrame, wanted: DataFrame, stages: Stages) -> DataFrame:
    """(node, shingles) of the wanted nodes (node, _key), and of a few others that the filter lets pass."""
    held = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted, "_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.filter(pa.array(_in_filter(held.value, batch.column("_key").to_numpy())))
            for part in W.slices([batch], "text"):
                values, text = shingle_sets(part.column("text"))
                ids, _ = set_ids(values, text, part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.view(np.int64)), W.lists(values.view(np.int64), text, part.num_rows, pa.int64())], ["node", "shingles"])

    # A repeated row repeats its node's set, and with it links, which are made distinct later.
    return stages.put(docs.select("_key", "text").mapInArrow(run, "node bigint, shingles array<bigint>"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b")):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                keep.append(9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    def named(c: str) -> DataFrame:
        return sets.select(F.col("node").alias(c), F.col("shingles").alias(f"shingles_{c}"))

    return pairs.join(named("a"), "a").join(named("b"), "b").mapInArrow(run, "a bigint, b bigint")


def _search_pieces(rows: DataFrame, best_only: bool) -> DataFrame:
    """Pairs of nodes of different components in one block that the trees let pass; or for each node its best.

    rows: key, low, high (the pieces that meet), piece, node, at, label, n, point; sorted by (key, low, high) within
    partitions. At most two pieces are held at a time.
    """

    def pairs_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, label, n, piece, at = (group.column(c).to_numpy() for c in ("node", "label", "n", "piece", "at"))
        points = np.frombuffer(b"".join(group.column("point").to_pylist()), "<i4").reshape(-1, GROUPS)
        alone = group.column("low")[0].as_py() == group.column("high")[0].as_py()
        inner = np.arange(len(node)) if alone else np.flatnonzero(piece == piece.min())
        outer = inner if alone else np.flatnonzero(piece != piece.min())
        if not len(inner) or not len(outer):
            return node[:0], node[:0]
        tree, a, b = CountTree(points[inner], n[inner]), [], []
        for i in outer:
            hit = inner[tree.search(points[i], int(n[i]))]
            # In the block of their first common shingle two sets share at most what follows it in each.
            after = np.minimum(n[hit] - at[hit], n[i] - at[i])
            once = (node[hit] < node[i]) | (not alone) | best_only
            hit = hit[(label[hit] != label[i]) & once & (after >= needed(n[hit], n[i]))]
            if best_only and len(hit) > 1:
                shared = np.minimum(points[hit], points[i]).sum(axis=1) / (n[hit] + n[i])
                hit = hit[[int(np.argmax(shared))]]
            a.append(np.minimum(node[hit], node[i]))
            b.append(np.maximum(node[hit], node[i]))
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ready(table: pa.Table, final: bool) -> tuple[list, pa.Table | None]:
            if not table.num_rows:
                return [], None
            key = np.column_stack([table.column(c).to_numpy() for c in ("key", "low", "high")])
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist(), table.num_rows]
            stop = len(edges) - 1 if final else len(edges) - 2
            found = [pairs_of(table.slice(edges[i], edges[i + 1] - edges[i])) for i in range(stop) if edges[i + 1] - edges[i] > 1]
            return found, None if final else table.slice(edges[stop])

        def out(found: list) -> pa.RecordBatch:
            a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            found, rest = ready(pa.concat_tables([rest, table]) if rest is not None else table, False)
            if found:
                yield out(found)
        if rest is not None:
            found, _ = ready(rest, True)
            if found:
                yield out(found)

    return rows.mapInArrow(run, "a bigint, b bigint")


def _forest(blocks: DataFrame, labels: DataFrame, nodes: DataFrame, best_only: bool) -> DataFrame:
    """Candidate pairs of the blocks that hold several components; or only each node's best in a piece."""
    labelled = blocks.join(labels, "node", "left").select("key", "node", "at", F.coalesce("label", "node").alias("label"))
    mixed = (
        labelled.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low <> high AND rows > 2").select("key", F.ceil(F.col("rows") / PIECE).cast("int").alias("pieces"))
    )
    dealt = (
        labelled.join(mixed, "key")
        .withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .join(nodes.select("node", "n", "point"), "node")
        .select("key", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), "piece", "node", "at", "label", "n", "point")
    )
    return _search_pieces(dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high"), best_only)


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes are in different components."""
    for c in "ab":
        pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")), c, "left")
    return pairs.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def _placed(docs: DataFrame) -> tuple[DataFrame, Stages]:
    """doc_id, _key, n, label of every row of `docs` (doc_id, text, _key); rows of a component share a label."""
    spark = docs.sparkSession
    stages = Stages(spark, "jaccard-join")
    common = spark.sparkContext.broadcast(common_shingles(docs))
    full = stages.put(_node_table(docs, common))
    members = stages.put(full.select("doc_id", "_key", "node", "n"))
    nodes = stages.put(full.filter("n > 0").drop("doc_id").dropDuplicates(["node"]))
    stages.drop(full)

    shared = (
        nodes.select("node", F.explode("prefix").alias("key"))
        .groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last").select("key")
    )
    shared = stages.put(shared)
    rows = stages.put(_block_rows(nodes, _filter_of(shared, "key"), spark).join(shared, "key"))
    # Blocks of the same members are one block; the first of their keys is the first shingle that any two share.
    blocks = (
        rows.groupBy("key").agg(
            F.count(F.lit(1)).alias("rows"), F.min("node").alias("hub"),
            F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
        .groupBy("rows", "x", "y", "hub").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("keys"))
    )
    blocks = stages.put(rows.join(blocks.select("key", "hub", "keys", F.col("rows").alias("members")), "key"))

    ties = blocks.filter("node <> hub").groupBy("hub", "node").agg(F.sum("keys").alias("keys"), F.min("members").alias("members"))
    nearest = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("keys"), "hub"))
    placed = ties.withColumn("place", nearest).select(F.col("hub").alias("a"), F.col("node").alias("b"), "members", "place")
    hubs = placed.filter(F.col("place") <= HUBS).select("a", "b")
    # The forest looks at blocks of three and more only; the pair that is a block of its own is kept for the last pass.
    twos = stages.put(placed.filter((F.col("place") > HUBS) & (F.col("members") == 2)).select("a", "b"))
    checked = stages.put(_bounded(hubs, nodes))
    links = stages.put(_checked(docs, checked, nodes, stages))
    labels = components(links, stages)
    for best_only in (True, False):
        found = _forest(blocks, labels, nodes, best_only)
        if not best_only:
            found = found.union(_bounded(_apart(twos, labels), nodes))
        pairs = stages.put(found.distinct().join(checked, ["a", "b"], "left_anti"))
        if pairs.limit(1).count():
            checked = checked.union(pairs)
            links = links.union(stages.put(_checked(docs, pairs, nodes, stages)))
            labels = components(links, stages)
    placed = members.join(labels, "node", "left").select("doc_id", "_key", "n", F.coalesce("label", "node").alias("label"))
    return stages.put(placed), stages


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))


def similarity_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id, text)."""
    placed, stages = _placed(_keyed(docs))
    least = stages.put(placed.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("least")))
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return placed.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without those that are linked to an earlier one; order by doc_id, null first.

    Of equal rows one stays. Rows without words are linked with nothing and all stay.
    """
    docs, back = set_aside(docs, ["_key"])
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    placed, _ = _placed(keyed.select("doc_id", "text", "_key"))
    first = placed.filter("n > 0").groupBy("label").agg(F.min(F.struct("doc_id", "_key")).alias("first")).select("first._key")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.filter(worded).join(first, "_key", "left_semi").dropDuplicates(["_key"])
    return kept.select(*docs.columns).union(docs.filter(~worded)).withColumnsRenamed(back)


def _checked(keyed: DataFrame, pairs: DataFrame, nodes: DataFrame, stages: Stages) -> DataFrame:
    """The pairs whose sets are similar; sets are read again from the texts of the nodes in question."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stages.put(nodes.select("node", "_key").join(wanted, "node"))
    return _verified(pairs, _sets_of(keyed, wanted, stages))
