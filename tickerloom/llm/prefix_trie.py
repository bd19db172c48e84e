"""Trie of conversation prefixes: sorted sequences, longest common prefixes, range minima in sparse tables.

Conversations are sorted by the digests of their turns, so the members of every prefix stand side by side. In a
piece of the sorted rows, each candidate prefix (a row, a depth) finds the ends of its members by two binary
searches in a sparse table of range minima over the common prefixes of neighbours; no stack, no order between
candidates. Everything that is returned is a sum or a minimum over member rows:

* a child or a node is counted at the row that is the first to have it, a leaf at the last row that has it;
* saved = (sizes of the members below the prefix) - (sizes of the nodes that begin among them).

So pieces may be cut anywhere: a prefix that runs over several gets a row from each, and those are added up. Only
what two neighbouring tasks both counted, on the prefixes that the last row of one and the first row of the next
share, is taken back; that needs one row a task. A prefix held by a third of all conversations is one row a piece.

A turn is carried as its digest and size; texts are not shuffled. One conversation's digests are one value.

Rows without a conv_id take no part; a null turn comes first, null role or text count as empty, turns of one number
are ordered by digest, repeated rows are turns of their own. A table without conversations has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickerloom.llm.staging import Stages

DIGEST = 16
_PARTIAL = (
    "key binary, parent binary, depth long, n_convs long, conv_id long, n_children long, n_leaves long, saved long,"
    " ends string, first_id long, ids string, part int, first_path binary, first_sizes array<long>, last_path binary"
)
_SUMS = ["n_convs", "n_children", "n_leaves", "saved"]
_ROOT = bytes(DIGEST)


# ---- sequences ----


def turn_lists(conversations: DataFrame) -> DataFrame:
    """`conv_id, turns`: each conversation's turns in order, as (turn, digest, size in code points)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("size")).alias("t"),
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def shared_openings(lists: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Every conversation c opens with the first h turns of conversation c - c % every, h = crc32(c) % (most + 1), and
    goes on with its own turns after its first h. Only conversations divisible by `every` lend turns: short lists."""
    openings = lists.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_lender"), F.slice("turns", 1, most).alias("_opening")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    own = lists.withColumns({"_lender": F.col("conv_id") - F.col("conv_id") % every, "_h": h})
    nothing = F.slice("turns", 1, 0)
    head = F.slice(F.coalesce("_opening", nothing), F.lit(1), F.col("_h"))
    tail = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return own.join(openings, "_lender", "left").select("conv_id", F.concat(head, tail).alias("turns"))


def paths(lists: DataFrame) -> DataFrame:
    """`conv_id, path, sizes`: digests end to end, which sort so that a prefix comes before what extends it."""
    hexes: Column = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    return lists.select("conv_id", F.unhex(hexes).alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


# ---- one piece of sorted rows ----


class _Piece:
    """Rows of one Arrow batch: ids, how many turns each has, digests and sizes of all turns end to end."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
        path = batch.column("path").cast(pa.large_binary())
        bounds = np.frombuffer(path.buffers()[1], np.int64)[path.offset : path.offset + len(path) + 1]
        held = path.buffers()[2]
        self.raw = held.to_pybytes()[bounds[0] : bounds[-1]] if held is not None else b""
        self.digests = np.frombuffer(self.raw, np.uint64).reshape(-1, 2)
        self.start = (bounds - bounds[0]) // DIGEST
        self.turns = np.diff(self.start)
        self.sizes = batch.column("sizes").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.upto = np.concatenate([[0], np.cumsum(self.sizes)])

    def path(self, row: int) -> bytes:
        return self.raw[self.start[row] * DIGEST : self.start[row + 1] * DIGEST]

    def common(self) -> np.ndarray:
        """How many turns each row shares with the row before; 0 for the first."""
        n = len(self.ids)
        both = np.minimum(self.turns[:-1], self.turns[1:])
        row = np.repeat(np.arange(1, n), both)
        place = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
        differ = np.flatnonzero((self.digests[self.start[row - 1] + place] != self.digests[self.start[row] + place]).any(axis=1))
        out = np.concatenate([[0], both])
        first, at = np.unique(row[differ], return_index=True)
        out[first] = place[differ[at]]
        return out


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // DIGEST
    x, y = (np.frombuffer(p[: n * DIGEST], np.uint64).reshape(-1, 2) for p in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else n


class RangeMinimum:
    """Minimum of any stretch, from minima of all stretches of a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def minimum(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Over low..high, both included."""
        out = np.empty(len(low), self.levels[0].dtype)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << int(k)) + 1])
        return out

    def last_right(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last row that `row` reaches over values of at least `depth`; value j stands between rows j - 1 and j."""
        at, n = row.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            open_ = np.flatnonzero(at + step < n)
            on = open_[level[at[open_] + 1] >= depth[open_]]
            at[on] += step
        return at

    def first_left(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        at = row.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            open_ = np.flatnonzero(at - step >= 0)
            on = open_[level[at[open_] - step + 1] >= depth[open_]]
            at[on] -= step
        return at


def _node_keys(piece: _Piece, common: np.ndarray, first_depth: np.ndarray) -> list[bytes]:
    """Digest of every candidate prefix, chained from the root."""
    keys, chain, raw = [], [_ROOT], piece.raw
    for row in range(len(piece.ids)):
        del chain[(int(common[row]) if row else 0) + 1 :]
        at = int(piece.start[row])
        for depth in range(len(chain) - 1, int(piece.turns[row])):
            chain.append(hashlib.md5(chain[-1] + raw[(at + depth) * DIGEST : (at + depth + 1) * DIGEST]).digest())
        keys += chain[int(first_depth[row]) : int(piece.turns[row]) + 1]
    return keys


def _partials(piece: _Piece, before: bytes | None, after: bytes | None) -> pa.RecordBatch:
    """One row per prefix of the piece; `before` and `after` are the neighbouring rows of the same task."""
    n = len(piece.ids)
    common = piece.common()
    minima = RangeMinimum(common)
    from_before = shared_turns(before, piece.path(0)) if before is not None else 0
    first_depth = common + 1
    first_depth[0] = 0
    count = np.maximum(piece.turns - first_depth + 1, 0)
    base = np.cumsum(count) - count
    row = np.repeat(np.arange(n), count)
    depth = np.arange(len(row)) - base[row] + first_depth[row]
    last = minima.last_right(row, depth)
    above = minima.first_left(row, depth - 1)
    parent = np.where(depth > 0, base[above] + depth - 1 - first_depth[above], 0)
    begins = ~((row == 0) & (depth <= from_before))

    begin = piece.upto[piece.start[:-1]]
    total = piece.upto[piece.start[1:]] - begin
    known = common.copy()
    known[0] = from_before
    new = total - (piece.upto[piece.start[:-1] + known] - begin)
    upto_total, upto_new = (np.concatenate([[0], np.cumsum(x)]) for x in (total, new))
    above_size = np.where(depth > 0, piece.upto[piece.start[row] + np.maximum(depth - 1, 0)] - begin[row], 0)
    members = last - row + 1
    made = upto_new[last + 1] - upto_new[row + 1] + np.where(begins, total[row] - above_size, new[row])
    saved = upto_total[last + 1] - upto_total[row] - members * above_size - made

    follows = np.append(common[1:], shared_turns(piece.path(n - 1), after) if after is not None else -1)
    leaf = np.concatenate([[0], np.cumsum((piece.turns > 0) & (follows < piece.turns))])
    child = begins & (depth > 0)

    # Conversations that end at a prefix come first among its members, in order of their ids.
    run = np.append(np.flatnonzero(np.append(True, ~((common[1:] == piece.turns[1:]) & (piece.turns[1:] == piece.turns[:-1])))), n)
    run_end = run[np.searchsorted(run, row, side="right")]
    ends, first_id, ids = [None] * len(row), [None] * len(row), [None] * len(row)
    for i in np.flatnonzero(depth == piece.turns[row]):
        low, high = int(row[i]), int(run_end[i])
        listed = ",".join(map(str, piece.ids[low:high].tolist()))
        if low == 0 or high == n:
            first_id[i], ids[i] = int(piece.ids[low]), listed
        else:
            ends[i] = hashlib.sha256(listed.encode()).hexdigest()

    keys = _node_keys(piece, common, first_depth)
    columns = {
        "key": pa.array(keys, pa.binary()),
        "parent": pa.array([keys[p] if d else None for p, d in zip(parent.tolist(), depth.tolist())], pa.binary()),
        "depth": depth, "n_convs": members, "conv_id": RangeMinimum(piece.ids).minimum(row, last),
        "n_children": np.bincount(parent[child], minlength=len(row)), "n_leaves": leaf[last + 1] - leaf[row], "saved": saved,
        "ends": pa.array(ends, pa.string()), "first_id": pa.array(first_id, pa.int64()), "ids": pa.array(ids, pa.string()),
    }
    return _row_batch(columns, len(row))


_KINDS = {
    "key": pa.binary(), "parent": pa.binary(), "depth": pa.int64(), "n_convs": pa.int64(), "conv_id": pa.int64(), "n_children": pa.int64(),
    "n_leaves": pa.int64(), "saved": pa.int64(), "ends": pa.string(), "first_id": pa.int64(), "ids": pa.string(), "part": pa.int32(),
    "first_path": pa.binary(), "first_sizes": pa.list_(pa.int64()), "last_path": pa.binary(),
}


def _row_batch(columns: dict, n: int) -> pa.RecordBatch:
    arrays = [pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in _KINDS.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(_KINDS))


def _sorted_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of each batch, and at the end the first and last row of the task."""
    piece, before, first = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        following = _Piece(batch)
        if piece is None:
            first = (following.path(0), following.sizes[: following.turns[0]].tolist())
        else:
            yield _partials(piece, before, following.path(0))
            before = piece.path(len(piece.ids) - 1)
        piece = following
    if piece is not None:
        yield _partials(piece, before, None)
        last = piece.path(len(piece.ids) - 1)
        yield _row_batch({"part": [TaskContext.get().partitionId()], "first_path": [first[0]], "first_sizes": [first[1]], "last_path": [last]}, 1)


def _counted_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What to add where the first row of a task shares turns with the last row of the task before."""
    for batch in batches:
        for edge in batch.to_pylist():
            path, left = edge["first_path"], edge["before"]
            shared = shared_turns(left, path)
            if not shared:
                continue
            upto = np.concatenate([[0], np.cumsum(edge["first_sizes"])])
            chain = [_ROOT]
            for d in range(shared):
                chain.append(hashlib.md5(chain[-1] + path[d * DIGEST : (d + 1) * DIGEST]).digest())
            extended = -int(shared * DIGEST == len(left))
            depth = np.arange(shared + 1)
            above = np.concatenate([[0], upto[:shared]])
            yield _row_batch({
                "key": chain, "parent": [None, *chain[:-1]], "depth": depth, "n_convs": np.zeros(shared + 1, np.int64),
                "n_children": -(depth < shared).astype(np.int64), "n_leaves": np.full(shared + 1, extended), "saved": upto[shared] - above,
            }, shared + 1)


def _digest_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's lists joined in order. A digest is a sequential function, so one task reads a key's lists, one
    after the other and without holding them."""

    def out(rows):
        return pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in rows], pa.binary()), "open_ends": pa.array([h for _, h in rows], pa.string())})

    key, state, done = None, None, []
    for batch in batches:
        for k, listed in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(listed.encode())
            else:
                state.update(b"," + listed.encode())
        if done:
            yield out(done)
            done = []
    if key is not None:
        yield out([(key, state.hexdigest())])


# ---- the trie ----


def trie(sequences: DataFrame) -> DataFrame:
    """One row per distinct prefix of `sequences` (`conv_id, path, sizes`; conv_id unique): conv_id of its smallest member,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = sequences.sparkSession
    stages = Stages(spark, "prefix-trie")
    source = stages.put(sequences)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    partials = stages.put(ordered.mapInArrow(_sorted_task, _PARTIAL))
    stages.drop(source)

    edges = partials.where("part IS NOT NULL").select(
        "first_path", "first_sizes", F.lag("last_path").over(Window.orderBy("part")).alias("before")
    )
    again = edges.where("before IS NOT NULL").mapInArrow(_counted_twice, _PARTIAL)
    counted = partials.where("key IS NOT NULL").unionByName(again)
    merged = counted.groupBy("key", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in _SUMS], F.max("ends").alias("ends")
    )
    lists = partials.where("ids IS NOT NULL").select("key", "first_id", "ids")
    open_ends = lists.repartition("key").sortWithinPartitions("key", "first_id").select("key", "ids").mapInArrow(
        _digest_of_lists, "key binary, open_ends string"
    )
    ends = F.coalesce("ends", "open_ends", F.sha2(F.lit("").cast("binary"), 256))
    nodes = stages.put(merged.join(open_ends, "key", "left").withColumn("ends", ends).drop("open_ends"))
    stages.drop(partials)

    # Written first: both sides then have their own exchange, and Spark can split the children of a hot prefix.
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        # Only a root without children has no leaf below it: it is one.
        F.greatest(F.col("n_leaves"), F.lit(1).cast("long")).alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that share openings (see `shared_openings`)."""
    return trie(paths(shared_openings(turn_lists(conversations))))
