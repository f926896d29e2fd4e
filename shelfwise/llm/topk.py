"""Exact top-k by inner product, with KD-trees per shard.

A shard is a slice of a partition. Its tree splits at medians of the widest dimension and keeps the tight bounding box
of every node, inner ones too; a box bounds the inner product with a query. Trees are built once and written to the
shared folder. A query goes through a tree best first: of the nodes it has opened it takes the one with the best bound,
opens it or scores its rows, and stops where no bound can reach its kth score. All queries of a block take their steps
together, so that the scores of a leaf come from one matrix product.

The kth score is carried along: every block first searches one shard, and what it finds there bounds its search of all
others; within a task it goes on from shard to shard. Blocks of queries and groups of shards meet by a key, so no block
passes the driver, no task gets all of a side, and the volume shuffled is a block for each group and a shard for each
chunk of blocks.

Vectors are quantised, floor(256 x) for each component, so scores are exact integers; ties go to the smaller id. A score
beyond 64 bits is an error. Null and empty vectors, null or non-finite components and null ids take no part, and a vector
of another length than the query scores nothing with it. A query's own id is no candidate. Queries with the same id are
answered once, by the vector that sorts first. Empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.tables import cut_lineage

#: Rows of a shard and of a leaf, queries of a block, and bytes of vectors that a shard or block holds at most.
SHARD, LEAF, BLOCK, VECTOR_BYTES = 8192, 64, 2048, 4 << 20
#: Shards of a group and blocks of a chunk, which meet in one task; blocks whose best a task holds at a time.
GROUP, CHUNK, HELD = 16, 64, 8
SCALE = 256
NONE = np.iinfo(np.int64).min
EXACT = float(2**53)


def quantised(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer vectors, as float64, of a batch's fit rows: one pair for each length of vectors."""
    ids, vectors = batch.column(0), batch.column(1)
    lengths = pa.compute.list_value_length(vectors)
    for n in [x for x in lengths.unique().to_pylist() if x]:
        rows = pa.compute.and_kleene(pa.compute.equal(lengths, n), ids.is_valid())
        some = batch.filter(rows)
        x = some.column(1).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, n)
        fit = np.isfinite(x).all(axis=1)
        with np.errstate(over="ignore"):
            yield some.column(0).to_numpy(zero_copy_only=False)[fit], np.floor(x[fit] * SCALE)


class Tree:
    """A shard's tree: node 0 is the root, a node's children are left and left + 1, and a leaf has left -1 and rows of its own."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, left: np.ndarray, start: np.ndarray, stop: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.ids, self.x, self.left, self.start, self.stop, self.low, self.high = ids, x, left, start, stop, low, high

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray) -> Tree:
        nodes = [np.argsort(ids, kind="stable")]
        left, low, high, start, stop, order = [], [], [], [], [], []
        placed, at = 0, 0
        while at < len(nodes):
            rows = nodes[at]
            at += 1
            low.append(x[rows].min(axis=0))
            high.append(x[rows].max(axis=0))
            widest = int(np.argmax(high[-1] - low[-1]))
            if len(rows) <= LEAF or high[-1][widest] == low[-1][widest]:
                left.append(-1)
                start.append(placed)
                placed += len(rows)
                stop.append(placed)
                order.append(rows)
                continue
            half = np.zeros(len(rows), bool)
            half[np.argsort(x[rows, widest], kind="stable")[: len(rows) // 2]] = True
            left.append(len(nodes))
            start.append(0)
            stop.append(0)
            nodes += [rows[half], rows[~half]]
        order = np.concatenate(order)
        return cls(ids[order], x[order], np.array(left), np.array(start), np.array(stop), np.stack(low), np.stack(high))

    COLUMNS = ("ids", "x", "left", "start", "stop", "low", "high")

    def packed(self) -> tuple[bytes, ...]:
        return tuple(np.ascontiguousarray(getattr(self, c), np.float64 if c in ("x", "low", "high") else np.int64).tobytes() for c in self.COLUMNS)

    @classmethod
    def unpacked(cls, dim: int, parts: list[bytes]) -> Tree:
        flat = {c: np.frombuffer(p, np.float64 if c in ("x", "low", "high") else np.int64) for c, p in zip(cls.COLUMNS, parts)}
        return cls(**{c: v.reshape(-1, dim) if c in ("x", "low", "high") else v for c, v in flat.items()})


class Queries:
    """A block of queries of one length and, for each, the k best so far; floor: scores that its kth best reaches anyway."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.x, self.k, self.floor = ids, x, k, floor
        self.up, self.down = np.maximum(x, 0), np.minimum(x, 0)
        self.scores = np.full((len(ids), k), NONE, np.int64)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)

    def products(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Scores of the queries q with rows, exactly."""
        if float(np.abs(self.x[q]).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < EXACT:
            return (self.x[q] @ x.T).astype(np.int64)
        one, two = [[[int(v) for v in row] for row in m.tolist()] for m in (self.x[q], x)]
        whole = [[sum(a * b for a, b in zip(u, v)) for v in two] for u in one]
        if any(not NONE < s < 2**63 for row in whole for s in row):
            raise ValueError("a score takes more than 64 bits")
        return np.array(whole, np.int64).reshape(len(q), len(x))

    def offer(self, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Scores the rows of a leaf for the queries q."""
        s = self.products(q, x)
        s[self.ids[q][:, None] == ids[None, :]] = NONE
        better = (s > self.scores[q, -1:]) | ((s == self.scores[q, -1:]) & (ids[None, :] < self.found[q, -1:]))
        better &= s > NONE
        some = np.flatnonzero(better.any(axis=1))
        if not some.size:
            return
        cols = np.flatnonzero(better[some].any(axis=0))
        s = np.where(better[some][:, cols], s[some][:, cols], NONE)
        rows = q[some]
        both = np.concatenate([self.scores[rows], s], axis=1)
        names = np.concatenate([self.found[rows], np.where(s > NONE, ids[cols][None, :], np.iinfo(np.int64).max)], axis=1)
        # Descending scores as ascending numbers: the complement of an integer orders them the other way without overflow.
        order = np.lexsort((names, ~both), axis=1)[:, : self.k]
        self.scores[rows], self.found[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

    def bounds(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The best score that each query q may have in its box; rounding can't make it less than it is."""
        best = np.einsum("qd,qd->q", self.up[q], high) + np.einsum("qd,qd->q", self.down[q], low)
        size = np.einsum("qd,qd->q", self.up[q] - self.down[q], np.maximum(np.abs(low), np.abs(high)))
        return np.where(size < EXACT, best, best + size * 1e-12)

    def search(self, tree: Tree) -> None:
        """Best first, all queries together: in each round every query that may still gain takes the best node it has opened."""
        active = np.arange(len(self.ids))
        opened = np.full((len(active), len(tree.left)), -np.inf)
        opened[:, 0] = self.bounds(active, np.broadcast_to(tree.low[0], self.x.shape), np.broadcast_to(tree.high[0], self.x.shape))
        while True:
            node = np.argmax(opened[active], axis=1)
            gain = opened[active, node] >= np.maximum(self.scores[active, -1], self.floor[active])
            active, node = active[gain], node[gain]
            if not active.size:
                return
            opened[active, node] = -np.inf
            child = tree.left[node]
            for side in (0, 1):
                q, kids = active[child >= 0], child[child >= 0] + side
                opened[q, kids] = self.bounds(q, tree.low[kids], tree.high[kids])
            q, leaf = active[child < 0], node[child < 0]
            by = np.argsort(leaf, kind="stable")
            at = np.flatnonzero(np.diff(leaf[by], prepend=-1))
            for a, b in zip(at, [*at[1:], len(by)]):
                rows = slice(tree.start[leaf[by[a]]], tree.stop[leaf[by[a]]])
                self.offer(q[by[a:b]], tree.ids[rows], tree.x[rows])


def shards(vectors: DataFrame) -> DataFrame:
    """A row for each shard: dim, and the tree's parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD):
                for ids, x in quantised(batch.slice(start, SHARD)):
                    step = max(1, min(SHARD, VECTOR_BYTES // (8 * x.shape[1])))
                    for at in range(0, len(ids), step):
                        parts = Tree.build(ids[at : at + step], x[at : at + step]).packed()
                        yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], names=["dim", *Tree.COLUMNS])

    return vectors.mapInArrow(run, "dim int, " + ", ".join(f"{c} binary" for c in Tree.COLUMNS))


def blocks(asked: DataFrame) -> DataFrame:
    """A row for each block of queries: dim, query_ids and query_x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                for ids, x in quantised(batch.slice(start, BLOCK)):
                    step = max(1, min(BLOCK, VECTOR_BYTES // (8 * x.shape[1])))
                    for at in range(0, len(ids), step):
                        parts = [np.ascontiguousarray(ids[at : at + step], np.int64).tobytes(), x[at : at + step].tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], names=["dim", "query_ids", "query_x"])

    return asked.mapInArrow(run, "dim int, query_ids binary, query_x binary")


def pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[dict, Tree]]:
    """Block and tree of each row of a batch, one at a time."""
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
        yield row, Tree.unpacked(row["dim"], [row[c] for c in Tree.COLUMNS])


def block_of(row: dict, k: int) -> Queries:
    ids, x = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["query_x"], np.float64).reshape(-1, row["dim"])
    return Queries(ids, x, k, np.frombuffer(row["floor"], np.int64) if row.get("floor") else np.full(len(ids), NONE, np.int64))


def search(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id and score: for each query its k best rows of df."""
    arrays = lambda d: d.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    trees = cut_lineage(shards(arrays(df)).withColumn("shard", F.monotonically_increasing_id()))
    asked = arrays(queries).where("id is not null and vector is not null").groupBy("id").agg(F.min("vector").alias("vector"))
    packed = cut_lineage(blocks(asked).withColumn("block", F.monotonically_increasing_id()))
    many, cores = trees.count(), df.sparkSession.sparkContext.defaultParallelism
    groups, chunks = max(1, -(-many // GROUP), min(many, 2 * cores)), max(1, -(-packed.count() // CHUNK))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, tree in pairs_of(batch):
                q = block_of(row, k)
                q.search(tree)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([q.scores[:, -1].tobytes()], pa.binary())], names=["block", "floor"])

    # One shard of each length of vectors, of bounded size, goes to all blocks.
    first = trees.join(F.broadcast(trees.groupBy("dim").agg(F.min("shard").alias("shard"))), ["dim", "shard"]).drop("shard")
    floors = cut_lineage(packed.join(F.broadcast(first), "dim").select("dim", "block", "query_ids", "query_x", *Tree.COLUMNS).mapInArrow(seed, "block bigint, floor binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, Queries] = OrderedDict()

        def best(q: Queries) -> pa.RecordBatch:
            row, col = np.nonzero(q.scores > NONE)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in (q.ids[row], q.found[row, col], q.scores[row, col])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row, tree in pairs_of(batch):
                if row["block"] not in held:
                    if len(held) == HELD:
                        yield best(held.popitem(last=False)[1])
                    held[row["block"]] = block_of(row, k)
                held.move_to_end(row["block"])
                held[row["block"]].search(tree)
        for q in held.values():
            yield best(q)

    part = lambda name, many: F.pmod(F.xxhash64(name), F.lit(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = packed.join(floors, "block", "left").withColumn("chunk", part("block", chunks)).withColumn("group", each(groups))
    right = trees.withColumn("group", part("shard", groups)).withColumn("chunk", each(chunks)).drop("shard")
    met = left.join(right, ["dim", "group", "chunk"]).select("dim", "block", "query_ids", "query_x", "floor", *Tree.COLUMNS)
    found = met.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
