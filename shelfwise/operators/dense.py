"""Nearest vectors by cosine: shards of donors meet parts of the queries, and each task keeps the k best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of vectors in a shard of donors, which a task holds, and queries and donors whose scores are made at once.
SHARD_BYTES, QUERIES_AT_ONCE, DONORS_AT_ONCE = 32 << 20, 256, 4096


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, ids and vectors brought to length 1 of a batch's ids and vectors; those of nothing stay zero, those with other than finite components are left out."""
    lengths = pa.compute.list_value_length(batch.column("x"))
    for dim in [n for n in lengths.unique().to_pylist() if n]:
        some = batch.filter(pa.compute.equal(lengths, dim))
        x = some.column("x").flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
        ids = some.column("id").to_numpy(zero_copy_only=False)
        fit = np.isfinite(x).all(axis=1)
        yield dim, ids[fit], x[fit] / np.maximum(np.linalg.norm(x[fit], axis=1, keepdims=True), 1e-12)


def best_of(ids: np.ndarray, x: np.ndarray, held: np.ndarray, y: np.ndarray, k: int, descending_ids: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the query, donor and cosine of the k best donors of each query; held is sorted.

    A score under a query's kth so far by more than rounding can give is never looked at again.
    """
    at, donors, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.full(len(ids), -np.inf)
    for start in range(0, len(held), DONORS_AT_ONCE):
        some = held[start : start + DONORS_AT_ONCE]
        s = x @ y[start : start + DONORS_AT_ONCE].T
        first, stop = np.searchsorted(some, ids), np.searchsorted(some, ids, "right")
        for q in np.flatnonzero(stop > first):
            s[q, first[q] : stop[q]] = -np.inf
        if start == 0 and len(some) > k:
            least = np.partition(s, len(some) - k, axis=1)[:, len(some) - k]
        row, col = np.nonzero((s >= least[:, None] - 2e-6) & (s > -np.inf))
        at, donors, scores = np.concatenate([at, row]), np.concatenate([donors, some[col]]), np.concatenate([scores, np.round(s[row, col], 6) + 0.0])
        order = np.lexsort((-donors if descending_ids else donors, -scores, at))
        at, donors, scores = at[order], donors[order], scores[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        at, donors, scores, place = (v[place < k] for v in (at, donors, scores, place))
        full = place == k - 1
        least[at[full]] = np.maximum(least[at[full]], scores[full])
    return at, donors, scores


def top_k(queries: DataFrame, donors: DataFrame, id_col: str, vector_col: str, k: int, descending_ids: bool = False) -> DataFrame:
    """query, donor, cosine (to six digits) and rank of the k best donors of each query, itself left out; ties to the smaller id, or the greater.

    Null and empty vectors and those with null or non-finite components take no part. Donors are dealt into shards, queries
    into parts; a task holds one shard, read first, and streams the rows of a part against it, so neither a task's memory nor
    an Arrow batch grows with the tables. All pairs are met: time grows with queries times donors.
    """
    arrays = lambda d: d.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    tasks = 4 * donors.sparkSession.sparkContext.defaultParallelism
    size = donors.agg(F.sum(8 * F.size(vector_col).cast("bigint"))).first()[0] or 0
    shards = max(round(tasks**0.5), -(-size // SHARD_BYTES))
    parts = max(1, -(-tasks // shards))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = arrays(donors).withColumn("shard", of(shards)).withColumn("part", every(parts)).withColumn("query", F.lit(0))
    asked = arrays(queries).withColumn("part", of(parts)).withColumn("shard", every(shards)).withColumn("query", F.lit(1))
    cell = F.col("shard") * parts + F.col("part")
    dealt = held.unionByName(asked).select(cell.alias("cell"), "query", "id", "x").repartitionById(shards * parts, F.col("cell")).sortWithinPartitions("query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        shard: dict[int, tuple] = {}
        for batch in batches:
            asks = pa.compute.equal(batch.column("query"), 1)
            for dim, ids, x in matrices(batch.filter(pa.compute.invert(asks))):
                found.setdefault(dim, []).append((ids, x))
            for dim, ids, x in matrices(batch.filter(asks)):
                if dim not in found:
                    continue
                if dim not in shard:
                    held = np.concatenate([i for i, _ in found[dim]])
                    order = np.argsort(held, kind="stable")
                    shard[dim] = held[order], np.concatenate([y for _, y in found[dim]])[order]
                    found[dim] = []
                for start in range(0, len(ids), QUERIES_AT_ONCE):
                    some = ids[start : start + QUERIES_AT_ONCE]
                    at, donor, score = best_of(some, x[start : start + QUERIES_AT_ONCE], *shard[dim], k, descending_ids)
                    yield pa.RecordBatch.from_arrays([pa.array(some[at], pa.int64()), pa.array(donor, pa.int64()), pa.array(score, pa.float64())], names=["query", "donor", "cosine"])

    met = dealt.mapInArrow(run, "query bigint, donor bigint, cosine double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), F.desc("donor") if descending_ids else F.asc("donor")))
    return met.withColumn("rank", place).where(F.col("rank") <= k)
