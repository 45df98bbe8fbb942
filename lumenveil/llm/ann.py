"""Nearest neighbours by collision-counting hashing.

Every shard of vectors holds PROJECTIONS sorted arrays, one for each random projection. A query opens a window
around its own projected value in each array. Virtual rehashing widens all windows together, level by level;
only the entries that a level adds are counted. A vector that falls into the windows of at least THRESHOLD
of the projections is verified: its exact Euclidean distance is computed on the original vectors. A
query is done with a shard once its k-th verified distance is so small, against the window's width, that a
nearer vector would have passed the threshold almost surely; or once the windows cover the shard. No
cap is set on windows or candidates.

The index is built once: shards are formed from whatever a task reads, SHARD vectors of one length at a time, so no
vector is shuffled. Queries travel in blocks: each block of about QUERY_BLOCK queries is broadcast, searched in every
shard, and the shards' k best are merged by query. Where there is more than one block, the index is written
and each block reads it. A task's shards share each query's k-th distance so far, so that later shards stop sooner.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; a query meets the
vectors of its own length; an id that several query rows have is one query, with the smallest of their vectors; equal distances
go to the smaller vec_id; fewer candidates than k give fewer rows; repeated rows of one vec_id are candidates each, never for a query
of the same vec_id; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

PROJECTIONS = 48
#: Collisions that make a candidate.
THRESHOLD = 24
#: A vector at distance d from the query collides with a window of half-width w as often as |N(0,1)| < w / d.
#: At w / d = SURE that is 70 %, and fewer than THRESHOLD of the PROJECTIONS collide in about 0.2 % of cases.
SURE = 1.04
GROWTH = 1.3
SHARD = 16_384
QUERY_BLOCK = 8_192


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(v.isNotNull() & F.col("vec_id").isNotNull()).filter(fine & F.exists(v, lambda x: x != 0))


class Shard:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, sorted_: np.ndarray):
        """order, sorted_: of each projection the vectors' numbers by their projected value, and these values."""
        self.ids, self.vectors, self.order, self.sorted = ids, vectors, order, sorted_

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray) -> "Shard":
        values = vectors.astype(np.float32) @ axes  # n x m
        order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32).copy()  # m x n
        return cls(ids, vectors, order, np.take_along_axis(values.T, order, axis=1))

    def search(self, q_ids: np.ndarray, queries: np.ndarray, axes: np.ndarray, k: int, reach: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the query, ids, distances) of its k best, by distance and id.

        reach: of each query the k-th distance in other shards, infinite at first; what lies beyond isn't looked for. Lowered here.
        """
        reach = np.full(len(queries), np.inf) if reach is None else reach
        n, m = len(self.ids), len(self.order)
        at = (queries.astype(np.float32) @ axes).T  # m x queries
        spread = max(float(np.std(self.sorted)), 1e-12)
        # The first window takes about 4 k of n entries.
        first = spread * min(1.0, 4.0 * (k + 1) / n)
        active = np.arange(len(queries))
        counts = np.zeros((len(queries), n), np.uint8) if len(queries) * n <= 1 << 26 else None
        if counts is None:  # in parts that fit
            step = max(1, (1 << 26) // n)
            for lo in range(0, len(queries), step):
                for i, ids, d in self.search(q_ids[lo : lo + step], queries[lo : lo + step], axes, k, reach[lo : lo + step]):
                    yield lo + i, ids, d
            return
        low = np.stack([np.searchsorted(self.sorted[j], at[j]) for j in range(m)])
        high = low.copy()
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {int(i): (np.zeros(0, self.ids.dtype), np.zeros(0)) for i in active}
        width = first
        while len(active):
            new_low, new_high = np.empty((m, len(active)), np.int64), np.empty((m, len(active)), np.int64)
            for j in range(m):
                new_low[j] = np.searchsorted(self.sorted[j], at[j, active] - width)
                new_high[j] = np.searchsorted(self.sorted[j], at[j, active] + width, side="right")
            # Only what the level adds: the entries left and right of the windows so far.
            ends = np.stack([new_low, low[:, active], high[:, active], new_high]).transpose(2, 1, 0).tolist()
            for i, own_ends in zip(active.tolist(), ends):
                added = [order[p:q] for order, (a, b, c, d) in zip(self.order, own_ends) for p, q in ((a, b), (c, d)) if p < q]
                if added:
                    counts[i] += np.bincount(np.concatenate(added), minlength=n).astype(np.uint8)
            low[:, active], high[:, active] = np.minimum(new_low, low[:, active]), np.maximum(new_high, high[:, active])
            left = []
            for i in active.tolist():
                own = counts[i]
                got = np.flatnonzero((own >= THRESHOLD) & (own < 200))
                if len(got):
                    own[got] = 200  # verified; may count on to 248 but never past uint8
                    ids, diff = self.ids[got], self.vectors[got] - queries[i]
                    d = np.sqrt(np.cumsum(diff * diff, axis=1)[:, -1])  # summed in order, so that the result is reproducible
                    other = ids != q_ids[i]
                    ids, d = np.concatenate([best[i][0], ids[other]]), np.concatenate([best[i][1], d[other]])
                    keep = np.lexsort((ids, d))[:k]
                    best[i] = ids[keep], d[keep]
                if len(best[i][1]) >= k:
                    reach[i] = min(reach[i], best[i][1][-1])
                done = reach[i] * SURE <= width
                covered = not low[:, i].any() and (high[:, i] == n).all()
                if done or covered:
                    yield i, *best[i]
                else:
                    left.append(i)
            active = np.array(left, np.int64)
            width *= GROWTH


def _axes(dim: int) -> np.ndarray:
    return np.random.default_rng(17).standard_normal((dim, PROJECTIONS)).astype(np.float32)


INDEX = "dim int, ids binary, vectors binary, ord binary, sorted binary"


def index(rows: DataFrame) -> DataFrame:
    """The shards of rows (vec_id bigint, v), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(dim: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            s = Shard.build(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), _axes(dim))
            cols = [pa.array([x.tobytes()], pa.binary()) for x in (s.ids, s.vectors, s.order, s.sorted.astype(np.float32))]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *cols], names=["dim", "ids", "vectors", "ord", "sorted"])

        held: dict[int, list] = {}
        for batch in batches:
            col = batch.column(1)
            lengths = col.value_lengths().to_numpy(zero_copy_only=False)
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for dim in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == dim)
                v = col.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(mine), dim)
                held.setdefault(dim, []).append((ids[mine], v))
                if sum(len(p[0]) for p in held[dim]) >= SHARD:
                    yield made(dim, held.pop(dim))
        for dim, parts in held.items():
            yield made(dim, parts)

    return rows.mapInArrow(run, INDEX)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance, double): each query's k nearest other rows."""
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vector_col).withColumn("vec_id", F.col("vec_id").cast("bigint"))
    asked = _usable(queries, id_col, vector_col).groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    shards = index(rows)
    if blocks > 1:
        shards, asked = materialize(shards, "shards"), materialize(asked, "queries")
    found = []
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        by_dim: dict[int, tuple[list, list]] = {}
        for row in part.toArrow().to_pylist():  # about QUERY_BLOCK rows
            of = by_dim.setdefault(len(row["v"]), ([], []))
            of[0].append(row["vec_id"])
            of[1].append(row["v"])
        shared = spark.sparkContext.broadcast({dim: (np.array(i, np.int64), np.array(v, np.float64)) for dim, (i, v) in by_dim.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            reach: dict[int, np.ndarray] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    dim = row["dim"]
                    if dim not in shared.value:
                        continue
                    q_ids, q = shared.value[dim]
                    ids = np.frombuffer(row["ids"], np.int64)
                    arrays = [np.frombuffer(row[c], t).reshape(shape) for c, t, shape in (("vectors", np.float64, (len(ids), dim)), ("ord", np.int32, (-1, len(ids))), ("sorted", np.float32, (-1, len(ids))))]
                    known = reach.setdefault(dim, np.full(len(q_ids), np.inf))
                    out = [(np.full(len(i), q_ids[j]), i, d) for j, i, d in Shard(ids, *arrays).search(q_ids, q, _axes(dim), k, known) if len(i)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=["query_id", "vec_id", "score"])

        hits = shards.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
        found.append(materialize(hits, "neighbours") if blocks > 1 else hits)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
