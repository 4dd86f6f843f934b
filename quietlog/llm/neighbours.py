"""Nearest neighbours by a block matrix join with quantised tiles.

Queries are a stated set; every other row is a candidate. Tiles of candidates and of queries are rounded to int8 with
one scale per vector. The product of two tiles gives distances of the rounded vectors, and with the known lengths of
the rounding errors a lower and an upper bound of each true distance. A pair survives if its lower bound is within the
k-th best upper bound or exact distance that the task knows for the query; only survivors are recomputed, in double
precision, and kept in a bounded heap per query. The tasks' heaps are merged by query. Nothing is lost: bounds are exact.

Queries are taken in blocks of at most `QUERY_BLOCK`, one broadcast each; the block bounds what is broadcast, and their
number grows with the queries. Of candidates in a tile with equal vectors only the k + 1 smallest ids can matter.

Vectors that are null, zero, or hold null or non-finite components take no part, as query or candidate; neither do
candidates of another length than the query. Of rows that share a vec_id, one (the smallest vector) counts. A null
vec_id takes no part. Fewer than k candidates are all returned; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 16_384
#: candidates in a tile, queries in a tile
TILE, QUERY_TILE = 4096, 512

FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and vec (array<double>) of the rows that take part, one a vec_id."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(finite & F.exists("vec", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def quantised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scale and length of the rounding error of each row."""
    scale = np.abs(m).max(1) / 127
    q = np.rint(m / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((m - q * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9)


class Side:
    """Vectors of one length with their tiles."""

    def __init__(self, ids: np.ndarray, m: np.ndarray) -> None:
        self.ids, self.m = ids, m
        self.q, self.scale, self.error = quantised(m)
        # products of int8 rows are whole numbers below 2^24 for up to 1040 components, so float32 holds them exactly
        self.wide = self.q.astype(np.float32 if m.shape[1] <= 1040 else np.float64)
        self.square = (self.wide.astype(np.float64) ** 2).sum(1) * self.scale**2


def by_length(ids: list[int], vectors: list[list[float]]) -> dict[int, Side]:
    out = {}
    length = np.array([len(v) for v in vectors], int)
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        out[n] = Side(np.array([ids[i] for i in at], np.int64), np.array([vectors[i] for i in at], np.float64))
    return out


def thinned(ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Without candidates that have k + 1 others of equal vector and smaller id."""
    _, group = np.unique(np.ascontiguousarray(m).view(f"V{m.shape[1] * 8}").ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    g = group[order]
    start = np.maximum.accumulate(np.where(np.append(True, g[1:] != g[:-1]), np.arange(len(g)), 0))
    keep = order[np.arange(len(g)) - start <= k]
    return ids[keep], m[keep]


class Heaps:
    """For each query of a block the best so far: (-distance, -vec_id), the worst on top."""

    def __init__(self, queries: Side, k: int) -> None:
        self.queries, self.k = queries, k
        self.heap: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        self.limit = np.full(len(queries.ids), np.inf)

    def offer(self, c: Side) -> None:
        q = self.queries
        for at in range(0, len(q.ids), QUERY_TILE):
            part = slice(at, at + QUERY_TILE)
            dot = (q.wide[part] @ c.wide.T).astype(np.float64) * q.scale[part, None] * c.scale
            near = np.sqrt(np.maximum(q.square[part, None] + c.square - 2 * dot, 0))
            slack = q.error[part, None] + c.error + 1e-6 * (np.sqrt(q.square[part, None]) + np.sqrt(c.square))
            own = q.ids[part, None] == c.ids
            high = np.where(own, np.inf, near + slack)
            kth = np.partition(high, self.k - 1, axis=1)[:, self.k - 1] if high.shape[1] >= self.k else np.full(len(high), np.inf)
            limit = np.minimum(kth, self.limit[part])
            row, col = np.nonzero((near - slack <= limit[:, None]) & ~own)
            exact = np.empty(len(row))
            for i in range(0, len(row), 1 << 15):
                s = slice(i, i + (1 << 15))
                exact[s] = np.sqrt(np.add.accumulate((q.m[row[s] + at] - c.m[col[s]]) ** 2, axis=1)[:, -1])
            for r, d, v in zip((row + at).tolist(), exact.tolist(), c.ids[col].tolist(), strict=True):
                heap = self.heap[r]
                if len(heap) < self.k:
                    heapq.heappush(heap, (-d, -v))
                elif (-d, -v) > heap[0]:
                    heapq.heapreplace(heap, (-d, -v))
            for r in np.unique(row) + at:
                if len(self.heap[r]) == self.k:
                    self.limit[r] = -self.heap[r][0][0]


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and Euclidean distance of the k nearest of each query; is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    queries = rows.where(is_query)
    blocks = max(1, math.ceil(queries.count() / (QUERY_BLOCK / 2)))  # hashed blocks are uneven
    found = [_block(spark, rows, queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(spark, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    got = queries.collect()
    shared = spark.sparkContext.broadcast(by_length([r.vec_id for r in got], [r.vec for r in got]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {n: Heaps(side, k) for n, side in shared.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                ids, vec = part.column("vec_id").to_numpy(), part.column("vec")
                length = np.diff(vec.offsets.to_numpy())
                flat, start = vec.values.to_numpy(), vec.offsets.to_numpy()[:-1]
                for n, heap in heaps.items():
                    some = np.flatnonzero(length == n)
                    if len(some):
                        m = flat[start[some][:, None] + np.arange(n)]
                        heap.offer(Side(*thinned(ids[some], m, k)))
        for heap in heaps.values():
            out = [(q, -v, -d) for q, h in zip(heap.queries.ids.tolist(), heap.heap, strict=True) for d, v in h]
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, FOUND)
