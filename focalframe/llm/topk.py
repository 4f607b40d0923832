"""Exact top-k search by inner product with a KD-tree for each shard of the vectors.

Trees split at medians of the widest dimension and keep tight bounding boxes. A query walks a tree best-first: the largest inner
product that any point of a box could have bounds the box, and a box below the query's kth score is left out. Each query
first searches its home shard; the kth score found there travels with it to the other shards and goes up from box to box.
Queries go against the shards in blocks, so a task holds one shard and one block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors in a shard, queries in a block, vectors in a leaf.
SHARD = 8192
QUERIES = 32768
LEAF = 256


class KDTree:
    """Leaves as slices of one reordered matrix; for every node its box and, unless it is a leaf, its two children."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(ids))
        self.low, self.high, self.kids, self.slices = [], [], [], []
        self._build(points, 0, len(ids), leaf)
        self.ids, self.points = ids[self.order], points[self.order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, points: np.ndarray, start: int, end: int, leaf: int) -> int:
        here = points[self.order[start:end]]
        low, high = here.min(0), here.max(0)
        node = len(self.kids)
        self.low.append(low)
        self.high.append(high)
        self.slices.append((start, end))
        self.kids.append(None)
        widest = int(np.argmax(high - low)) if points.shape[1] else 0
        if end - start > leaf and points.shape[1] and high[widest] > low[widest]:
            half = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(here[:, widest], half)]
            self.kids[node] = (self._build(points, start, start + half, leaf), self._build(points, start + half, end, leaf))
        return node

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: list) -> Iterator[list[tuple]]:
        """For each query its best (score, -id) in the tree, at most ``k``, leaving out ids equal to ``own`` and scores under ``floor``."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        bounds = up @ self.high.T + down @ self.low.T
        for q, mine, kth, bound in zip(queries, own.tolist(), floor, bounds):
            best: list[tuple] = []
            todo = [(-bound[0], 0)]
            while todo:
                reach, node = heapq.heappop(todo)
                if kth is not None and -reach < kth:
                    break
                if self.kids[node] is not None:
                    for child in self.kids[node]:
                        if kth is None or bound[child] >= kth:
                            heapq.heappush(todo, (-bound[child], child))
                    continue
                start, end = self.slices[node]
                scores = self.points[start:end] @ q
                for i in (np.flatnonzero(scores >= kth) if kth is not None else range(end - start)):
                    item = (scores[i], -int(self.ids[start + i]))
                    if -item[1] == mine:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k:
                    kth = best[0][0] if kth is None else max(kth, best[0][0])
            yield best


def matrix(column: pa.Array, dims: int, exact_float: bool) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = flat.astype(np.float64) if exact_float else np.array(flat.tolist(), dtype=object)
    return out.reshape(len(column), dims)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _searched(k: int):
    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        dims = key[-1].as_py()
        if not vectors.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        vectors, queries = vectors.combine_chunks(), queries.combine_chunks()
        v, q = vectors["v"].combine_chunks(), queries["q"].combine_chunks()
        most = lambda c: max((abs(int(x)) for x in (c.flatten().to_numpy().min(initial=0), c.flatten().to_numpy().max(initial=0))))
        small = dims * most(v) * most(q) < 1 << 53
        tree = KDTree(vectors["vec_id"].to_numpy(), matrix(v, dims, small))
        own = queries["query_id"].to_numpy()
        rows = [(i, -minus, int(score)) for i, best in zip(own.tolist(), tree.search(matrix(q, dims, small), own, k, queries["kth"].to_pylist())) for score, minus in best]
        columns = list(zip(*rows)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_FOUND)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``vectors(vec_id, v)`` and ``queries(query_id, q)`` with arrays of longs.

    The ``k`` largest inner products with vectors of another id, ties to the smaller id; fewer, if there are fewer. Only vectors of
    the query's own dimension are candidates. Rows with a null id or array take no part. Vectors of one id are all
    candidates; a repeated query row counts once. Scores must fit 64 bits. Empty tables give no rows.
    """
    vectors = vectors.where("vec_id is not null and v is not null").withColumn("dims", F.size("v"))
    queries = queries.where("query_id is not null and q is not null").dropDuplicates(["query_id", "q"]).withColumn("dims", F.size("q"))
    vectors, queries = written(vectors, "vectors"), written(queries, "queries")
    shards, blocks = max(1, -(-vectors.count() // SHARD)), max(1, -(-queries.count() // QUERIES))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    home = F.pmod(F.xxhash64("query_id"), F.lit(shards)).cast("int")
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    by = ["shard", "block", "dims"]
    held = vectors.withColumn("shard", shard).withColumn("block", each_block).groupBy(*by)
    asked = queries.withColumn("block", block).withColumn("home", home)

    def search(rows: DataFrame) -> DataFrame:
        return held.cogroup(rows.select("query_id", "q", "kth", *by).groupBy(*by)).applyInArrow(_searched(k), "query_id long, vec_id long, score long")

    near = written(search(asked.withColumn("shard", F.col("home")).withColumn("kth", F.lit(None).cast("long"))), "near")
    kth = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).select("query_id", "kth")
    away = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home").join(kth, "query_id", "left")
    found = near.unionByName(search(away)) if shards > 1 else near
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(table: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) with each component x turned into floor(scale * x); vectors that are null or hold null or non-finite components are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.where(F.col(vector_col).isNotNull()).where(~bad)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))
