"""Exact top-k search by inner product over kd-trees, one per shard.

Vectors are dealt to shards of bounded size by the hash of their id, queries to blocks. A
task holds one shard and one block: it splits the shard at medians of its widest dimension
into a tree with tight bounding boxes and goes through the tree best first for each query,
by the largest product a box allows, until no box can reach the k-th best score. The k-th
score is propagated: every query first searches one shard, and enters the other shards with the
k-th score found there. Each task hands on at most k rows per query.

Work in the worst case is every shard for every query block, in bounded memory; the boxes
and the propagated score cut what is visited inside.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import written

#: Vectors of a shard, queries of a block, vectors of a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF = 8192, 2048, 128
_RESULT = "query_id long, vec_id long, score long"


class Tree:
    """Median splits of points (n, d) with ids (ascending), kept as arrays of nodes."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.points, self.ids = points, ids
        self.low, self.high, self.least, self.kids, self.rows = [], [], [], [], []
        self._grow(np.arange(len(ids)), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        node, own = len(self.kids), self.points[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.least.append(int(self.ids[rows].min()))
        self.kids.append(None)
        self.rows.append(None)
        axis = int(np.argmax(high - low))
        if len(rows) <= leaf or high[axis] == low[axis]:  # equal points are one leaf
            self.rows[node] = np.sort(rows)
            return node
        middle = len(rows) // 2
        order = rows[np.argpartition(own[:, axis], middle)]
        self.kids[node] = (self._grow(order[:middle], leaf), self._grow(order[middle:], leaf))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): the largest inner product with a point of each box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def best(self, query: np.ndarray, own_id: int, bound: np.ndarray, k: int, score: float, tie: int) -> list[tuple[float, int]]:
        """The k best (score, id) of the tree that can come before the k-th so far, (score, tie)."""
        found: list[tuple[float, int]] = []  # heap of (score, -id), the worst on top
        waiting = [(-bound[0], self.least[0], 0)]
        while waiting:
            most, least, node = heapq.heappop(waiting)
            if (-most, -least) < (score, -tie):
                if -most < score:
                    break
                continue  # equal score at best, but only larger ids
            if self.kids[node] is not None:
                for kid in self.kids[node]:
                    if bound[kid] >= score:
                        heapq.heappush(waiting, (-bound[kid], self.least[kid], kid))
                continue
            rows = self.rows[node]
            scores = self.points[rows] @ query
            for j in np.flatnonzero(scores >= score):
                entry = (float(scores[j]), -int(self.ids[rows[j]]))
                if entry[1] == -own_id:
                    continue
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
                else:
                    continue
                if len(found) == k and found[0] > (score, -tie):
                    score, tie = found[0][0], -found[0][1]
        return [(s, -i) for s, i in found]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), np.float64)


def _search(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(vectors) and len(queries):
            vectors = vectors.sort_values("vec_id")
            tree = Tree(_matrix(vectors["vector"]), vectors["vec_id"].to_numpy())
            points, own = _matrix(queries["vector"]), queries["query_id"].to_list()
            score, tie = queries["kth"].to_list(), queries["kth_id"].to_list()
            for at in range(0, len(points), 256):
                bounds = tree.bounds(points[at : at + 256])
                for j, bound in enumerate(bounds):
                    for s, i in tree.best(points[at + j], own[at + j], bound, k, score[at + j], tie[at + j]):
                        out.append((own[at + j], i, int(s)))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")
    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products of each query.

    ``vectors`` has vec_id and vector (array of whole-numbered doubles, products below 2**53),
    ``queries`` query_id and vector; of a repeated query id the
    least vector is asked, repeated vectors are candidates each. A vector with the query's own id takes no part, nor
    do vectors of another length than the query's. Rows with a null id, vector or component or a
    component that isn't finite are left out. Ties go to the smaller vec_id. Fewer than k
    candidates give fewer rows, empty tables none.
    """
    held = written(_sound(vectors, "vec_id"))
    asked = written(_sound(queries, "query_id").groupBy("query_id").agg(F.min("vector").alias("vector")).withColumn(
        "d", F.size("vector")))
    shape = held.groupBy("d").agg(F.count(F.lit(1)).alias("rows")).join(
        asked.groupBy("d").agg(F.count(F.lit(1)).alias("asked")), "d")
    shape = written(shape.select("d", F.ceil(F.col("rows") / shard_rows).cast("int").alias("shards"),
                                 F.ceil(F.col("asked") / block_rows).cast("int").alias("blocks")))
    held = held.join(shape, "d").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.join(shape, "d").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn(
        "first", F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("shards")).cast("int"))
    vectors_of = held.select("d", "block", "shard", "vec_id", "vector").groupBy("d", "block", "shard")
    columns = ("d", "block", "shard", "query_id", "vector", "kth", "kth_id")
    largest = F.lit((1 << 63) - 1)

    start = asked.select("d", "block", F.col("first").alias("shard"), "query_id", "vector",
                         F.lit(float("-inf")).alias("kth"), largest.alias("kth_id"))
    one = written(vectors_of.cogroup(start.select(*columns).groupBy("d", "block", "shard")).applyInPandas(_search(k), _RESULT))
    kth = _ranked(one, k).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"), F.col("vec_id").alias("kth_id"))
    rest = asked.join(kth, "query_id", "left").withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where(F.col("shard") != F.col("first"))
    rest = rest.withColumns({"kth": F.coalesce("kth", F.lit(float("-inf"))), "kth_id": F.coalesce("kth_id", largest)})
    more = vectors_of.cogroup(rest.select(*columns).groupBy("d", "block", "shard")).applyInPandas(_search(k), _RESULT)
    return _ranked(one.unionByName(more), k).select("query_id", "rank", "vec_id", "score")


def _sound(rows: DataFrame, key: str) -> DataFrame:
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(key).isNotNull() & F.col("vector").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        key, "vector", F.size("vector").alias("d")).where("d > 0")


def scaled(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and vector, each component x as floor(scale * x)."""
    whole = F.transform("embedding", lambda x: F.when(
        x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.floor(x.cast("double") * scale).cast("double")))
    return embeddings.select("vec_id", whole.alias("vector"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
