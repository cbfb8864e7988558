import math

import pytest
from pyspark.sql import types as T

from lanecost.llm import kdsearch

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.LongType()), T.StructField("vector", T.StringType())])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "own") for i, v in rows], SCHEMA)


def brute(rows, asked, k):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
             if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({i: v for i, v in sorted(sound, key=lambda r: r[1], reverse=True) if asked(i)}.items()):
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in sound if i != q and len(w) == len(v))
        out += [(q, k_ + 1, i, -s) for k_, (s, i) in enumerate(scored[:k])]
    return out


def grid(n, d, step=8):
    """Components on a coarse grid, so that there are many ties."""
    return [(i, [((i * (7 + j) + j * j) % step - step / 2) / 16 for j in range(d)]) for i in range(n)]


@pytest.mark.parametrize("shard, block, leaf", [(8192, 2048, 128), (40, 3, 4)])
def test_matches_brute_force(spark, monkeypatch, shard, block, leaf):
    monkeypatch.setattr(kdsearch.Tree.__init__, "__defaults__", (leaf,))
    rows = grid(300, 6) + [(1000 + i, [0.25] * 6) for i in range(120)] + [(2000, [0.1, 0.2]), (2010, [0.3, 0.1]), (2020, [0.5])]
    rows += [(3000, None), (3010, []), (3020, [float("nan")] * 6), (3030, [None] * 6), (3040, [float("inf")] * 6), (None, [0.5] * 6)]
    rows += [(5, rows[5][1])]  # a repeated row
    table = kdsearch.scaled(vectors(spark, rows))
    asked = table.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = sorted(map(tuple, kdsearch.top_k(table, asked, 5, shard, block).collect()))
    assert got == brute(rows, lambda i: i % 10 == 0, 5)


def test_few_candidates_and_empty_tables(spark):
    table = kdsearch.scaled(vectors(spark, [(0, [0.5]), (1, [0.25])]))
    asked = table.where("vec_id = 0").withColumnRenamed("vec_id", "query_id")
    assert [tuple(r) for r in kdsearch.top_k(table, asked).collect()] == [(0, 1, 1, 128 * 64)]
    none = kdsearch.scaled(vectors(spark, []))
    assert kdsearch.top_k(none, none.withColumnRenamed("vec_id", "query_id")).count() == 0


def test_boxes_bound_their_points():
    import numpy as np
    rng = np.random.default_rng(1)
    points = rng.integers(-9, 9, (200, 4)).astype(float)
    tree, queries = kdsearch.Tree(points, np.arange(200), 8), rng.integers(-9, 9, (5, 4)).astype(float)
    bounds = tree.bounds(queries)
    for node, rows in enumerate(tree.rows):
        if rows is not None:
            assert (bounds[:, node] >= (points[rows] @ queries.T).max(axis=0)).all()
