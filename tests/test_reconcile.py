"""Multiset comparison by hash buckets against counting rows."""

import random
from collections import Counter

import pytest

from lanecost.operators import reconcile
from lanecost.operators.report import row_multiset_equality

SCHEMA = "a int, b string, c array<int>, d double"


def rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([None, 1, 2]), rng.choice([None, "", "x", f"y{rng.randrange(n)}"]), rng.choice([None, [], [1, None]]),
             rng.choice([None, 0.0, -1.5, float("inf")])) for _ in range(n)]


def compared(spark, left, right):
    r = row_multiset_equality(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).first()
    return r.only_left, r.only_right


@pytest.mark.parametrize("changes", [0, 1, 40, 400])
def test_equals_counting(spark, changes):
    left = rows(1, 500)
    right = left[changes:] + rows(2, changes // 2)
    random.Random(3).shuffle(right)
    key = lambda table: Counter(map(repr, table))
    a, b = key(left), key(right)
    assert compared(spark, left, right) == (sum((a - b).values()), sum((b - a).values()))


def test_nulls_keep_their_place_and_copies_count(spark):
    assert compared(spark, [(None, "x", None, 1.0)], [(1, None, None, 1.0)]) == (1, 1)
    assert compared(spark, [(1, "x", None, 1.0)] * 3, [(1, "x", None, 1.0)]) == (2, 0)
    assert compared(spark, [], []) == (0, 0) and compared(spark, [], rows(4, 7)) == (0, 7)


def test_only_buckets_that_differ_are_compared(spark):
    left = spark.range(20_000).selectExpr("id", "id % 7 as k")
    right = left.where("id <> 77")
    one, other = reconcile._hashed(left), reconcile._hashed(right)
    assert reconcile.differing(one, reconcile._hashed(left.orderBy("k")), 1, None) == []
    first = reconcile.differing(one, other, 1, None)
    second = reconcile.differing(one, other, 2, first)
    assert len(first) == len(second) == 1
    assert [tuple(r) for r in reconcile.surplus(left, right).collect()] == [(77, 0, 1)]
