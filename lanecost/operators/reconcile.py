"""Comparing two tables by a tree of multiset hashes.

Every row has 128 hash bits. In one pass without a shuffle of rows each side gives, per bucket of the
hash, its number of rows and the sums of the hash halves, which do not depend on order. Buckets
that agree hold the same rows; those that differ are divided again by further bits, and only
the rows of what still differs at the end are shuffled and compared as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Hash bits per level of the tree, and levels; a level hands at most 2 ** BITS numbers per bucket above to the driver.
BITS, LEVELS, OPEN = 10, 2, 1 << 12


def _hashed(df: DataFrame) -> DataFrame:
    """``df`` with two hashes of the whole row. Nulls are flagged, since the hash functions pass over them."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    return df.withColumns({"_h1": F.xxhash64(nulls, *columns), "_h2": F.xxhash64(F.lit("row"), *reversed(columns), nulls)})


def _place(levels: int) -> Column:
    return F.col("_h1").bitwiseAND((1 << (BITS * levels)) - 1)


def differing(left: DataFrame, right: DataFrame, levels: int, among: list[int] | None) -> list[int]:
    """Buckets of ``levels`` levels in which the two hashed tables differ, looked for below the buckets
    ``among`` of the level above."""
    def sums(df: DataFrame, sign: int) -> DataFrame:
        rows = df if among is None else df.where(_place(levels - 1).isin(among))
        add = lambda c: F.sum(F.col(c).cast("decimal(38,0)") * sign).alias(c)
        return rows.groupBy(_place(levels).alias("bucket")).agg(F.sum(F.lit(sign)).alias("rows"), add("_h1"), add("_h2"))

    both = sums(left, 1).unionByName(sums(right, -1)).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("rows", "_h1", "_h2")])
    return [r.bucket for r in both.where("rows <> 0 OR _h1 <> 0 OR _h2 <> 0").select("bucket").collect()]


def surplus(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of ``left``'s columns that one side holds more often, with ``_n``: above 0 for the left side.
    Tables that hold the same rows cost no shuffle of rows."""
    right = right.select(*[F.col(f"`{c}`") for c in left.columns])
    one, other, among = _hashed(left), _hashed(right), None
    for level in range(1, LEVELS + 1):
        found = differing(one, other, level, among)
        among, reached = found, level
        if not found or len(found) > OPEN >> BITS:
            break  # equal, or so different that finer buckets would all differ
    rows = lambda df, side: df.where(_place(reached).isin(among) if among else F.lit(False)).withColumn("_side", F.lit(side))
    both = rows(one, 1).unionByName(rows(other, -1)).drop("_h1", "_h2")
    return both.groupBy(*[F.col(f"`{c}`") for c in left.columns]).agg(F.sum("_side").alias("_n")).where("_n <> 0")
