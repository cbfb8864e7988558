"""Connected components of a table of links, by alternating stars.

Every round first links each node's larger neighbours to its least one, then its smaller
neighbours to the least, until the links are stars. Minima are aggregates with map-side
combine, so a node with very many links is no hot task; the joins are ordinary equi-joins.
Each round is written to the shared folder. The number of rounds grows with the logarithm
of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _to_least(links: DataFrame, larger: bool) -> DataFrame:
    """Links of each node to the least of itself and its (larger or smaller) neighbours."""
    if larger:
        both = links.union(links.select("b", "a")).toDF("node", "near")
    else:
        both = links.select(F.greatest("a", "b"), F.least("a", "b")).toDF("node", "near")
    least = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("least"))
    pairs = both.where("near > node") if larger else both
    moved = pairs.join(least, "node").select(F.col("near").alias("a"), F.col("least").alias("b"))
    if not larger:
        moved = moved.union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b, of one orderable type), root the
    least node that is reachable. Links of a node to itself and repeated links don't matter;
    nulls are dropped. An empty table gives no rows.
    """
    links = written(links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        links = written(_to_least(_to_least(links, True), False))
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
