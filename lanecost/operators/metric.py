"""Exact nearest vectors by angle over a cover of balls.

Pivots are a bounded sample of the vectors. Each vector belongs to the ball of its nearest pivot;
a ball that is larger than a block is cut into rings by the angle to its pivot. By the triangle
inequality of angles a vector of a ring with angles from ``low`` to ``high`` is at least
``max(0, a - high, low - a)`` away from a query at angle ``a`` of the pivot. Every query first looks
into the cells (rings of balls) nearest to it until it has seen k vectors, and then only into
those whose bound reaches its k-th score. Only cells that are visited become rows.

Queries meet cells in units: cells are put together, in order, to units of about ``SPAN`` blocks of vectors.
A query is sent once to each unit that holds a cell it visits, with a mark for each of these cells, so
what is shuffled grows with the units and not with the cells. A unit that a single large cell makes too
large is dealt over parts, and the queries of a unit over blocks, so a task holds two bounded sides whatever
the data; it multiplies tiles of ``block_rows`` and keeps what reaches the floor. Where vectors have no
structure all cells are visited, which then is the product of all blocks.
Pivots are at most ``PIVOTS`` vectors and go to every task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import cut_lineage

PIVOTS = 256
#: Blocks of vectors in a unit, and about how many tasks the queries of a unit are dealt over.
SPAN, SHARES = 16, 32
SLACK = 1e-7  # of an angle; arccos loses half the digits near 0


def pivots(vectors: DataFrame, block_rows: int, most: int = PIVOTS) -> np.ndarray:
    """A matrix of about one pivot per quarter of a block, at most ``most``; the draw is by hash of the id."""
    count = vectors.count()
    wanted = int(min(most, max(1, 4 * count // block_rows)))
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vector").collect() if count else []
    return np.array([r["vector"] for r in rows], dtype="float64")


def _angles(centres: np.ndarray):
    """Angles of a batch of vectors to all pivots. Nested, so that tasks need numpy and pandas only."""
    def run(column: pd.Series) -> np.ndarray:
        return np.arccos(np.clip(np.vstack(column.to_numpy()).astype("float64") @ centres.T, -1.0, 1.0))
    return run


def cover(vectors: DataFrame, centres: np.ndarray, block_rows: int) -> DataFrame:
    """Written (id, vector, ball, angle, ring)."""
    angles = _angles(centres)

    def assign(batches):
        for frame in batches:
            if len(frame):
                found = angles(frame["vector"])
                ball = found.argmin(axis=1)
                yield frame.assign(ball=ball.astype("int32"), angle=found[np.arange(len(found)), ball])

    schema = T.StructType([*vectors.select("id", "vector").schema.fields, T.StructField("ball", T.IntegerType()),
                           T.StructField("angle", T.DoubleType())])
    members = cut_lineage(vectors.select("id", "vector").mapInPandas(assign, schema))
    sizes = members.groupBy("ball").agg(F.max("angle").alias("_wide"), F.ceil(F.count(F.lit(1)) / block_rows).alias("_rings"))
    at = F.floor(F.col("angle") / F.greatest(F.col("_wide"), F.lit(1e-12)) * F.col("_rings"))
    return cut_lineage(members.join(sizes, "ball").withColumn(
        "ring", F.least(at, F.col("_rings") - 1).cast("int")).select("id", "vector", "ball", "angle", "ring"))


def cells_of(covered: DataFrame, block_rows: int) -> DataFrame:
    """(ball, ring, low, high, many, unit, place, parts): as many rows as pivots and blocks. ``place`` is the
    place of a cell in its unit, ``parts`` is how many tasks the vectors of its unit are dealt over."""
    sizes = cut_lineage(covered.groupBy("ball", "ring").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("many")))
    order = Window.orderBy("ball", "ring")
    ahead = F.coalesce(F.sum("many").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    unit = Window.partitionBy("unit")
    return cut_lineage(sizes.withColumn("unit", F.floor(ahead / (SPAN * block_rows)).cast("int")).withColumns({
        "place": F.row_number().over(unit.orderBy("ball", "ring")) - 1,
        "parts": F.ceil(F.sum("many").over(unit) / (SPAN * block_rows)).cast("int")}))


def visits(queries: DataFrame, centres: np.ndarray, cells: DataFrame, k: int, digits: int) -> DataFrame:
    """(query_id, unit, marks, many): the units each query visits, a bit for each cell of the unit that is visited and
    their number. ``queries`` has id, vector and floor: without a floor the nearest cells with k vectors; with one, the
    other cells whose nearest possible vector reaches it."""
    rows = cells.orderBy("unit", "place").collect()
    ball, unit, low, high, many = (np.array([r[c] for r in rows]) for c in ("ball", "unit", "low", "high", "many"))
    starts = np.flatnonzero(np.diff(unit, prepend=-1)) if len(unit) else np.zeros(0, int)
    angles, slack, spare = _angles(centres), SLACK, 10.0 ** -digits

    def choose(batches):
        for frame in batches:
            if not len(frame) or not len(ball):
                continue
            away = angles(frame["vector"])[:, ball]
            least = np.maximum(0.0, np.maximum(away - high, low - away))
            order = np.lexsort((np.broadcast_to(np.arange(len(ball)), away.shape), away, least), axis=1)
            ahead = np.cumsum(many[order], axis=1) - many[order]
            first = np.zeros(away.shape, bool)
            np.put_along_axis(first, order, ahead < k, axis=1)
            floor, begun = frame["floor"].to_numpy(dtype="float64"), frame["begun"].to_numpy()
            reaches = np.isnan(floor)[:, None] | (np.cos(np.maximum(0.0, least - slack)) >= floor[:, None] - spare)
            chosen = np.where(begun[:, None], reaches & ~first, first)
            for at, end in zip(starts, [*starts[1:], len(unit)]):
                here = chosen[:, at:end]
                some = np.flatnonzero(here.any(axis=1))
                if len(some):
                    yield pd.DataFrame({"query_id": frame["id"].to_numpy()[some], "unit": np.full(len(some), unit[at], "int32"),
                                        "marks": [row.tobytes() for row in np.packbits(here[some], axis=1)],
                                        "many": here[some].sum(axis=1, dtype="int64")})

    schema = T.StructType([T.StructField("query_id", queries.schema["id"].dataType), T.StructField("unit", T.IntegerType()),
                           T.StructField("marks", T.BinaryType()), T.StructField("many", T.LongType())])
    return cut_lineage(queries.select("id", "vector", "floor", "begun").mapInPandas(choose, schema))


def _product(k: int, digits: int, block_rows: int):
    def tile(scores, floor):
        """Rows, columns and rounded scores of at least the k best of each row that reach its floor; ties to the lower column."""
        least = floor
        if scores.shape[1] > k:
            open_ = np.flatnonzero(np.isneginf(floor))
            if len(open_):
                least = floor.copy()
                least[open_] = np.partition(scores[open_], scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, column = np.nonzero(scores >= (least - 2 * 10.0 ** -digits)[:, None])
        return row, column, np.round(scores[row, column], digits) + 0.0

    def best(row, column, score):
        order = np.lexsort((column, -score, row))
        row, column, score = row[order], column[order], score[order]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
        return row[place < k], column[place < k], score[place < k]

    def run(members: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if members.empty or asked.empty:
            return pd.DataFrame()
        members = members.sort_values("id", kind="stable").reset_index(drop=True)
        matrix = lambda frame: np.vstack(frame["vector"].to_numpy()).astype("float64")
        docs, queries, place = matrix(members), matrix(asked), members["place"].to_numpy()
        floor = asked["floor"].to_numpy(dtype="float64")
        floor = np.where(np.isnan(floor), -np.inf, floor)
        marks = np.unpackbits(np.frombuffer(b"".join(asked["marks"]), np.uint8).reshape(len(asked), -1), axis=1).astype(bool)
        order = np.argsort(place, kind="stable")  # in id order within a cell
        bounds = np.searchsorted(place[order], np.arange(marks.shape[1] + 1))
        kept = [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
        for low in range(0, len(asked), block_rows):
            parts = []
            for cell in np.flatnonzero(np.diff(bounds)):
                who = low + np.flatnonzero(marks[low:low + block_rows, cell])
                for at in range(bounds[cell], bounds[cell + 1], block_rows) if len(who) else ():
                    rows = order[at:min(at + block_rows, bounds[cell + 1])]
                    row, column, score = best(*tile(queries[who] @ docs[rows].T, floor[who]))
                    parts.append((who[row], rows[column], score))
            if parts:
                kept = [np.concatenate(x) for x in zip(kept, best(*map(np.concatenate, zip(*parts))))]
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[kept[0]], "doc_id": members["id"].to_numpy()[kept[1]], "score": kept[2]})
    return run


def _visited(chosen: DataFrame, queries: DataFrame, covered: DataFrame, cells: DataFrame, k: int, digits: int, block_rows: int) -> DataFrame:
    """The k best of the cells each query visits (chosen: see ``visits``; queries: id, vector, floor)."""
    share = F.least(F.lit(SPAN * block_rows), F.greatest(F.lit(block_rows), F.ceil(F.count(F.lit(1)) / SHARES)))
    asked = cut_lineage(chosen.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("blocks")))
    dealt = lambda by, n: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shape = cells.select("unit", "ball", "ring", "place", "parts").join(asked, "unit")
    left = covered.join(shape, ["ball", "ring"]).withColumn("part", dealt("id", "parts")).withColumn("block", every("blocks"))
    right = chosen.join(shape.select("unit", "parts", "blocks").distinct(), "unit").withColumn("block", dealt("query_id", "blocks"))
    right = right.join(queries.select(F.col("id").alias("query_id"), "vector", "floor"), "query_id").withColumn("part", every("parts"))
    schema = T.StructType([T.StructField("query_id", queries.schema["id"].dataType), T.StructField("doc_id", covered.schema["id"].dataType),
                           T.StructField("score", T.DoubleType())])
    key = ("unit", "part", "block")
    return left.select(*key, "id", "place", "vector").groupBy(*key).cogroup(
        right.select(*key, "query_id", "marks", "floor", "vector").groupBy(*key)).applyInPandas(_product(k, digits, block_rows), schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, docs: DataFrame, k: int, digits: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(hits, work): hits are query_id, doc_id, score, rank of unit vectors (id, vector) by cosine, then
    id; work is one row, cells of all queries and cells visited.

    Scores are compared as rounded to ``digits``. Equal and repeated vectors are all found. Ids are
    not null and unique on each side. An empty side gives no rows.
    """
    queries, docs = cut_lineage(queries), cut_lineage(docs)
    centres = pivots(docs, block_rows)
    covered = cover(docs, centres, block_rows) if len(centres) else docs.select(
        "id", "vector", F.lit(0).alias("ball"), F.lit(0.0).alias("angle"), F.lit(0).alias("ring"))
    cells = cells_of(covered, block_rows)
    fresh = queries.withColumns({"floor": F.lit(None).cast("double"), "begun": F.lit(False)})
    start = visits(fresh, centres, cells, k, digits)
    first = cut_lineage(_ranked(_visited(start, fresh, covered, cells, k, digits, block_rows), k))
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    begun = queries.join(kth, "id", "left").withColumn("begun", F.lit(True))
    rest = visits(begun, centres, cells, k, digits)
    # written: the product is not made again for each use of the hits
    hits = cut_lineage(_ranked(first.drop("rank").unionByName(_visited(rest, begun, covered, cells, k, digits, block_rows)), k))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    seen = start.union(rest).agg(F.coalesce(F.sum("many"), F.lit(0)).alias("cells_visited"))
    work = count(queries, "queries").join(count(cells, "cells")).join(seen).select(
        (F.col("queries") * F.col("cells")).alias("cells"), "cells_visited")
    return hits, work
