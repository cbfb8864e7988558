"""Ranked lexical search by presence masks.

Documents are indexed in blocks, one per batch of a task: a posting row holds a term's places and
counts in its block. Only terms that an item asks for are kept. A block is searched for a group
of items at a time: bitmap operations give each document its mask of matched terms, documents of
equal mask form a group, and groups are scored in order of their largest possible score, the
sum of their terms' best impacts in the block, until no group left can reach the k-th score.

The search runs twice. A first pass over a share of the blocks gives each item a k-th score,
below which nothing can enter its result. The second pass knows it from the start: terms whose
best impacts together stay below it cannot lift a document into the result by themselves, so
only documents with one of the other terms get a mask at all.

A block is bounded by the batch, a group of items by ``ITEMS``, so neither a frequent term nor a
long list of items makes a large task. Scores are whole numbers of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import wordsplit
from .common import bounded_batches, written

#: Items searched for at a time, and the part of the blocks that the first pass takes.
ITEMS, FIRST = 256, 16
_TERM_BYTES = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_KINDS = wordsplit.separators(bytes(set(range(256)) - set(_TERM_BYTES)))
_INDEX = "block long, term string, df long, places binary, counts binary, ids array<struct<id:{}>>, sizes binary, words long"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: a row per term, and one row with a null term that lists the documents with terms."""
    part = TaskContext.get().partitionId()
    for k, batch in enumerate(batches):
        found = wordsplit.split(batch.column("text"), _KINDS)
        sizes = np.bincount(found.doc, minlength=batch.num_rows)
        some = np.flatnonzero(sizes)
        place = np.zeros(batch.num_rows, np.int32)
        place[some] = np.arange(len(some))
        key, counts = np.unique(found.ids * max(1, len(some)) + place[found.doc], return_counts=True)
        term, at = key // max(1, len(some)), (key % max(1, len(some))).astype(np.int32)
        starts = np.flatnonzero(np.diff(term, prepend=-1) != 0)
        ends = np.append(starts[1:], len(term))[: len(starts)]
        counts = counts.astype(np.int64)
        cut = lambda a: [a[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        n = len(starts)
        ids = batch.column("doc_id").take(pa.array(some))
        terms = found.distinct.take(pa.array(term[starts])).cast(pa.string())
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.StructArray.from_arrays([ids], names=["id"]))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(n + 1, part << 32 | k, np.int64)), pa.concat_arrays([pa.nulls(1, pa.string()), terms]),
            pa.array(np.append(len(some), ends - starts).astype(np.int64)),
            pa.array([None, *cut(at)], pa.binary()), pa.array([None, *cut(counts)], pa.binary()),
            pa.concat_arrays([lists, pa.nulls(n, lists.type)]),
            pa.array([sizes[some].astype(np.int64).tobytes(), *[None] * n], pa.binary()),
            pa.array([int(sizes.sum()), *[None] * n], pa.int64())],
            names=["block", "term", "df", "places", "counts", "ids", "sizes", "words"])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = wordsplit.split(batch.column("text"), _KINDS)
        pairs = np.unique(np.stack([found.doc, found.ids]), axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id").take(pa.array(pairs[0])), found.distinct.take(pa.array(pairs[1])).cast(pa.string())],
            names=["item_id", "term"])


def best_of_block(term_of: list[np.ndarray], impact_of: list[np.ndarray], documents: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, documents scored): the documents of a block that may be among the k best.

    ``term_of[j]`` are the ascending places of the j-th term, ``impact_of[j]`` what it adds there.
    All documents of a score at the k-th are returned too, and none below ``floor``.
    """
    best = np.array([x.max(initial=0) for x in impact_of], np.int64)
    order = np.argsort(best, kind="stable")
    # terms that cannot reach the floor even together do not make a document a candidate
    weak = int(np.searchsorted(np.cumsum(best[order]), max(floor, 1), side="left"))
    present = np.zeros(documents, bool)
    for j in order[weak:]:
        present[term_of[j]] = True
    chosen = np.flatnonzero(present)
    if not len(chosen):
        return chosen, np.zeros(0, np.int64), 0
    row = np.full(documents, -1)
    row[chosen] = np.arange(len(chosen))
    masks = np.zeros((len(chosen), (len(term_of) + 63) // 64), np.uint64)
    for j, places in enumerate(term_of):
        at = row[places]
        masks[at[at >= 0], j >> 6] |= np.uint64(1) << np.uint64(j & 63)
    if masks.shape[1] == 1:
        distinct, group = np.unique(masks[:, 0], return_inverse=True)
        distinct = distinct[:, None]
    else:
        distinct, group = np.unique(masks, axis=0, return_inverse=True)
        group = group.reshape(-1)
    bound = np.zeros(len(distinct), np.int64)
    for j in range(len(term_of)):
        held = (distinct[:, j >> 6] >> np.uint64(j & 63) & np.uint64(1)).astype(bool)
        bound[held] += best[j]
    by_group = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=len(distinct))
    starts = np.cumsum(sizes) - sizes
    turn = np.argsort(-bound, kind="stable")
    score = np.zeros(documents, np.int64)
    done: list[np.ndarray] = []
    kept = np.zeros(0, np.int64)
    limit, scored, at = max(floor, 1), 0, 0
    while at < len(turn) and bound[turn[at]] >= limit:
        # groups are taken in steps that double, so that many small groups cost few steps
        upto, rows, have, wanted = at, [], 0, max(k, scored)
        while upto < len(turn) and bound[turn[upto]] >= limit and have < wanted:
            g = turn[upto]
            rows.append(by_group[starts[g] : starts[g] + sizes[g]])
            have += sizes[g]
            upto += 1
        places = chosen[np.concatenate(rows)]
        here = np.zeros(documents, bool)
        here[places] = True
        for p, x in zip(term_of, impact_of, strict=True):
            use = here[p]
            score[p[use]] += x[use]
        done.append(places)
        scored += len(places)
        kept = np.concatenate([kept, score[places]])
        if len(kept) > k:
            kept = np.partition(kept, len(kept) - k)[len(kept) - k :]
        if len(kept) == k:
            limit = max(limit, int(kept.min()))
        at = upto
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    places = np.concatenate(done)
    use = score[places] >= limit
    return places[use], score[places[use]], scored


def _search(k: int, documents: int, terms: int):
    """Search of one block for one group of items."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out_item, out_doc, out_score, out_work = [], [], [], []
        head = frame[frame["term"].isna()]
        rows = frame[frame["term"].notna()]
        if len(head) and len(rows):
            ids = np.array([x["id"] for x in head["ids"].iloc[0]], dtype=object)
            size = np.frombuffer(head["sizes"].iloc[0], np.int64)
            m = 50 + (50 * size * documents) // terms
            asked: dict[object, tuple[int, list[int]]] = {}
            places, impacts = [], []
            for j, (p, c, w, items) in enumerate(zip(rows["places"], rows["counts"], rows["weight"], rows["items"], strict=True)):
                at, tf = np.frombuffer(p, np.int32), np.frombuffer(c, np.int64)
                places.append(at)
                impacts.append(int(w) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at])))
                for x in items:
                    asked.setdefault(x["item_id"], (x["floor"], []))[1].append(j)
            for item, (floor, own) in asked.items():
                found, score, scored = best_of_block([places[j] for j in own], [impacts[j] for j in own], len(ids), k, floor)
                out_item += [item] * (len(found) + 1)
                out_doc += [*ids[found], None]
                out_score += [*score.tolist(), 0]
                out_work += [0] * len(found) + [scored]
        return pd.DataFrame({"item_id": pd.Series(out_item, dtype=object), "doc_id": pd.Series(out_doc, dtype=object),
                             "score": pd.Series(out_score, dtype="int64"), "scored": pd.Series(out_work, dtype="int64")})
    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(items: DataFrame, docs: DataFrame, k: int = 50, item_id: str = "item_id", item_text: str = "text",
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item with a score above 0.

    Rows of one item id are one item with the terms of all; null item ids are one item as well.
    Null and empty texts have no term: such items get no rows, such documents are never found and not
    counted. Every document row counts, repeated ones too; ties go to the smaller doc_id, null
    last. Empty tables give no rows.
    """
    found = scored(items, docs, k, item_id, item_text, doc_id, text)
    return _ranked(found, k).select("item_id", "rank", "doc_id", "score")


def scored(items: DataFrame, docs: DataFrame, k: int, item_id: str = "item_id", item_text: str = "text",
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """item_id, doc_id, score of what the blocks return, and rows without score that say how many
    documents of a block were ``scored`` for the item."""
    bounded_batches(docs.sparkSession)
    ids = docs.schema[doc_id].dataType.simpleString()
    item_kind = items.schema[item_id].dataType.simpleString()
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).mapInArrow(
        _item_terms, f"item_id {item_kind}, term string").distinct()
    count = asked.select("item_id").distinct().count()
    groups = max(1, -(-count // ITEMS))
    asked = written(asked.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int")))
    wanted = written(asked.select("term").distinct())
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_index, _INDEX.format(ids))
    index = written(raw.join(wanted.withColumn("asked", F.lit(True)), "term", "left").where("asked or term is null").drop("asked"))
    totals = index.where("term is null").agg(F.sum("df").alias("documents"), F.sum("words").alias("words")).first()
    documents, terms = totals["documents"] or 0, totals["words"] or 0
    weights = index.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).select("term", F.floor(
        1000 * F.log((2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("weight"))
    known = written(asked.join(weights, "term"))
    schema = T.StructType([
        T.StructField("item_id", items.schema[item_id].dataType), T.StructField("doc_id", docs.schema[doc_id].dataType),
        T.StructField("score", T.LongType()), T.StructField("scored", T.LongType())])
    run = _search(k, documents, max(1, terms))
    first = F.pmod(F.xxhash64("block"), F.lit(FIRST)) == 0

    def passed(rows: DataFrame, floors: DataFrame | None) -> DataFrame:
        lists = known.withColumn("floor", F.lit(1).cast("long")) if floors is None else known.join(
            floors, F.col("item_id").eqNullSafe(F.col("of")), "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long")))
        lists = lists.groupBy("part", "term", "weight").agg(F.collect_list(F.struct("item_id", "floor")).alias("items"))
        postings = rows.where("term is not null").join(lists, "term").select(
            "block", "part", "term", "places", "counts", "weight", "items", "ids", "sizes")
        empty = F.lit(None).cast(T.ArrayType(lists.schema["items"].dataType.elementType))
        opened = rows.where("term is null").select(
            "block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"),
            "term", "places", "counts", F.lit(None).cast("long").alias("weight"), empty.alias("items"), "ids", "sizes")
        return postings.unionByName(opened).groupBy("block", "part").applyInPandas(run, schema)

    start = written(passed(index.where(first), None))
    kth = _ranked(start, k).where(F.col("rank") == k).select(F.col("item_id").alias("of"), F.col("score").alias("floor"))
    return start.union(passed(index.where(~first), written(kth)))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
a AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
t AS (SELECT k, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
c AS (SELECT k, doc_id, n, term, count(*)::BIGINT AS tf FROM t SEMI JOIN q USING (term) GROUP BY k, doc_id, n, term),
f AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM c, a GROUP BY term, docs),
s AS (SELECT q.item_id, c.k, c.doc_id, sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
    FROM c JOIN f USING (term) JOIN q USING (term), a GROUP BY q.item_id, c.k, c.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""
