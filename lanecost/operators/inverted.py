"""Exact top-k over an impact-ordered inverted index.

The index is a written table of posting blocks: a term, a band of its weights (each band holds
weights within a factor of two to the power of 1/4), some documents with their weights. A query
reads the bands of its terms in falling order of what they can add to a score:

1. Its strongest bands, some multiple of k postings, give documents with partial scores. The k-th
   of them is below the k-th final score, so it is a floor for the result.
2. Bands are dropped from the weak end while all that was dropped cannot reach the floor together.
   Only documents of the other bands can be in the result; those whose partial score plus the
   dropped rest stays below the floor are left out, the few that remain are scored in full.

A band of a frequent term is dealt over blocks of about ``BLOCK`` postings, so neither building
nor reading the index meets a hot term in one task. What is read is reported by ``work``.

Where queries and documents share so many terms that their postings are more than ``SPELLED`` rows, rows
of (query, document, term) would be what fills the disks. Then the index is cut by documents instead of
by terms: a task holds the postings of one block of documents and one of queries, adds up all their scores
in memory, and hands on the k best of each query. Scores are the same sums in the same order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.expressions import with_scalars
from ..session import cut_lineage

#: Postings of a block, postings read in the first pass per wanted document, bands per halving.
BLOCK, FIRST_READ, BANDS = 4096, 16, 4
#: Matches of a query's and a document's term that are made rows at most, and that a task holds at a time.
SPELLED, HELD = 1_000_000, 2_000_000
SLACK = 1e-9  # what a sum of doubles may be off


def exploded(packed: DataFrame, name: str, weight: str) -> DataFrame:
    """(name, term, weight) of packed rows (id, terms, weights)."""
    return packed.select(F.col("id").alias(name), F.explode(F.arrays_zip("terms", "weights")).alias("v")).select(
        name, F.col("v.terms").alias("term"), F.col("v.weights").alias(weight))


def build(docs: DataFrame) -> DataFrame:
    """Posting blocks (term, band, top, many, postings) of packed documents."""
    rows = exploded(docs, "doc_id", "w").where("w > 0").withColumn("band", F.floor(-F.log2("w") * BANDS).cast("int"))
    size = rows.groupBy("term", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    return cut_lineage(rows.join(size, ["term", "band"]).groupBy("term", "band", part.alias("part")).agg(
        F.max("w").alias("top"), F.count(F.lit(1)).alias("many"), F.collect_list(F.struct("doc_id", "w")).alias("postings")).drop("part"))


def asked_bands(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, term, band, qw, value, many): the bands of each query's terms; ``value`` is the most
    a posting of the band adds to the score."""
    bands = index.groupBy("term", "band").agg(F.max("top").alias("top"), F.sum("many").alias("many"))
    return cut_lineage(queries.join(bands, "term").select(
        "query_id", "term", "band", "qw", (F.col("qw") * F.col("top")).alias("value"), "many"))


def _partial(bands: DataFrame, index: DataFrame, *carry: str) -> DataFrame:
    """(query_id, term, doc_id, add, carry) of all postings of the given bands."""
    return bands.select("query_id", "term", "band", "qw", *carry).join(
        index.select("term", "band", "postings"), ["term", "band"]).select(
        "query_id", "term", "qw", *carry, F.explode("postings").alias("p")).select(
        "query_id", "term", F.col("p.doc_id").alias("doc_id"), (F.col("qw") * F.col("p.w")).alias("add"), *carry)


def floors(bands: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): a score that k documents of the query reach; none where fewer were read."""
    order = Window.partitionBy("query_id").orderBy(F.desc("value"), "term", "band").rowsBetween(Window.unboundedPreceding, -1)
    strong = bands.withColumn("ahead", F.coalesce(F.sum("many").over(order), F.lit(0))).where(F.col("ahead") < FIRST_READ * k)
    sums = _partial(strong, index).groupBy("query_id", "doc_id").agg(F.sum("add").alias("low"))
    best = Window.partitionBy("query_id").orderBy(F.desc("low"))
    return sums.withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("query_id", F.col("low").alias("floor"))


def kept_bands(bands: DataFrame, floor: DataFrame) -> DataFrame:
    """``bands`` that are read in the second pass, with the floor, ``spare`` (what the term's dropped
    bands can add) and ``rest`` (the sum of it over all terms of the query)."""
    by_term = Window.partitionBy("query_id", "term").orderBy("value", F.desc("band"))
    by_value = Window.partitionBy("query_id").orderBy("value", "term", F.desc("band")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    step = F.col("value") - F.coalesce(F.lag("value").over(by_term), F.lit(0.0))
    rows = bands.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).withColumn("step", step)
    rows = rows.withColumn("reach", F.sum("step").over(by_value)).withColumn("dropped", F.col("reach") < F.col("floor") - SLACK)
    every, whole = Window.partitionBy("query_id", "term"), Window.partitionBy("query_id")
    spare = F.coalesce(F.max(F.when(F.col("dropped"), F.col("value"))).over(every), F.lit(0.0))
    rest = F.coalesce(F.max(F.when(F.col("dropped"), F.col("reach"))).over(whole), F.lit(0.0))
    return rows.withColumns({"spare": spare, "rest": rest}).where(~F.col("dropped")).drop("step", "reach", "dropped")


def work(bands: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: postings of all terms of all queries, and postings that the second pass reads."""
    return with_scalars(bands.agg(F.coalesce(F.sum("many"), F.lit(0)).alias("postings")),
                        kept.agg(F.coalesce(F.sum("many"), F.lit(0)).alias("postings_read")))


def matched_terms(queries: DataFrame, docs: DataFrame) -> int:
    """How many (query, document, term) there are of packed rows: counted by term on both sides."""
    per = lambda side, name: side.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias(name))
    return per(queries, "q").join(per(docs, "d"), "term").agg(F.coalesce(F.sum(F.col("q") * F.col("d")), F.lit(0))).first()[0]


def _block_scores():
    """Nested, so that the tasks need numpy and pandas only."""
    def merged(side):
        """Sorted distinct ids, and (place, term, weight) of their rows; an id that comes n times counts n times."""
        side = side[side["id"].notna()]
        ids, times = np.unique(side["id"].to_numpy(), return_counts=True)
        side = side.drop_duplicates("id").sort_values("id", kind="stable")
        sizes = [len(t) for t in side["terms"]]
        if not sum(sizes):
            return ids, np.zeros(0, int), np.zeros(0, object), np.zeros(0)
        flat = lambda c: np.concatenate([np.asarray(v) for v in side[c]])
        return ids, np.repeat(np.arange(len(ids)), sizes), flat("terms"), flat("weights") * np.repeat(times, sizes)

    def run(queries, docs, held):
        """(query ids, document ids, chunks): a chunk is the first document of a score matrix, documents by queries.
        A score is added up in the order of the terms, whatever the blocks."""
        q_ids, q_at, q_term, q_w = merged(queries)
        d_ids, d_at, d_term, d_w = merged(docs)
        codes, vocabulary = pd.factorize(q_term, sort=True)
        found = pd.Index(vocabulary).get_indexer(d_term)
        used = np.flatnonzero(found >= 0)
        used = used[np.lexsort((found[used], d_at[used]))]
        at, term, w = d_at[used], found[used], d_w[used]
        order = np.argsort(codes, kind="stable")
        q_at, q_w, begins = q_at[order], q_w[order], np.searchsorted(codes[order], np.arange(len(vocabulary) + 1))
        sizes = np.diff(begins)[term] if len(term) else np.zeros(0, int)
        per = np.bincount(at, sizes, minlength=len(d_ids)) + len(q_ids)
        bounds = np.searchsorted(at, np.arange(len(d_ids) + 1))

        def chunks():
            first = 0
            while first < len(d_ids):
                last = first + max(1, int(np.searchsorted(np.cumsum(per[first:]), held, side="right")))
                i = slice(bounds[first], bounds[min(last, len(d_ids))])
                n, last = sizes[i], min(last, len(d_ids))
                take = np.arange(n.sum()) + np.repeat(begins[term[i]] - (np.cumsum(n) - n), n)
                cell = np.repeat((at[i] - first) * len(q_ids), n) + q_at[take]
                yield first, np.bincount(cell, q_w[take] * np.repeat(w[i], n), minlength=(last - first) * len(q_ids)).reshape(last - first, len(q_ids))
                first = last

        return q_ids, d_ids, chunks()
    return run


def _dealt(queries: DataFrame, docs: DataFrame, block_rows: int):
    """Both sides grouped by blocks of queries and of documents; equal ids share a block."""
    blocks = lambda side, name: side.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int").alias(name))
    shape = with_scalars(blocks(queries, "_q"), blocks(docs, "_d"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = with_scalars(queries, shape).withColumn("qb", own("_q")).withColumn("db", every("_d"))
    right = with_scalars(docs, shape).withColumn("db", own("_d")).withColumn("qb", every("_q"))
    cut = lambda side: side.select("qb", "db", "id", "terms", "weights").groupBy("qb", "db")
    return cut(left).cogroup(cut(right))


def scored_by_blocks(queries: DataFrame, docs: DataFrame, k: int, digits: int, block_rows: int) -> DataFrame:
    """(query_id, doc_id, score): the k best scores above zero of each query in each block of documents."""
    scores_of, held = _block_scores(), HELD

    def best(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame()
        q_ids, d_ids, chunks = scores_of(q, d, held)
        kept = [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
        for first, scores in chunks:
            scores = np.round(scores, digits).T
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] > k else np.zeros(len(scores))
            row, column = np.nonzero((scores >= least[:, None]) & (scores > 0))
            kept = [np.concatenate(x) for x in zip(kept, (row, column + first, scores[row, column]))]
            order = np.lexsort((kept[1], -kept[2], kept[0]))
            kept = [x[order] for x in kept]
            starts = np.flatnonzero(np.diff(kept[0], prepend=-1))
            place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
            kept = [x[place < k] for x in kept]
        return pd.DataFrame({"query_id": q_ids[kept[0]], "doc_id": d_ids[kept[1]], "score": kept[2]})

    schema = T.StructType([T.StructField("query_id", queries.schema["id"].dataType), T.StructField("doc_id", docs.schema["id"].dataType),
                           T.StructField("score", T.DoubleType())])
    return _dealt(queries, docs, block_rows).applyInPandas(best, schema)


def matched_by_blocks(queries: DataFrame, docs: DataFrame, block_rows: int) -> DataFrame:
    """(query_id, matched) as :func:`matches`, from the scores of all blocks."""
    scores_of, held = _block_scores(), HELD

    def count(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame()
        times = d["id"].value_counts()
        q_ids, d_ids, chunks = scores_of(q, d, held)
        found, many = np.zeros(len(q_ids), "int64"), times.reindex(d_ids).to_numpy()
        for first, scores in chunks:
            found += many[first:first + len(scores)] @ (scores > 0)
        return pd.DataFrame({"query_id": q_ids[found > 0], "n": found[found > 0]})

    schema = T.StructType([T.StructField("query_id", queries.schema["id"].dataType), T.StructField("n", T.LongType())])
    return _dealt(queries, docs, block_rows).applyInPandas(count, schema).groupBy("query_id").agg(F.sum("n").alias("matched"))


def top_k(queries: DataFrame, docs: DataFrame, k: int, digits: int, block_rows: int = 2048) -> DataFrame:
    """(query_id, doc_id, score, rank) of packed unit vectors (id, terms, weights): the k best of all
    documents by score, rounded to ``digits``, then id. Documents without a common term score zero.

    Ids are not null and unique on each side. An empty side gives no rows.
    """
    queries, docs = cut_lineage(queries), cut_lineage(docs)
    if matched_terms(queries, docs) > SPELLED:
        return _filled(scored_by_blocks(queries, docs, k, digits, block_rows), queries, docs, k)
    asked, index = exploded(queries, "query_id", "qw").where("qw > 0"), build(docs)
    bands = asked_bands(asked, index)
    kept = cut_lineage(kept_bands(bands, floors(bands, index, k)))
    scored = _scores(kept, index, asked, docs, digits)
    return _filled(scored, queries, docs, k)


def _scores(kept: DataFrame, index: DataFrame, asked: DataFrame, docs: DataFrame, digits: int) -> DataFrame:
    """Full scores of the documents that may reach the floor."""
    sums = _partial(kept, index, "floor", "spare", "rest").groupBy("query_id", "doc_id").agg(
        (F.max("rest") + F.sum(F.col("add") - F.col("spare"))).alias("most"), F.max("floor").alias("floor"))
    left = cut_lineage(sums.where(F.col("most") >= F.col("floor") - SLACK).select("query_id", "doc_id"))
    vectors = exploded(left.select("doc_id").distinct().join(docs.withColumnRenamed("id", "doc_id"), "doc_id").withColumnRenamed(
        "doc_id", "id"), "doc_id", "w")
    terms = left.join(asked, "query_id").join(vectors, ["doc_id", "term"])
    # added up in the order of the terms, so that a score does not depend on the partitioning
    added = F.aggregate(F.array_sort(F.collect_list(F.struct("term", (F.col("qw") * F.col("w")).alias("x")))),
                        F.lit(0.0), lambda acc, t: acc + t["x"])
    return terms.groupBy("query_id", "doc_id").agg(F.round(added, digits).alias("score"))


def _filled(scored: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Ranks, where queries with fewer than k scored documents go on with the least ids at zero."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    first = cut_lineage(scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    found = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list("doc_id").alias("known"))  # at most k
    short = queries.select(F.col("id").alias("query_id")).join(found, "query_id", "left").withColumn(
        "n", F.coalesce("n", F.lit(0))).where(F.col("n") < k)
    # of the 2k least ids at most k - 1 are among those found
    least = docs.select(F.col("id").alias("least")).orderBy("id").limit(2 * k).agg(F.array_sort(F.collect_list("least")).alias("least"))
    spare = F.array_except("least", F.coalesce("known", F.array().cast(docs.select(F.array("id").alias("a")).schema["a"].dataType)))
    zero = with_scalars(short, least).select("query_id", "n", F.posexplode(F.slice(spare, 1, k)).alias("at", "doc_id")).where(
        F.col("n") + F.col("at") < k).select("query_id", "doc_id", F.lit(0.0).alias("score"), (F.col("n") + F.col("at") + 1).cast("int").alias("rank"))
    return first.select("query_id", "doc_id", "score", "rank").unionByName(zero)


def matches(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, matched): how many documents share a term with each query, by OR of bitmaps. A
    bitmap covers 32,768 documents of a term, so no (query, document) pair is made."""
    numbered = cut_lineage(docs.select("id", "terms", F.monotonically_increasing_id().alias("number")))
    places = numbered.select(F.explode("terms").alias("term"), F.bitmap_bucket_number("number").alias("bucket"),
                             F.bitmap_bit_position("number").alias("bit"))
    maps = places.groupBy("term", "bucket").agg(F.bitmap_construct_agg("bit").alias("held"))
    asked = exploded(queries, "query_id", "qw").where("qw > 0").select("query_id", "term")
    return asked.join(maps, "term").groupBy("query_id", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("held")).alias("n")).groupBy(
        "query_id").agg(F.sum("n").alias("matched"))
