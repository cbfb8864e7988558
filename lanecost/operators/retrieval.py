"""Sparse and dense top-k retrieval, rank fusion and its quality measures.

Every document has a rank for every query (one with score zero still has), but neither channel
scores all pairs: the sparse one reads an impact-ordered inverted index (``inverted``), the dense
one a cover of balls (``metric``). Both are exact. ``block_top_k`` is the plain product of
bounded blocks that the tests hold them against.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.expressions import with_scalars
from ..schemas import RetrievalPolicy
from ..session import cut_lineage
from . import inverted, metric, termweights

# Maximal runs of at least two word characters of any script.
WORD = r"[\p{L}\p{N}_]{2,}"
#: Frequent terms that are sent to every task, and rows of a table that is sent at most.
FREQUENT, KNOWN_ROWS = 200_000, 500_000


# --- TF-IDF vectors -----------------------------------------------------------------

def _words():
    return F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))


def _dealt_texts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # a named number of parts: splitting is costly, and few bytes of text must not end up in few tasks
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(parts, "id")


def text_words(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words, times): the lower-case words of each text of an id, and how often the id comes."""
    return _dealt_texts(texts, id_col, text_col).groupBy("id").agg(
        F.collect_list(_words()).alias("words"), F.count(F.lit(1)).alias("times"))


def text_terms(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf) over lower-case words and neighbouring word pairs.

    The texts are dealt by id before they are split, so counting the terms of a text
    needs no shuffle of the much larger term rows.
    """
    pairs = F.when(
        F.size("_w") > 1,
        F.zip_with(F.slice(F.col("_w"), F.lit(1), F.size("_w") - 1),
                   F.slice(F.col("_w"), F.lit(2), F.size("_w") - 1),
                   lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return (
        _dealt_texts(texts, id_col, text_col).select("id", _words().alias("_w"))
        .select("id", F.explode_outer(F.concat("_w", pairs)).alias("term")).where("term IS NOT NULL")
        .groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))


def inverse_document_frequency(terms: DataFrame, documents: DataFrame, *carry: str) -> DataFrame:
    """ln((1 + n) / (1 + df)) + 1 over the document side only."""
    size = documents.agg(F.count(F.lit(1)).alias("_n"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    return with_scalars(df, size).select(
        "term", (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("idf"), *carry)


def packed_vectors(ids: DataFrame, terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One unit-length TF-IDF row per id: parallel arrays of terms and weights.

    ``vocabulary`` is (term, idf, used, known). Terms outside it vanish before the length is
    taken; terms that are not ``used`` count for the length and are then left out. ``known`` terms
    (the used and the frequent ones) go to the texts, whose terms lie together already; only the
    other terms are shuffled, to their idf and back to the ids as a part of the length.
    """
    weight = (1 + F.log("tf")) * F.col("idf")
    known = vocabulary.where("known").drop("known")
    known = F.broadcast(known) if known.count() <= KNOWN_ROWS else known
    packed = (
        terms.join(known, "term").select("id", "term", "used", weight.alias("w"))
        .groupBy("id").agg(
            F.sum(F.col("w") * F.col("w")).alias("_near"),
            F.collect_list(F.when(F.col("used"), F.struct("term", "w"))).alias("v")))
    other = terms.join(known, "term", "left_anti").join(vocabulary.where("NOT known"), "term").select("id", weight.alias("w"))
    far = other.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("_far"))
    return ids.join(packed, "id", "left").join(far, "id", "left").withColumn(
        "_len", F.sqrt(F.coalesce("_near", F.lit(0.0)) + F.coalesce("_far", F.lit(0.0)))).select(
        "id", F.coalesce(F.col("v.term"), F.array().cast("array<string>")).alias("terms"),
        F.coalesce(F.transform(F.col("v.w"), lambda w: w / F.col("_len")),
                   F.array().cast("array<double>")).alias("weights"))


# --- block products -----------------------------------------------------------------

def _scorer(kind: str):
    """Score matrix of two blocks. Everything the tasks run is nested here, so that the
    function travels by value and the executors need numpy and pandas only."""

    def dense(queries, docs):
        matrix = lambda frame: np.vstack(frame["vector"].to_numpy()).astype("float64")
        return matrix(queries) @ matrix(docs).T

    def sparse(queries, docs, columns=4096):
        """Dot products of packed sparse rows, one slice of the query vocabulary at a time."""
        places = lambda frame: np.repeat(np.arange(len(frame)), [len(t) for t in frame["terms"]])
        joined = lambda frame, c: np.concatenate([np.asarray(v) for v in frame[c]])
        q_rows, d_rows = places(queries), places(docs)
        scores = np.zeros((len(queries), len(docs)))
        if not len(q_rows) or not len(d_rows):
            return scores
        codes, vocabulary = pd.factorize(joined(queries, "terms"))
        d_codes = pd.Index(vocabulary).get_indexer(joined(docs, "terms"))
        q_w, d_w = joined(queries, "weights"), joined(docs, "weights")
        for low in range(0, len(vocabulary), columns):
            high = min(low + columns, len(vocabulary))
            sides = []
            for rows, at, w, n in ((q_rows, codes, q_w, len(queries)), (d_rows, d_codes, d_w, len(docs))):
                pick = (at >= low) & (at < high)
                side = np.zeros((n, high - low))
                side[rows[pick], at[pick] - low] = w[pick]
                sides.append(side)
            scores += sides[0] @ sides[1].T
        return scores

    return dense if kind == "dense" else sparse


def _dealt(side: DataFrame, prefix: str, rows: DataFrame, other_rows: DataFrame, block_rows: int) -> DataFrame:
    """Own block by hash, repeated for every block of the other side. ``rows`` and ``other_rows``
    are the tables the sides were made from: counting them does not make the vectors again."""
    blocks = lambda df, name: df.agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int").alias(name))
    own = with_scalars(with_scalars(side, blocks(rows, "_own")), blocks(other_rows, "_other"))
    mine = F.pmod(F.xxhash64("id"), F.col("_own")).cast("int")
    theirs = F.explode(F.sequence(F.lit(0), F.col("_other") - 1))
    q, d = ("_qb", "_db") if prefix == "q" else ("_db", "_qb")
    return own.withColumn(q, mine).withColumn(d, theirs).drop("_own", "_other")


def block_product(queries: DataFrame, docs: DataFrame, kind: str, reduce_block, schema: T.StructType,
                  block_rows: int, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Run ``reduce_block(query_ids, doc_ids, scores)`` on each block pair's score matrix.

    A group holds about ``block_rows`` rows of each side whatever the table sizes.
    """
    scores_of = _scorer(kind)

    def product(q, d):
        if q.empty or d.empty:
            return pd.DataFrame()
        d = d.sort_values("id", kind="stable").reset_index(drop=True)
        return reduce_block(q["id"].to_numpy(), d["id"].to_numpy(), scores_of(q, d))

    q_rows, d_rows = counted or (queries, docs)
    left = _dealt(queries, "q", q_rows, d_rows, block_rows).groupBy("_qb", "_db")
    right = _dealt(docs, "d", d_rows, q_rows, block_rows).groupBy("_qb", "_db")
    return left.cogroup(right).applyInPandas(product, schema)


def top_k_notes(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """First k documents per query by score, then id; ranks from one."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def block_top_k(queries: DataFrame, docs: DataFrame, kind: str, policy: RetrievalPolicy,
                 counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    k, digits = policy.top_k, policy.score_digits
    schema = T.StructType([
        T.StructField("query_id", queries.schema["id"].dataType),
        T.StructField("doc_id", docs.schema["id"].dataType),
        T.StructField("score", T.DoubleType())])

    def keep_best(q_ids, d_ids, scores):
        rounded = np.round(scores, digits) + 0.0
        n = min(k, rounded.shape[1])
        # documents are in id order, so a stable sort breaks ties by id
        best = np.argsort(-rounded, axis=1, kind="stable")[:, :n]
        return pd.DataFrame({
            "query_id": np.repeat(q_ids, n), "doc_id": d_ids[best].ravel(),
            "score": np.take_along_axis(rounded, best, axis=1).ravel()})

    return top_k_notes(block_product(queries, docs, kind, keep_best, schema, policy.block_rows, counted), k)


def sparse_sides(queries: DataFrame, docs: DataFrame, query_cols=("id", "text"),
                 doc_cols=("id", "text")) -> tuple[DataFrame, DataFrame]:
    """Packed TF-IDF vectors of both sides; document terms no query has are left out
    after the length was taken, since they cannot add to a score. Up to ``KNOWN_ROWS`` terms of queries
    go to the texts of the documents (``termweights``); of more, the terms of all texts are joined as rows."""
    q_terms = cut_lineage(text_terms(queries, *query_cols))
    q_ids = queries.select(F.col(query_cols[0]).alias("id"))
    asked = cut_lineage(q_terms.select("term").distinct())
    if asked.count() <= KNOWN_ROWS:
        size = docs.count()
        held, packed = termweights.weighed(text_words(docs, *doc_cols), size, [r["term"] for r in asked.collect()])
        idf = F.log(F.lit(1 + size) / (1 + F.col("many"))) + 1
        vocabulary = held.select("term", idf.alias("idf"), F.lit(True).alias("used"), F.lit(True).alias("known"))
        return packed_vectors(q_ids, q_terms, vocabulary), packed
    d_ids = docs.select(F.col(doc_cols[0]).alias("id"))
    d_terms = text_terms(docs, *doc_cols)  # split anew for each use: the terms are many times the texts
    asked = asked.withColumn("_asked", F.lit(True))
    counted = cut_lineage(inverse_document_frequency(d_terms, d_ids, "_df").join(asked, "term", "left").select(
        "term", "idf", "_df", F.coalesce("_asked", F.lit(False)).alias("used")))
    # terms in so many documents that there are at most FREQUENT of them
    often = counted.agg(F.greatest(F.lit(2), F.ceil(F.sum("_df") / FREQUENT)).alias("_often"))
    vocabulary = with_scalars(counted, often).select("term", "idf", "used", (F.col("used") | (F.col("_df") >= F.col("_often"))).alias("known"))
    return packed_vectors(q_ids, q_terms, vocabulary.where("used")), packed_vectors(d_ids, d_terms, vocabulary)


def tfidf_sparse(queries: DataFrame, docs: DataFrame, query_cols=("id", "text"),
                 doc_cols=("id", "text"), policy: RetrievalPolicy = RetrievalPolicy()) -> DataFrame:
    """(query_id, doc_id, score, rank): first k by TF-IDF dot product."""
    q, d = sparse_sides(queries, docs, query_cols, doc_cols)
    return inverted.top_k(q, d, policy.top_k, policy.score_digits, policy.block_rows)


def query_note_cross(queries: DataFrame, docs: DataFrame, query_cols=("id", "text"),
                     doc_cols=("id", "text"), policy: RetrievalPolicy = RetrievalPolicy()) -> DataFrame:
    """What the full product holds per query: documents scored, zero scores, best score."""
    q, d = (cut_lineage(side) for side in sparse_sides(queries, docs, query_cols, doc_cols))
    best = inverted.top_k(q, d, 1, policy.score_digits, policy.block_rows).select("query_id", F.col("score").alias("best_score"))
    scored = d.agg(F.count(F.lit(1)).alias("scored"))
    many = inverted.matched_terms(q, d) > inverted.SPELLED
    matched = inverted.matched_by_blocks(q, d, policy.block_rows) if many else inverted.matches(q, d)
    per = q.select(F.col("id").alias("query_id")).join(matched, "query_id", "left").join(best, "query_id")
    return with_scalars(per, scored).select(
        "query_id", "scored", (F.col("scored") - F.coalesce("matched", F.lit(0))).alias("zero_scores"), "best_score")


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimension: DataFrame | None = None) -> DataFrame:
    """(id, vector) of unit length; an empty, non-finite or zero vector fails the job."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + x * x))
    reason = (
        F.when(F.col("_v").isNull() | (F.size("_v") < 1), "empty vector")
        .when(bad, "vector must be finite").when(F.col("_len") == 0, "vector must be non-zero"))
    return (
        vectors.select(F.col(id_col).alias("id"), v.alias("_v"))
        .withColumn("_len", length).withColumn("_bad", reason)
        .select("id", F.when(F.col("_bad").isNotNull(), F.raise_error(F.col("_bad")).cast("array<double>"))
                .otherwise(F.transform("_v", lambda x: x / F.col("_len"))).alias("vector")))


def dense_cosine(queries: DataFrame, docs: DataFrame, query_cols=("id", "vector"),
                 doc_cols=("id", "vector"), policy: RetrievalPolicy = RetrievalPolicy()) -> DataFrame:
    """(query_id, doc_id, score, rank): first k by cosine. Vectors are an input."""
    hits, _ = metric.search(
        unit_vectors(queries, *query_cols), unit_vectors(docs, *doc_cols), policy.top_k, policy.score_digits, policy.block_rows)
    return hits


# --- fusion -------------------------------------------------------------------------

def rrf_score(sparse_rank, dense_rank, policy: RetrievalPolicy = RetrievalPolicy()):
    """Weighted reciprocal-rank sum, rounded so that equal ranks give equal scores."""
    term = lambda w, rank: F.coalesce(F.lit(float(w)) / (policy.rrf_k + rank), F.lit(0.0))
    return F.round(term(policy.sparse_weight, sparse_rank) + term(policy.dense_weight, dense_rank), 12)


def fused_rank(fused: DataFrame, k: int) -> DataFrame:
    """Rank by fused score, then best single rank, then id; first k."""
    missing = F.lit(2 ** 31).cast("bigint")
    best = F.least(F.coalesce(F.col("sparse_rank").cast("bigint"), missing),
                   F.coalesce(F.col("dense_rank").cast("bigint"), missing))
    order = Window.partitionBy("query_id").orderBy(F.col("fused_score").desc(), best, F.col("doc_id"))
    return fused.withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= k)


def rank_fusion(sparse: DataFrame, dense: DataFrame, policy: RetrievalPolicy = RetrievalPolicy()) -> DataFrame:
    """Full outer join of the two rankings, fused and cut to k."""
    named = lambda df, c: df.select(
        "query_id", "doc_id", F.col("rank").alias(f"{c}_rank"), F.col("score").alias(f"{c}_score"))
    both = named(sparse, "sparse").join(named(dense, "dense"), ["query_id", "doc_id"], "full_outer")
    scored = both.withColumn("fused_score", rrf_score(F.col("sparse_rank"), F.col("dense_rank"), policy))
    return fused_rank(scored, policy.top_k)


# --- measures -----------------------------------------------------------------------

def retrieval_metrics(hits: DataFrame, relevance: DataFrame, rank: str = "rank") -> DataFrame:
    """recall@1/3/5 and mean reciprocal rank over every labelled query.

    ``relevance`` is (query_id, doc_id); a labelled query without hits counts as 0.
    """
    totals = relevance.groupBy("query_id").agg(F.countDistinct("doc_id").alias("relevant"))
    found = hits.join(relevance.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"])
    return metrics_from_found(found, totals, rank)


def metrics_from_found(found: DataFrame, totals: DataFrame, rank: str = "rank") -> DataFrame:
    """The same from relevant hits and the number of relevant documents per query."""
    per = found.groupBy("query_id").agg(
        *[F.count_if(F.col(rank) <= k).alias(f"in_{k}") for k in (1, 3, 5)],
        F.min(rank).alias("first"))
    joined = totals.join(per, "query_id", "left")
    recall = lambda k: F.avg(F.coalesce(f"in_{k}", F.lit(0)) / F.col("relevant")).alias(f"recall_at_{k}")
    return joined.agg(
        F.count(F.lit(1)).alias("labelled_queries"), recall(1), recall(3), recall(5),
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mean_reciprocal_rank"))


def relevant_intersection(hits: DataFrame, relevance: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """Relevant documents within the first k, per query."""
    return hits.where(F.col(rank) <= k).join(relevance, ["query_id", "doc_id"], "left_semi").select(
        "query_id", "doc_id", rank)


def structured_union_recall(relevance: DataFrame, assessed: DataFrame, keys) -> DataFrame:
    """Share of labelled candidates with a relevant note among the assessed ones."""
    reached = relevance.join(assessed, [*keys, "note_id"], "left_semi").select(*keys).distinct()
    labelled = relevance.select(*keys).distinct()
    return labelled.join(reached.withColumn("_hit", F.lit(1)), list(keys), "left").agg(
        F.count(F.lit(1)).alias("labelled"), F.count("_hit").alias("covered"),
        F.coalesce(F.count("_hit") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("recall"))
