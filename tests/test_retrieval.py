"""Block retrieval against direct computation."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lanecost.operators import inverted, metric, termweights, retrieval as rt
from lanecost.schemas import RetrievalPolicy

WORDS = ["freight", "cost", "week", "route", "a", "über", "flood", "toll", "x1", "rise", "no_op", "42"]


def texts(spark, seed, n, prefix):
    rng = random.Random(seed)
    return [(f"{prefix}{i:03d}", " ".join(rng.choices(WORDS, k=rng.randint(0, 9)))) for i in range(n)]


def grams(text):
    words = re.findall(r"\b\w\w+\b", text.lower())
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def direct(queries, docs, k):
    counts = {d: grams(t) for d, t in docs}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(c):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        length = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / length for t, v in w.items()} if length else {}

    d_units = {d: unit(c) for d, c in counts.items()}
    out = {}
    for q, text in queries:
        u = unit(grams(text))
        ranked = sorted(((-round(sum(v * e.get(t, 0) for t, v in u.items()), 9), d) for d, e in d_units.items()))
        out[q] = [(d, i) for i, (_, d) in enumerate(ranked[:k], start=1)]
    return out


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_tfidf_equals_direct_scores_for_any_block_size(spark, block_rows):
    queries, docs = texts(spark, 1, 11, "q"), texts(spark, 2, 23, "d")
    policy = RetrievalPolicy(block_rows=block_rows, score_digits=9)
    got = rt.tfidf_sparse(spark.createDataFrame(queries, "id string, text string"),
                          spark.createDataFrame(docs, "id string, text string"), policy=policy).collect()
    ranked = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        ranked.setdefault(r.query_id, []).append((r.doc_id, r["rank"]))
    assert ranked == direct(queries, docs, 5)


def test_cross_summary_counts_every_pair(spark):
    queries, docs = texts(spark, 3, 5, "q"), texts(spark, 4, 9, "d")
    rows = rt.query_note_cross(spark.createDataFrame(queries, "id string, text string"),
                               spark.createDataFrame(docs, "id string, text string"),
                               policy=RetrievalPolicy(block_rows=2)).collect()
    assert len(rows) == 5 and all(r.scored == 9 and 0 <= r.zero_scores <= 9 for r in rows)


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_dense_ranks_ties_by_id_and_ignores_length(spark, block_rows):
    docs = [("d3", [2.0, 0.0]), ("d1", [5.0, 0.0]), ("d2", [0.0, 1.0]), ("d4", [-1.0, 0.0])]
    df = spark.createDataFrame(docs, "id string, vector array<double>")
    q = spark.createDataFrame([("q", [3.0, 0.0])], "id string, vector array<double>")
    rows = sorted(rt.dense_cosine(q, df, policy=RetrievalPolicy(top_k=4, block_rows=block_rows)).collect(),
                  key=lambda r: r["rank"])
    assert [r.doc_id for r in rows] == ["d1", "d3", "d2", "d4"]


@pytest.mark.parametrize("bad", [[0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], []])
def test_unusable_vectors_fail(spark, bad):
    df = spark.createDataFrame([("d", bad)], "id string, vector array<double>")
    with pytest.raises(Exception, match="vector"):
        rt.unit_vectors(df, "id", "vector").collect()


def test_fusion_and_metrics(spark):
    hits = lambda ids: spark.createDataFrame(
        [("q", d, 1.0, i) for i, d in enumerate(ids, start=1)], "query_id string, doc_id string, score double, rank int")
    fused = rt.rank_fusion(hits(["a", "b", "c"]), hits(["c", "d", "a"]), RetrievalPolicy(top_k=3))
    rows = sorted(fused.collect(), key=lambda r: r.fused_rank)
    # a and c have the same ranks in turn, so the id decides; b and d tie below them
    assert [(r.doc_id, r.fused_rank) for r in rows] == [("a", 1), ("c", 2), ("b", 3)]
    assert rows[0].fused_score == round(1 / 61 + 1 / 63, 12)
    relevance = spark.createDataFrame([("q", "b"), ("q", "z"), ("p", "a")], "query_id string, doc_id string")
    m = rt.retrieval_metrics(fused.withColumnRenamed("fused_rank", "place"), relevance, "place").first()
    assert (m.labelled_queries, m.recall_at_1, m.recall_at_3) == (2, 0.0, 0.25)
    assert m.mean_reciprocal_rank == pytest.approx(1 / 6)


def common_texts(spark, seed, n, prefix):
    """Texts with very frequent and rare words, repeated texts and texts without a word."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rare = [f"rare{rng.randrange(60)}" for _ in range(rng.randrange(3))]
        often = rng.choices(WORDS, weights=[2 ** -k for k in range(len(WORDS))], k=rng.randrange(12))
        rows.append((f"{prefix}{i:04d}", " ".join(rng.sample(often + rare, len(often + rare)))))
    return spark.createDataFrame(rows + [(f"{prefix}x{i}", rows[3][1]) for i in range(9)], "id string, text string")


def hits(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5])
def test_inverted_index_equals_the_product_of_all_pairs(spark, k, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 16)  # frequent terms are dealt over several blocks
    monkeypatch.setattr(inverted, "FIRST_READ", 2)
    queries, docs = common_texts(spark, 5, 30, "q"), common_texts(spark, 6, 300, "d")
    policy = RetrievalPolicy(top_k=k, block_rows=64)
    q, d = rt.sparse_sides(queries, docs)
    assert hits(rt.tfidf_sparse(queries, docs, policy=policy)) == hits(rt.block_top_k(q, d, "sparse", policy))


@pytest.mark.parametrize("held", [50, 10 ** 6])
def test_postings_of_a_block_equal_postings_as_rows(spark, held, monkeypatch):
    queries, docs = common_texts(spark, 5, 30, "q"), common_texts(spark, 6, 300, "d")
    rows, cross = hits(rt.tfidf_sparse(queries, docs)), sorted(rt.query_note_cross(queries, docs).collect())
    monkeypatch.setattr(inverted, "SPELLED", 0)
    monkeypatch.setattr(inverted, "HELD", held)
    monkeypatch.setattr(inverted, "build", None)  # no posting becomes a row
    monkeypatch.setattr(rt, "FREQUENT", 3)
    policy = RetrievalPolicy(block_rows=64)
    assert hits(rt.tfidf_sparse(queries, docs, policy=policy)) == rows
    assert sorted(rt.query_note_cross(queries, docs, policy=policy).collect()) == cross


def test_inverted_index_reads_less_than_all_postings(spark):
    q, d = rt.sparse_sides(common_texts(spark, 7, 20, "q"), common_texts(spark, 8, 2000, "d"))
    index = inverted.build(d)
    bands = inverted.asked_bands(inverted.exploded(q, "query_id", "qw"), index)
    row = inverted.work(bands, inverted.kept_bands(bands, inverted.floors(bands, index, 5))).first()
    assert row.postings_read < row.postings / 2


def test_bitmaps_count_documents_that_share_a_term(spark):
    queries, docs = common_texts(spark, 9, 10, "q"), common_texts(spark, 10, 80, "d")
    rows = {r.query_id: r for r in rt.query_note_cross(queries, docs).collect()}
    of = {r.id: set(grams(r.text)) for r in docs.collect()}
    for r in queries.collect():
        assert (rows[r.id].scored, rows[r.id].zero_scores) == (89, sum(not of[d] & set(grams(r.text)) for d in of))


def test_an_empty_side_gives_no_hits(spark):
    some, none = common_texts(spark, 11, 5, "q"), spark.createDataFrame([], "id string, text string")
    assert not rt.tfidf_sparse(some, none).collect() and not rt.tfidf_sparse(none, some).collect()
    vectors, empty = spark.createDataFrame([("a", [1.0])], "id string, vector array<double>"), spark.createDataFrame([], "id string, vector array<double>")
    assert not rt.dense_cosine(vectors, empty).collect() and not rt.dense_cosine(empty, vectors).collect()


def clustered(spark, seed, n, prefix):
    """Vectors around a few directions, some exactly equal, one direction with a third of all."""
    rng = random.Random(seed)
    centres = [[random.Random(c).gauss(0, 1) for _ in range(6)] for c in range(8)]
    rows = []
    for i in range(n):
        c = centres[0 if i % 3 == 0 else rng.randrange(8)]
        rows.append((f"{prefix}{i:04d}", list(c) if i % 3 == 0 else [x + rng.gauss(0, 0.05) for x in c]))
    return spark.createDataFrame(rows, "id string, vector array<double>")


@pytest.mark.parametrize("block_rows", [16, 2048])
def test_ball_cover_equals_the_product_of_all_pairs(spark, block_rows):
    queries, docs = clustered(spark, 1, 40, "q"), clustered(spark, 2, 500, "d")
    policy = RetrievalPolicy(top_k=7, block_rows=block_rows)
    q, d = rt.unit_vectors(queries, "id", "vector"), rt.unit_vectors(docs, "id", "vector")
    found, work = metric.search(q, d, policy.top_k, policy.score_digits, block_rows)
    assert hits(found) == hits(rt.block_top_k(q, d, "dense", policy))
    row = work.first()
    assert 0 < row.cells_visited <= row.cells and (block_rows > 16 or row.cells_visited < row.cells / 2)


def test_a_query_is_sent_once_to_a_unit_of_cells(spark):
    docs = rt.unit_vectors(clustered(spark, 2, 500, "d"), "id", "vector")
    centres = metric.pivots(docs, 16)
    cells = metric.cells_of(metric.cover(docs, centres, 16), 16)
    queries = docs.withColumns({"floor": F.lit(-1.0), "begun": F.lit(True)})
    sent = metric.visits(queries, centres, cells, 5, 12)
    units = cells.select("unit").distinct().count()
    assert units < cells.count() / 4 and sent.count() <= 500 * units < sent.agg(F.sum("many")).first()[0]


def test_lengths_by_parts_equal_terms_as_rows(spark, monkeypatch):
    """Repeated and null ids, texts without words; the document side makes no term a row."""
    docs = common_texts(spark, 6, 300, "d").union(spark.createDataFrame(
        [("d0003", "rare1 again"), (None, "rare2 rare3"), (None, None), ("e", None), ("f", "! ?"), ("g", "Über über ÜBER x yy")], "id string, text string"))
    queries = common_texts(spark, 5, 30, "q").union(spark.createDataFrame([("r", "über yy unknown"), ("s", "")], "id string, text string"))

    def sides():
        return [sorted((r.id or "", sorted((t, round(w, 12)) for t, w in zip(r.terms, r.weights))) for r in side.collect())
                for side in rt.sparse_sides(queries, docs)]

    monkeypatch.setattr(rt, "KNOWN_ROWS", 0)
    rows = sides()
    monkeypatch.setattr(rt, "KNOWN_ROWS", 1000)
    text_terms, split = rt.text_terms, []
    monkeypatch.setattr(rt, "text_terms", lambda texts, *cols: split.append(texts) or text_terms(texts, *cols))
    for words, texts in ((1, 4096), (100, 20), (10 ** 6, 50)):
        monkeypatch.setattr(termweights, "WORDS", words)
        monkeypatch.setattr(termweights, "TEXTS", texts)
        assert sides() == rows
    assert split == [queries] * 3


def test_a_frequent_term_is_sent_once_a_batch(spark):
    """The rows that are shuffled hold a term once for all texts of a batch."""
    asked = spark.sparkContext.broadcast(termweights.hashes_of(["common"]))
    docs = spark.range(1000).selectExpr("CAST(id AS STRING) AS id", "concat('common own', id) AS text").coalesce(1)
    words = rt.text_words(docs, "id", "text").coalesce(1)
    rows = words.mapInArrow(termweights._splitting(asked, 3, 10 ** 6), termweights.ROW.format("string")).where("part >= 0").collect()
    many = [n for r in rows for n in termweights._numbers()[1](r["many"], r["n"])]
    assert len(rows) == 3 and sorted(many) == [1] * 2000 + [1000]
