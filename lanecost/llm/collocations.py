"""Phrase collocations from a weighted de Bruijn graph of words.

Edges are the longest grams (``LONGEST`` words), nodes their overlaps (a word less). A task counts
the grams of its batches, Spark adds them up; where a run of words ends before a gram is full,
the shorter rest is counted as a correction. Every place of the corpus is thus one row: the
longest gram that starts there. The count of a shorter phrase is the flow that leaves it, edges
and corrections of which it is the beginning, so no shorter gram is ever counted from text.

A phrase that occurs ``least`` times holds only words, pairs and triples that do. Words are counted
first, then pairs of frequent words, then triples of frequent pairs, and from a place no gram is
read on over a word, pair or triple that is too rare: the shorter rest is a correction like at
any end, so flows of all phrases that can reach the threshold stay exact, and rare text makes no
edges. These counts are by hash and only ever too large; what is frequent is handed to the tasks as a
bitmap of a fixed size, two bits each. A false positive costs a row, not a wrong count.

Unary paths (nodes through which all flow comes from one edge and leaves by one edge) are
compacted by pointer doubling to one row per path; phrases of full length are read off the
paths. Hot words and languages are no hot tasks: all counting is by phrase, with map-side combine.
Every task hands on nearly all frequent phrases, so the last pass runs in few tasks: rows are the phrases
times the tasks, which would grow with the square of the input if both grew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import wordsplit
from .common import bounded_batches, written

LONGEST = 5
#: Sizes of the parts that are counted beforehand.
FILTERED = 3
#: Bits of the bitmap that tells frequent parts; a bound on what goes to the tasks (1 MB each).
FILTER_BITS = 1 << 23
#: Counted rows a task holds before it hands them on, and rows it hands on at a time.
HELD_ROWS, HANDED_ROWS = 400_000, 20_000
#: Bytes of text that a task splits into words at a time.
TEXT_BYTES = 1 << 20
#: Tasks of the last pass for each core.
WAVES = 2
#: Makes the second bit of a hash; less than 31 bits, so that products stay below 63.
_SECOND = 0x2F0B4C47
_KINDS = wordsplit.separators(b" \t", b".,;:!?\n\v\f\r")


class Tokens:
    """The words of a batch, numbered per language: ``ids`` per place, ``lang``, ``word`` and ``known`` (a
    hash of both) per number. ``left`` is how many words a gram from a place may have, at most LONGEST."""

    def __init__(self, batch: pa.RecordBatch, bitmaps: list[bytes]):
        found = wordsplit.split(batch.column("text"), _KINDS)
        langs = batch.column("lang").dictionary_encode()
        of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[found.doc] if len(found.doc) else found.doc
        self.ids, pairs = pd.factorize(of * max(1, len(found.distinct)) + found.ids)
        self.lang = langs.dictionary.take(pa.array(pairs // max(1, len(found.distinct)))).cast(pa.string())
        self.word = found.distinct.take(pa.array(pairs % max(1, len(found.distinct))))
        keys = pc.binary_join_element_wise(self.lang.cast(pa.large_binary()), self.word, pa.scalar(b"\t", pa.large_binary()))
        self.known = wordsplit.hashes(keys, 42)
        n = len(self.ids)
        ends = np.append(np.flatnonzero(np.diff(found.piece)) + 1, n) if n else np.zeros(0, np.int64)
        piece = np.cumsum(np.diff(found.piece, prepend=found.piece[:1]) != 0)
        self.left = np.minimum(ends[piece] - np.arange(n), LONGEST)
        for size, bitmap in enumerate(bitmaps, 1):
            at, hashed = self.grams(size)
            self.left[at[~_in(bitmap, hashed)]] = size - 1
            for _ in range(LONGEST if len(at) else 0):  # a gram reaches no further than the one from the next place
                self.left[:-1] = np.minimum(self.left[:-1], self.left[1:] + 1)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places from which a gram of ``size`` words may be read, and 32-bit hashes of these grams."""
        at = np.flatnonzero(self.left >= size)
        hashed = self.known[self.ids[at]]
        for k in range(1, size):
            hashed = wordsplit.pair_hashes(hashed, self.known[self.ids[at + k]])
        return at, (hashed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _in(bitmap: bytes, hashed: np.ndarray) -> np.ndarray:
    held = np.frombuffer(bitmap, np.uint8)
    mixed = (hashed.view(np.uint32).astype(np.int64) * _SECOND >> 20).astype(np.int32)  # as in _bitmap
    out = np.ones(len(hashed), bool)
    for bit in (hashed & (FILTER_BITS - 1), mixed & (FILTER_BITS - 1)):
        out &= (held[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, about ``TEXT_BYTES`` at a time."""
    for batch in batches:
        step = max(1, len(batch) // (batch.nbytes // TEXT_BYTES + 1))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def _added_up(tables: Iterator[pa.Table], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a task with the ``n`` of equal keys added up, a bounded number at a time."""
    held: list[pa.Table] = []
    rows = 0
    for table in tables:
        held.append(table)
        rows += table.num_rows
        if rows > HELD_ROWS:
            held = [_sums(held, keys)]
            rows = held[0].num_rows
            if rows > HELD_ROWS // 2:
                yield from held[0].to_batches(HANDED_ROWS)
                held, rows = [], 0
    if rows:
        yield from _sums(held, keys).to_batches(HANDED_ROWS)


def _sums(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    summed = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum")])
    return summed.select([*keys, "n_sum"]).rename_columns([*keys, "n"]).combine_chunks()


_PARTS = "gram int, lang string, n long"
_GRAMS = "lang string, size int, gram string, n long"


def _count_parts(size: int, filters: list):
    """Hashes of the parts of ``size`` words with their number; words also give a row per language, without
    hash, of how many there are."""
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in _slices(batches):
            found = Tokens(batch, [f.value for f in filters])
            gram, n = np.unique(found.grams(size)[1], return_counts=True)
            langs, total = [], np.zeros(0, np.int64)
            if size == 1 and len(found.ids):
                of = found.lang.dictionary_encode()
                total = np.bincount(of.indices.to_numpy(zero_copy_only=False)[found.ids], minlength=len(of.dictionary))
                langs = of.dictionary.to_pylist()
            yield pa.table({"gram": pa.concat_arrays([pa.array(gram, pa.int32()), pa.nulls(len(total), pa.int32())]),
                            "lang": pa.concat_arrays([pa.nulls(len(gram), pa.string()), pa.array(langs, pa.string())]),
                            "n": pa.array(np.append(n, total).astype(np.int64))})

    return lambda batches: _added_up(tables(batches), ["gram", "lang"])


def _count_grams(filters: list):
    """The longest gram from each place."""
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in _slices(batches):
            found = Tokens(batch, [f.value for f in filters])
            code, many = found.ids.copy(), max(1, len(found.word))
            for m in range(1, LONGEST + 1):
                if m > 1:  # number the grams of m words from those of m - 1 words and the next word
                    at = np.flatnonzero(found.left >= m)
                    code[at] = pd.factorize(code[at] * many + found.ids[at + m - 1])[0]
                own = np.flatnonzero(found.left == m)
                if not len(own):
                    continue
                _, first, n = np.unique(code[own], return_index=True, return_counts=True)
                start = own[first]
                parts = [found.word.take(pa.array(found.ids[start + k])) for k in range(m)]
                gram = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if m > 1 else parts[0]
                yield pa.table({"lang": found.lang.take(pa.array(found.ids[start])), "size": pa.array(np.full(len(n), m, np.int32)),
                                "gram": gram.cast(pa.string()), "n": pa.array(n.astype(np.int64))})

    return lambda batches: _added_up(tables(batches), ["lang", "size", "gram"])


def _bitmap(frequent: DataFrame):
    """Broadcast bitmap of the hashes in ``frequent``; at most FILTER_BITS / 64 rows reach the driver."""
    second = F.shiftright(F.col("gram").cast("long").bitwiseAND(0xFFFFFFFF) * F.lit(_SECOND), 20).bitwiseAND(FILTER_BITS - 1).cast("int")
    bits = frequent.select(F.explode(F.array(F.col("gram").bitwiseAND(FILTER_BITS - 1), second)).alias("bit"))
    rows = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits")).collect()
    held = np.zeros(FILTER_BITS // 64, np.int64)
    for row in rows:
        held[row["at"]] = row["bits"]
    return frequent.sparkSession.sparkContext.broadcast(held.tobytes())


def _few_tasks(texts: DataFrame) -> DataFrame:
    """``texts`` in at most ``WAVES`` tasks a core, without a shuffle."""
    return texts.coalesce(WAVES * texts.sparkSession.sparkContext.defaultParallelism)


def _head(gram: str, n: int) -> Column:
    return F.substring_index(gram, " ", n)


def _tail(gram: str) -> Column:
    return F.expr(f"substring({gram}, locate(' ', {gram}) + 1)")


def _flow(grams: DataFrame, size: int, least: int) -> DataFrame:
    """(lang, phrase, a): what leaves each phrase of ``size`` words."""
    return grams.where(F.col("size") >= size).groupBy("lang", _head("gram", size).alias("phrase")).agg(
        F.sum("n").alias("a")).where(F.col("a") >= least)


def compact(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, path, edges, a): maximal paths of ``edges`` (lang, phrase, a) through nodes whose whole
    flow (``nodes``: lang, phrase, a) comes by one edge and leaves by one. ``path`` are the words.

    A path is at most as long as the longest piece, and so is its row. A loop would need a node
    where text begins or ends, which is not unary, so paths end.
    """
    one = lambda node, name: edges.select("lang", node.alias("node"), "phrase", "a").groupBy("lang", "node").agg(
        F.count(F.lit(1)).alias("many"), F.min("phrase").alias(name), F.min("a").alias("a")).where("many = 1").drop("many")
    unary = one(_tail("phrase"), "edge").join(one(_head("phrase", LONGEST - 1), "ahead"), ["lang", "node", "a"]).join(
        nodes.withColumnRenamed("phrase", "node"), ["lang", "node", "a"]).where("edge <> ahead").select("lang", "edge", "ahead")
    reach = written(edges.withColumnRenamed("phrase", "edge").join(unary, ["lang", "edge"], "left").select(
        "lang", "edge", "a", F.coalesce("ahead", "edge").alias("ahead"), F.col("ahead").isNotNull().cast("long").alias("hops")))
    while True:
        further = reach.select("lang", F.col("edge").alias("ahead"), F.col("ahead").alias("then"), F.col("hops").alias("more"))
        moved = written(reach.join(further, ["lang", "ahead"]).select(
            "lang", "edge", "a", F.col("then").alias("ahead"), (F.col("hops") + F.col("more")).alias("hops"), "more"))
        reach = moved.drop("more")
        if not moved.where("more > 0").head(1):
            break
    steps = F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("place"), F.col("edge"))))
    path = reach.groupBy("lang", "ahead").agg(steps.alias("steps"), F.min("a").alias("a"))
    words = F.concat_ws(" ", F.element_at("steps", 1)["edge"], F.transform(
        F.slice("steps", F.lit(2), F.size("steps") - 1), lambda s: F.substring_index(s["edge"], " ", -1)))
    return path.select("lang", words.alias("path"), F.size("steps").alias("edges"), "a")


def graph(docs: DataFrame, least: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(sizes, counts, paths): words per language (lang, n), the phrases of 1 to ``LONGEST - 1`` words
    that occur ``least`` times or more (lang, phrase, a) by number of words, and the compacted paths
    of such phrases of ``LONGEST`` words."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text"))
    filters: list = []
    for size in range(1, FILTERED + 1):
        parts = texts.mapInArrow(_count_parts(size, list(filters)), _PARTS).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
        parts = written(parts.where((F.col("n") >= least) | F.col("gram").isNull()))
        if size == 1:
            totals = parts.where("gram is null").select("lang", "n")
        filters.append(_bitmap(parts.where("gram is not null")))
    grams = written(_few_tasks(texts).mapInArrow(_count_grams(filters), _GRAMS).groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")))
    counts = [written(_flow(grams, m, least)) for m in range(1, LONGEST + 1)]
    paths = written(compact(counts[-1], counts[-2]))
    return totals, counts[:-1], paths


def phrases_of(paths: DataFrame) -> DataFrame:
    """(lang, phrase, a): the phrases of ``LONGEST`` words along the paths."""
    at = paths.select("lang", "a", F.split("path", " ").alias("words"), F.explode(F.sequence(F.lit(1), F.col("edges"))).alias("k"))
    return at.select("lang", F.concat_ws(" ", F.slice("words", F.col("k"), F.lit(LONGEST))).alias("phrase"), "a")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` collocations of 2 to 5 words.

    Null texts are empty, null languages are ``und``. Repeated rows count each. Phrases that a
    longer one of the same count holds are dropped; it is enough to look one word further, since
    counts can't rise with length. Ties of the score go to the larger count, then to the smaller
    phrase. An empty table, or one without a frequent phrase, gives no rows. ``least`` is positive.
    """
    sizes, counts, paths = graph(docs, least, text, lang)
    by_size = [*counts, written(phrases_of(paths))]
    kept = by_size[-1].withColumn("size", F.lit(LONGEST))
    for m in range(2, LONGEST):
        longer = by_size[m]
        held = longer.select("lang", _head("phrase", m).alias("phrase"), "a").union(longer.select("lang", _tail("phrase"), "a")).distinct()
        kept = kept.union(by_size[m - 1].join(held, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", F.lit(m).alias("size")))
    parts = by_size[0]
    for more in by_size[1:-1]:
        parts = parts.union(more)
    cut = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn(
        "right", F.expr("substring(phrase, length(left) + 2)"))
    cut = cut.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(parts.toDF("lang", "right", "r"), ["lang", "right"])
    cut = cut.join(sizes, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cut = cut.withColumn("over", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n"))).withColumn("under", wide("l") * wide("r"))
    scored = cut.select("lang", "phrase", "a", "n", "k", "l", "r", F.expr("over div under").cast("long").alias("score"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score").withColumn("rank", F.row_number().over(order).cast("long"))
    return out.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int, top: int) -> str:
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM i, (VALUES (1), (2), (3), (4), (5)) v(m) WHERE i + m - 1 <= len(ws)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY lang, m, phrase),
n AS MATERIALIZED (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE a >= {least}),
h AS MATERIALIZED (SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS phrase, max(a) AS most FROM c, range(1, 6) r(i), range(1, 6) s(k)
    WHERE i + k - 1 <= m AND k < m GROUP BY ALL),
q AS MATERIALIZED (SELECT c.* FROM c LEFT JOIN h ON h.lang = c.lang AND h.phrase = c.phrase
    WHERE m > 1 AND (most IS NULL OR 100 * most < 100 * a)),
k AS MATERIALIZED (SELECT q.*, k, array_to_string(ws[1 : k], ' ') AS lp, array_to_string(ws[k + 1 : m], ' ') AS rp
    FROM q, range(1, 5) t(k) WHERE k < m),
s AS (SELECT k.lang, k.phrase, k.a, n.n, k.k, x.a AS l, y.a AS r,
    (1000::HUGEINT * k.a::HUGEINT * n.n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
    FROM k JOIN n ON n.lang = k.lang JOIN c x ON x.lang = k.lang AND x.phrase = k.lp JOIN c y ON y.lang = k.lang AND y.phrase = k.rp),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM z WHERE rank <= {top}"""
