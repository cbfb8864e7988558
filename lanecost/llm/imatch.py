"""I-Match fingerprints with randomised lexicons, in DataFrame operations only.

The lexicon holds the terms whose share of documents lies in a band (equivalently, whose
inverse document frequency does). As every document holds a limited number of distinct terms,
at most (mean distinct terms / least share) terms can be in the band, however many documents
there are; with that bound it is broadcast. Terms are carried as 64-bit hashes.

From the lexicon, ``DRAWS`` chains of ever smaller random sub-lexicons are drawn: a term is in
level r of chain j if its j-th hash ends with r zero bits. Of each chain the fingerprint has the
hash of the sorted distinct terms of the document in the smallest sub-lexicon that holds any of
them, so short and long documents both have a few terms behind each mark.

Documents are dealt once, to ranges of doc_id, together with one copy of the document that
follows the range. The next document, the aggregation of terms and the comparison of
neighbours all stay in that partitioning: the texts are shuffled once and the terms never.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: Chains of sub-lexicons, one mark each.
DRAWS = 12
#: Share of documents a term of the band occurs in, and the least number of documents.
LEAST_SHARE, MOST_SHARE, LEAST_DOCUMENTS = 0.005, 0.2, 2
#: Documents of a range, and the most ranges.
RANGE_ROWS, RANGES = 500, 20_000
#: What separates terms.
BREAK = r"[\s\p{Punct}]+"


def term_rows(texts: DataFrame, *keys: str | Column) -> DataFrame:
    """``keys`` and id for each distinct lower-case term of the whole text, and for the empty term."""
    held = F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower("text"), BREAK, -1)))
    return texts.select("*", F.explode(held).alias("term")).select(*keys, F.xxhash64("term").alias("id"), "term")


def lexicon(texts: DataFrame, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """(id): the hashes of the terms of the band. Every document counts."""
    total = texts.count()
    rows = term_rows(texts).where("term <> ''").groupBy("id").agg(F.count(F.lit(1)).alias("documents"))
    return rows.where(F.col("documents").between(
        max(float(LEAST_DOCUMENTS), least_share * total), max(float(LEAST_DOCUMENTS), most_share * total))).select("id")


def marks(held: Column) -> Column:
    """One mark per chain from the hashes of the terms of a document; null if there are none."""
    def level(term: Column, j: int) -> Column:  # the lowest bit that is set: the higher, the deeper
        bits = F.shiftrightunsigned(F.xxhash64(term, F.lit(j)), 1)
        return bits.bitwiseAND(-bits)

    def mark(j: int) -> Column:
        deepest = F.array_max(F.transform(held, lambda t: level(t, j)))
        own = F.filter(F.zip_with(held, F.array_repeat(deepest, F.size(held)), lambda t, most: F.when(level(t, j) == most, t)),
                       lambda t: t.isNotNull())
        return F.when(F.size(held) > 0, F.xxhash64(own, F.lit(j)))

    return F.array(*[mark(j) for j in range(DRAWS)])


def fingerprints(texts: DataFrame, keys: list[str], carried: Column, words: DataFrame) -> DataFrame:
    """keys, carried, marks of each text. ``texts`` has ``keys``, which name a row, and text; a
    partitioning by some of them is kept. ``carried`` goes along on the row of the empty term only."""
    blank = texts.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("id"))
    rows = term_rows(texts, *keys, F.when(F.col("term") == "", carried).alias("carried")).drop("term")
    rows = rows.join(F.broadcast(words.union(blank)), "id")
    none = F.xxhash64(F.lit(""))
    held = rows.groupBy(*keys).agg(F.max("carried").alias("carried"), F.sort_array(F.array_remove(F.collect_list("id"), none)).alias("held"))
    return held.select(*keys, "carried", marks(F.col("held")).alias("marks"))


def likeness(left: Column, right: Column) -> Column:
    """Share of the chains, of those used by either text, whose marks agree; 1 for equal fingerprints."""
    pairs = F.filter(F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                     lambda p: p["a"].isNotNull() | p["b"].isNotNull())
    same = F.size(F.filter(pairs, lambda p: F.coalesce(p["a"] == p["b"], F.lit(False))))
    return F.when(F.size(pairs) == 0, F.lit(1.0)).otherwise(same / F.greatest(F.size(pairs), F.lit(1))).cast("double")


def shown(fingerprint: Column) -> Column:
    """Text form of a fingerprint: the marks in hexadecimal, 0 for an unused chain."""
    return F.array_join(F.transform(fingerprint, lambda m: F.coalesce(F.lower(F.hex(m)), F.lit("0"))), ".")


def neighbours(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with range, place (order within it), real, next_text; ascending doc_id,
    null first, equal ids by text; the document after the last is the first.

    Each range also ends with a copy of the document that follows it, which is not real.
    """
    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("double").alias("at"))
    count = ids.count()
    wanted = max(1, min(RANGES, -(-count // RANGE_ROWS)))
    cuts = ids.approxQuantile("at", [i / wanted for i in range(1, wanted)], 0.2 / wanted) if wanted > 1 else []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    dealt = docs.withColumn("at", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("double"))
    if len(splits) > 2:
        dealt = Bucketizer(splits=splits, inputCol="at", outputCol="range").transform(dealt)
    else:
        dealt = dealt.withColumn("range", F.lit(0.0))
    dealt = dealt.select(F.col("range").cast("int").alias("range"), "doc_id", "text", F.lit(True).alias("real"))
    # the first document of each range, one row per range, goes to the range before as well
    firsts = written(dealt.groupBy("range").agg(F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("nulls")))
    ring = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(ring), F.max("range").over(Window.partitionBy()))
    heads = written(firsts.select("range", F.when(~F.col("nulls"), F.col("head")).alias("head"), before.alias("before")))
    there = heads.toDF("of", "head", "before")
    copies = dealt.join(there, (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head")))
    copies = copies.groupBy("of", "before", "doc_id").agg(F.min("text").alias("text")).select(
        F.col("before").alias("range"), "doc_id", "text", F.lit(False).alias("real"))
    order = Window.partitionBy("range").orderBy(F.desc("real"), F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return dealt.unionByName(copies).select(
        "*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))


def compare(docs: DataFrame, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """Fingerprints of each document and of its edited text, and likeness to the edited text and
    to the next document.

    Returns doc_id, n_chars, edited_sha256, marks, edited_marks, near_edited, near_next. The
    edited text has its last floor(n_chars / 4) characters replaced by as many first ones of the
    next document. Null texts count as empty; a text without terms of the lexicon has a
    fingerprint of unused marks, which equals that of any other such text. Repeated rows are
    documents of their own. An empty table gives no rows.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    words = written(lexicon(texts, least_share, most_share))
    size, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - cut),
                      F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), cut))
    own = neighbours(texts).select("range", "place", F.explode(F.array(
        F.struct(F.lit(0).alias("form"), F.col("text").alias("text"), "doc_id", size.cast("long").alias("n_chars"), "real"),
        F.struct(F.lit(1).alias("form"), edited.alias("text"), "doc_id", size.cast("long").alias("n_chars"), "real"))).alias("t"))
    own = own.select("range", "place", "t.*")
    carried = F.struct("doc_id", "n_chars", "real", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    marked = fingerprints(own, ["range", "place", "form"], carried, words)

    def of(form: int, what: str) -> Column:
        return F.max(F.when(F.col("form") == form, F.col(what)))

    row = marked.groupBy("range", "place").agg(
        of(0, "carried").alias("own"), of(0, "marks").alias("marks"), of(1, "carried").alias("edited"), of(1, "marks").alias("edited_marks"))
    following = F.lead("marks").over(Window.partitionBy("range").orderBy("place"))
    return row.withColumn("next_marks", following).where("own.real").select(
        "own.doc_id", "own.n_chars", F.col("edited.sha256").alias("edited_sha256"), "marks", "edited_marks",
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"))


def digests(docs: DataFrame) -> DataFrame:
    return compare(docs).select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("marks")).alias("fingerprint"),
        shown(F.col("edited_marks")).alias("edited_fingerprint"), "near_edited", "near_next")
