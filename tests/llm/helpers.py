"""Small tables for the corpus tests."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("size", T.StringType())])  # a column whose name operators use themselves


def table(spark, rows):
    """Documents from (doc_id, text, lang, source)."""
    full = [(i, t, lang, s, None if t is None else len(t), "own") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary):x}" for _ in range(n)]


def odd_rows():
    """Nulls everywhere, empty and blank texts, repeated rows, ties, a long text."""
    long = " ".join(words(1, 30_000, 5_000))
    return [
        (1, "One line.\nTwo lines.", "en", "a"), (1, "One line.\nTwo lines.", "en", "a"), (2, "", "en", "a"),
        (3, None, None, None), (None, "no id", None, "b"), (4, "   \n \t ", "de", "b"), (5, long, "en", None),
        (6, "Größe ändert sich 日本語", "de", "a"), (7, "One line.\nTwo lines.", "en", "c"), (None, None, None, None)]
