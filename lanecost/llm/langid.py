"""Language identification by compression.

Fitting gathers a bounded number of passages per language into a raw-content zstandard
dictionary. A text is cut into blocks, each block is compressed once with every
dictionary, case folded, and the language whose blocks are smallest in total wins. Long texts are cut
so that their own repetitions don't outweigh what the dictionary knows; every block of the
whole text counts. Languages keep dictionaries of different sizes, and a larger one makes any text
smaller; what a dictionary saves on text of the other languages is therefore taken off first,
measured on their dictionaries. Narrow margins and texts without letters are rejected.

Prediction is a map over partitions; the dictionaries, at most ``languages x dictionary_bytes``,
travel with the function.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import bounded_batches, written

UNKNOWN = "und"
#: Bytes of text compressed at a time.
BLOCK = 1024
LEVEL = 5


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", passages: int = 400,
        passage_chars: int = 400, dictionary_bytes: int = 96 << 10) -> dict[str, bytes]:
    """A dictionary per language from at most ``passages`` labelled rows of each.

    The bound on the sample is ``passages x passage_chars`` characters a language, whatever
    the size of ``labelled``. Rows are chosen by the hash of their text, so the choice does
    not depend on partitioning; equal texts count once. Rows without text or label are left
    out. Empty input gives no dictionaries.
    """
    rows = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"))
    # a written table, one row per label: its size is known, so the texts need not be shuffled by label
    have = written(rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts")))
    # a hash below this share leaves about four times the passages, a bounded number of texts per language;
    # an estimate of the texts will do, since the least draws are taken of what is left
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = rows.join(have, "lang").withColumn("draw", draw).where(
        F.col("draw") * F.col("texts") < 4.0 * passages)
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - passage_chars) / 2).cast("int") + 1)
    some = few.select("lang", "draw", F.substring(F.col("text"), middle, F.lit(passage_chars)).alias("passage")).distinct()
    order = Window.partitionBy("lang").orderBy("draw", "passage")
    some = some.withColumn("place", F.row_number().over(order)).where(F.col("place") <= passages)
    found: dict[str, list[str]] = {}
    for row in some.orderBy("lang", "place").toLocalIterator():
        found.setdefault(row.lang, []).append(row.passage)
    return {k: "\n".join(v).lower().encode()[:dictionary_bytes] for k, v in sorted(found.items())}


@functools.lru_cache(maxsize=8)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> list[zstandard.ZstdCompressor]:
    made = []
    for _, data in dictionaries:
        held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(
            dict_data=held, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def sizes(text: str, compressors: list[zstandard.ZstdCompressor]) -> list[int]:
    """Compressed bytes of the whole text with each dictionary."""
    data = text.lower().encode()
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


@functools.lru_cache(maxsize=8)
def offsets(dictionaries: tuple[tuple[str, bytes], ...]) -> list[float]:
    """Compressed bytes per byte of the other languages' sample with each dictionary; 0 without others."""
    compressors = _compressors(dictionaries)
    out = []
    for k, compressor in enumerate(compressors):
        others = [data[i : i + BLOCK] for j, (_, data) in enumerate(dictionaries) if j != k for i in range(0, len(data), BLOCK)]
        held = sum(map(len, others))
        out.append(sum(len(compressor.compress(x)) for x in others) / held if held else 0.0)
    return out


def judge(text: str | None, dictionaries: tuple[tuple[str, bytes], ...], min_margin: float) -> tuple[str, float, bool]:
    """(language, score, rejected). The score is the lead over the second language, as a
    share of the second's size and at most 1; with one language it is 1."""
    if text is None or not dictionaries or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, True
    size = sizes(text, _compressors(dictionaries))
    length = len(text.lower().encode())
    found = sorted((n - o * length, k, n) for n, o, (k, _) in zip(size, offsets(dictionaries), dictionaries, strict=True))
    if len(found) == 1:
        return found[0][1], 1.0, False
    (best, lang, _), (second, _, whole) = found[:2]
    score = min(1.0, (second - best) / whole)
    return lang, score, score < min_margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", into: str = "lang_pred",
            score: str = "score", rejected: str = "rejected", min_margin: float = 0.003) -> DataFrame:
    """``docs`` with language, score (0 to 1) and whether the verdict is rejected.

    Null texts and texts without a letter are ``und`` with score 0, rejected. Ties between
    languages go to the first by code point, and are rejected. Other columns stay; columns
    with the names of the three new ones are replaced.
    """
    bounded_batches(docs.sparkSession)
    model = tuple(sorted(dictionaries.items()))
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
                         T.StructField("rejected", T.BooleanType())])

    @F.pandas_udf(kind)
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([judge(t, model, min_margin) for t in texts], columns=["lang", "score", "rejected"])

    held = "_verdict"
    while held in docs.columns:
        held += "_"
    out = docs.drop(into, score, rejected).withColumn(held, verdict(docs[text]))
    return out.select(
        *[F.col(f"`{c}`") for c in out.columns if c != held], F.col(held)["lang"].alias(into),
        F.col(held)["score"].alias(score), F.col(held)["rejected"].alias(rejected))


def learnable(doc_id: Column) -> Column:
    """Rows whose label may be learnt from: the checksum of the id as text is not 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))
