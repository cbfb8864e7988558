"""Suffix-array dedup of long repeats by distributed prefix doubling.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else.
Plain prefix doubling sorts one (position, rank) pair per byte and round. Here a row stands
for a block of neighbouring start positions, and the rounds lengthen the part that is ranked:

1. Every string of ``length`` bytes holds an anchor, its leftmost ``seed``-byte word of least
   hash; equal strings hold it at the same place. The first round ranks the anchors by this word.
2. A block is a range of start positions, as distances in front of an anchor. Its *core* is what
   its strings have in common, its *span* what they cover together. Each round ranks the blocks by
   core: a block whose core is unique has no repeated string and drops out; if its whole span
   occurs twice, it is past the threshold and all its strings are repeated. Other blocks are
   split, which lengthens the cores, and are ranked again, down to blocks of one position, whose
   core is the string itself.
3. Of blocks with equal spans one goes on to the next round, for as long as other blocks may
   share some of its strings.

Ranks are names: 64-bit hashes of cores, which only decide who is compared (a collision costs
work, not a wrong result), and 128-bit hashes of spans, which decide equality. Classes are
found by aggregates with map-side combine, not by a sort that would put a frequent passage in
one range, and joined back by equi-joins, so copies are one row from each map task. Texts
that have to be shuffled travel compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded_batches, written

#: Bytes of a removed repeat, and of the words anchors are chosen by.
LENGTH, SEED = 400, 128
#: Parts a block is split into.
SPLIT = 7
#: Positions hashed at a time.
WINDOW = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_NO = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the ``seed`` bytes from each position, 64 bits, well mixed. ``seed`` is a power of 2:
    the hash of twice as many bytes comes from two neighbouring hashes."""
    h, n = (data.astype(np.uint64) + np.uint64(1)) * _MULT, 1
    while n < seed:
        h = (h[:-n] * np.uint64(0xD6E8FEB86659FD93)) ^ (h[n:] >> np.uint64(29)) ^ (h[n:] * _MULT)
        n *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(31)
    return np.minimum(h, _NO - np.uint64(1))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each window of ``width`` values."""
    n = len(values) - width + 1
    level, best = 1, np.arange(len(values))
    while level * 2 <= width:  # minima of windows of level values, doubled
        left, right = best[: len(best) - level], best[level:]
        best = np.where(values[left] <= values[right], left, right)
        level *= 2
    left, right = best[:n], best[width - level : width - level + n]
    return np.where(values[left] <= values[right], left, right)


def anchors(data: bytes, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last) for the strings of a document: start positions first..last have this anchor."""
    n = len(data) - length + 1
    places: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    raw = np.frombuffer(data, np.uint8)
    before = -1
    for at in range(0, max(n, 0), WINDOW):
        count = min(WINDOW, n - at)
        found = window_minima(word_hashes(raw[at : at + count + length - 1], seed), length - seed + 1)[:count] + at
        change = np.flatnonzero(np.diff(found, prepend=before))
        places.append(found[change])
        starts.append(change + at)
        before = int(found[-1])
    if not places:
        return (np.zeros(0, np.int64),) * 3
    place, first = np.concatenate(places), np.concatenate(starts)
    return place, first, np.concatenate([first[1:] - 1, [n - 1]])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def core_name(part: bytes, block: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(part, block))


def span_name(part: bytes, near: int, far: int) -> bytes:
    """Name of a span and of the range of distances it belongs to."""
    return xxhash.xxh3_128_digest(part, near << 32 | far)


def block_sizes(width: int) -> list[int]:
    """Sizes of blocks after the first round, each a multiple of the next, down to 1."""
    sizes = [1]
    while sizes[0] * SPLIT < width:
        sizes.insert(0, sizes[0] * SPLIT)
    return sizes


_ANCHOR = "k1 long, k2 long, anchor int, near int, far int, core long, span binary"
_CONTEXT = "k1 long, k2 long, anchor int, near int, far int, own boolean, origin int, context binary"
_BLOCK = "k1 long, k2 long, anchor int, near int, far int, own boolean, core long, span binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (part.split() for part in text.split(", "))])


def _anchors_of(length: int, seed: int):
    """Rows of the first round: an anchor, the distances of its starts, its word, its span."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(_ANCHOR)
        for batch in batches:
            rows = []
            for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text")), strict=True):
                data = text.encode()
                for a, first, last in zip(*(x.tolist() for x in anchors(data, length, seed)), strict=True):
                    near, far = a - last, a - first
                    rows.append((k1, k2, a, near, far, core_name(data[a : a + seed], 0),
                                 span_name(data[first : last + length], near, far)))
            yield _batch(rows, schema)
    return run


def _contexts_of(length: int):
    """Bytes that the starts of the listed anchors of a text cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, unpack = _schema(_CONTEXT), zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for k1, k2, packed, listed in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "packed", "listed")), strict=True):
                data = unpack.decompress(packed)
                for x in listed:
                    a, near, far = x["anchor"], x["near"], x["far"]
                    rows.append((k1, k2, a, near, far, x["own"], -far, data[a - far : a - near + length]))
            yield _batch(rows, schema)
    return run


def _blocks_of(length: int, size: int):
    """Rows of the next round: the blocks of ``size`` distances, on a grid that all anchors share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(_BLOCK)
        for batch in batches:
            rows = []
            for k1, k2, a, near, far, own, origin, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for b in range(near // size, far // size + 1):
                    left, right = b * size, b * size + size - 1
                    core = data[-left - origin : length - right - origin]
                    low, high = max(near, left), min(far, right)
                    rows.append((k1, k2, a, low, high, own, core_name(core, b),
                                 span_name(data[-high - origin : length - low - origin], low, high)))
            yield _batch(rows, schema)
    return run


def _judged(rows: DataFrame) -> DataFrame:
    """``rows`` whose core occurs more than once, with settled (their span does) and split (to
    be ranked again; of equal spans one is enough). Instead of core and span."""
    mark = F.xxhash64("k1", "k2", "anchor", "near")
    # written, so that the joins have plain exchanges on both sides and a core of very many
    # spans can be split
    spans = written(rows.groupBy("core", "span").agg(F.count(F.lit(1)).alias("places"), F.min(mark).alias("least")))
    cores = written(spans.groupBy("core").agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("places") == 1).alias("open")))
    shared = spans.join(cores, "core").where("places > 1 or spans > 1")
    verdict = shared.select("core", "span", (F.col("places") > 1).alias("settled"), "least",
                            ((F.col("spans") > 1) & (F.col("open") > 0)).alias("more"))
    split = F.col("more") & (~F.col("settled") | (mark == F.col("least")))
    return rows.join(verdict, ["core", "span"]).withColumn("split", split).drop("core", "span", "least", "more")


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(k1, k2, begin, end): byte ranges of the documents (k1, k2, text) whose strings of
    ``length`` bytes are all repeated. Ranges overlap; all removed bytes are in one."""
    bounded_batches(docs.sparkSession)
    first = written(docs.mapInArrow(_anchors_of(length, seed), _ANCHOR))
    again = written(first.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"))
    shared = written(first.join(again, "core"))
    judged = written(_judged(shared.withColumn("own", F.lit(True))))
    done = [judged]
    # distances of one document's anchors: as many as the document has
    listed = judged.where("split").groupBy("k1", "k2").agg(F.collect_set(F.struct(
        "anchor", "near", "far", (~F.col("settled")).alias("own"))).alias("listed"))
    contexts = written(docs.select("k1", "k2", _packed("text").alias("packed")).join(listed, ["k1", "k2"]).mapInArrow(
        _contexts_of(length), _CONTEXT))
    sizes = block_sizes(length - seed + 1)
    for size in sizes:
        judged = written(_judged(contexts.mapInArrow(_blocks_of(length, size), _BLOCK)))
        done.append(judged.where("own"))
        if size > 1:
            parts = judged.where("split").select(
                "k1", "k2", "anchor", F.col("near").alias("low"), F.col("far").alias("high"),
                (F.col("own") & ~F.col("settled")).alias("alone")).distinct()
            cut = F.expr(f"substring(context, 1 - high - origin, {length} + high - low)")
            contexts = written(contexts.join(parts, ["k1", "k2", "anchor"]).where("low >= near and high <= far").select(
                "k1", "k2", "anchor", F.col("low").alias("near"), F.col("high").alias("far"), F.col("alone").alias("own"),
                (-F.col("high")).alias("origin"), cut.alias("context")))
    found = [x.where("settled").select("k1", "k2", (F.col("anchor") - F.col("far")).alias("begin"),
                                       (F.col("anchor") - F.col("near") + length).alias("end")) for x in done]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@F.pandas_udf(T.BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=1)
    return texts.map(lambda t: pack.compress(t.encode()))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that the ranges cover."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes, begin and end) and kept (the other bytes) of
    each row.

    Null texts count as empty; texts shorter than ``length`` keep everything. Copies, also
    repeated rows, lose every byte if they are long enough. ``seed`` is a power of 2 below ``length``.
    An empty table gives no rows.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # rows that agree in both are the same document to what follows, and get the same ranges
    texts = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("k2"), "text")
    found = repeats(texts.select("k1", "k2", "text"), length, seed).groupBy("k1", "k2").agg(
        F.collect_set(F.struct("begin", "end")).alias("ranges"))
    kind = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            size, spans, kept = [], [], []
            for packed, ranges in zip(batch.column("packed").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                data = unpack.decompress(packed)
                runs = merged([(r["begin"], r["end"]) for r in ranges or ()])
                edges = [0, *(x for r in runs for x in r), len(data)]
                size.append(len(data))
                spans.append([{"begin": b, "end": e} for b, e in runs])
                kept.append(b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])

    packed = texts.select("doc_id", "k1", "k2", _packed("text").alias("packed"))
    return packed.join(found, ["k1", "k2"], "left").select("doc_id", "packed", "ranges").mapInArrow(run, kind)


def digests(docs: DataFrame, shown: bool = False) -> DataFrame:
    """doc_id and the sizes and digests of what ``remove_repeats`` makes; if ``shown`` also text, the remaining bytes as text, with U+FFFD
    where a removed run begins or ends within a character."""
    out = remove_repeats(docs)
    text = [F.make_valid_utf8(F.col("kept").cast("string")).alias("text")] if shown else []
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), *text)
