"""SimHash near-dedup with multi-index hashing.

Fingerprints come from word shingles with one XXH64 each (a map over partitions). Equal
fingerprints are merged first, so a group of copies is one row however large it is. For at
most ``2 * r + 1`` differing bits, one half of the fingerprint differs in at most r bits: each
fingerprint is stored under both halves, and probes the keys of the ball of radius r around
each half. What meets is verified on the full distance within the join. Only distinct
fingerprints take part, links go from the smaller to the larger one, and of the two balls of a pair only the
smaller fingerprint's is probed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, fresh, written
from .components import components
from .wordsplit import pair_hashes

#: Shingles hashed at a time.
BLOCK = 1 << 16
#: Bounds of the blocks of a fingerprint that ``index_keys`` takes two at a time: of five blocks two are equal within three bits.
BLOCKS = (0, 13, 26, 39, 52, 64)
_MASKS = np.array([sum(((1 << BLOCKS[k + 1]) - (1 << BLOCKS[k])) for k in two) for two in combinations(range(len(BLOCKS) - 1), 2)], np.uint64)


def of_hashes(hashes: np.ndarray) -> int:
    """Fingerprint of hashed shingles (unsigned 64 bits each): bit i is set if it is set in over half of them."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        votes += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * votes > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def index_keys(fingerprint: int) -> np.ndarray:
    """A key for each two blocks; fingerprints that differ in at most three bits share one."""
    blocks = np.array([fingerprint], np.int64).view(np.uint64) & _MASKS
    return pair_hashes(blocks, np.arange(len(_MASKS), dtype=np.uint64)).view(np.int64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; signed 64 bits."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(0, len(words) - shingle)
    first, final = starts[: last + 1].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    hashed, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        found = np.array([hashed(whole[s:e], seed) for s, e in zip(
            first[at : at + BLOCK], final[at : at + BLOCK], strict=True)], np.uint64)
        votes += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(first)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """``docs`` with the fingerprint of its whole text as a long. Null and wordless texts have 0."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(into, column(F.col(text)))


def _half(value: Column, upper: bool) -> Column:
    return F.shiftrightunsigned(value, 32) if upper else value.bitwiseAND(F.lit(0xFFFFFFFF))


def links(distinct: DataFrame, max_distance: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) that differ in at most
    ``max_distance`` bits, each once."""
    radius = max_distance // 2
    flips = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(32), r)]
    ball = F.array(*[F.lit(x).cast("long") for x in flips])
    found = []
    for upper in (False, True):
        keyed = distinct.select(F.col("fp").alias("b"), _half(F.col("fp"), upper).alias("key"))
        # sorted, never broadcast: the probes are as many as the ball times what Spark sizes them at
        probes = distinct.select(F.col("fp").alias("a"), F.explode(ball).alias("flip")).select(
            "a", _half(F.col("a"), upper).bitwiseXOR(F.col("flip")).alias("key")).hint("merge")
        near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
        pairs = probes.join(keyed, (probes["key"] == keyed["key"]) & near).select("a", "b")
        if upper:  # those whose lower halves meet as well have been found there
            lower = F.bit_count(_half(F.col("a"), False).bitwiseXOR(_half(F.col("b"), False)))
            pairs = pairs.where(lower > radius)
        found.append(pairs)
    return found[0].union(found[1])


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """(doc_id, body, fp, root, component_id): the near-duplicate class of each row.

    component_id is the smallest doc_id of the class, null if all are null; root the class's least
    fingerprint, body a hash of the text. Repeated rows are members like any other. An empty
    table gives no rows.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("body"))
    marked = written(with_fingerprint(texts, shingle=shingle, into="fp").drop("text"))
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), max_distance)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = written(rooted.join(classes, "root").select("fp", "root", "component_id"))
    return marked.join(table, "fp").select("doc_id", "body", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", classes=groups, **settings) -> DataFrame:
    """``docs`` with one row per near-duplicate class: one of those with the smallest doc_id, the
    least by fingerprint and text hash; equal rows are interchangeable."""
    first = classes(docs, doc_id, text, **settings).where("doc_id <=> component_id")
    rows = first.groupBy("root", "component_id", "fp", "body").agg(F.count(F.lit(1)).alias("rows"))
    least = F.min_by(F.struct("body", "rows"), F.struct("fp", "body")).alias("least")
    chosen = written(rows.groupBy("root", "component_id").agg(least).select(
        F.col("component_id").alias("chosen"), "least.body", "least.rows"))
    body = fresh("body")
    marked = docs.withColumn(body, F.xxhash64(text)).alias("d")
    out = marked.join(chosen.alias("c"), F.col(f"d.{doc_id}").eqNullSafe(F.col("c.chosen")) & (F.col(f"d.{body}") == F.col("c.body")))
    once = out.where("c.rows = 1").select("d.*")
    several = out.where("c.rows > 1").select("d.*").dropDuplicates([doc_id, body])
    return once.unionByName(several).drop(body)


def digests(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
