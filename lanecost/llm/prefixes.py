"""Pairs of like sets that lie in different components, by prefixes of their rarest elements.

A set of a elements and one of b <= a, with a Jaccard similarity of t or more, share at least
o = t / (1 + t) * (a + b). In any one order of all elements, the first one they share therefore lies
among the first a - t * a + 1 of the larger set and the first b - 2 * t / (1 + t) * b + 1 of the smaller
one, and behind it at least o elements are left in both, itself included. Only these heads are joined, so no
pair that reaches the similarity is lost. The order puts rare elements first: the head of a text that differs from a
large group in more places than the similarity allows holds elements of its own only, and meets nobody.

What meets is also held against the parities of how many elements of each set fall into ``SIGNS`` words of 64 bits: bits that
differ in them are at most as many as elements that are in one set only, of which like sets have few. This too loses nothing.

How rare an element is comes from a table of fixed size that goes to the tasks; whatever it says, the
order is the same for all sets, and the result too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written
from .components import components

#: Bits of the number of buckets that elements are counted in: at most so many rows reach the driver, one byte each
#: goes to the tasks.
BUCKET_BITS = 18
#: Words of 64 bits that carry the parities of a set.
SIGNS = 8
_FACTOR, _SIGN_FACTOR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _signs() -> list[str]:
    return [f"sign{k}" for k in range(SIGNS)]


def _bucket(elements: np.ndarray) -> np.ndarray:
    return (elements.view(np.uint64) * _FACTOR >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All elements, and the size of each list."""
    return lists.flatten().to_numpy(), np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of the elements that several sets of a batch hold, with their number."""
    for batch in batches:
        found, n = np.unique(_flat(batch.column("hashes"))[0], return_counts=True)
        bucket, at = np.unique(_bucket(found[n > 1]), return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket), pa.array(np.bincount(at, n[n > 1], len(bucket)).astype(np.int64))], names=["bucket", "n"])


def _levels(sets: DataFrame):
    """Broadcast bytes: the number of binary digits of each bucket's count."""
    rows = sets.select("hashes").mapInArrow(_repeated, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    level = np.zeros(1 << BUCKET_BITS, np.uint8)
    for row in rows:
        level[row["bucket"]] = int(row["n"]).bit_length()
    return sets.sparkSession.sparkContext.broadcast(level.tobytes())


def _parities(elements: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """A row of ``SIGNS`` words for each of ``n`` sets: whether an odd number of its elements falls on each bit."""
    bit = (elements.view(np.uint64) * _SIGN_FACTOR >> np.uint64(32)).astype(np.int64) % (64 * SIGNS)
    odd = np.bincount(of * 64 * SIGNS + bit, minlength=n * 64 * SIGNS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, SIGNS)


def _heads(levels, similarity: float):
    """The head of each set, rarest first: element, place from 0, and whether a smaller set needs it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        for batch in batches:
            elements, size = _flat(batch.column("hashes"))
            of = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((elements, level[_bucket(elements)], of))
            place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
            n = size[of]
            signs = _parities(elements, of, len(size))
            use = place <= n - np.ceil(similarity * n - 1e-9)
            of, place, n, elements = of[use], place[use], n[use], elements[order][use]
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(elements), pa.array(place), pa.array(n), *(batch.column(c).take(at) for c in ("fp", "root", "members")),
                 pa.array(place <= n - np.ceil(2 * similarity / (1 + similarity) * n - 1e-9)), *(pa.array(signs[of, k]) for k in range(SIGNS))],
                names=["element", "place", "n", "fp", "root", "members", "low", *_signs()])
    return run


def _heads_of(sets: DataFrame, similarity: float) -> DataFrame:
    kind = sets.schema["fp"].dataType.simpleString()
    return written(sets.select("fp", "hashes", "root", "members").mapInArrow(
        _heads(_levels(sets), similarity), f"element long, place long, n long, fp {kind}, root {kind}, members long, low boolean"
        + "".join(f", {c} long" for c in _signs())))


def _shared(heads: DataFrame) -> DataFrame:
    """The rows of the elements that several components hold."""
    several = heads.groupBy("element").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select("element")
    return written(heads.join(several, "element", "left_semi"))


def _may_be_like(x: DataFrame, y: DataFrame, similarity: float, by: Column) -> DataFrame:
    """Pairs (a, b), a < b, of sets x and y of different components that meet in an element, where ``by`` holds."""
    least = F.lit(similarity / (1 + similarity)) * (F.col("x.n") + F.col("y.n")) - 1e-9
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    differ = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _signs()), F.lit(0))
    alike = (left >= least) & (differ <= F.col("x.n") + F.col("y.n") - 2 * least + 1e-6)
    pairs = x.alias("x").join(y.alias("y"), (F.col("x.element") == F.col("y.element")) & (F.col("x.root") != F.col("y.root")) & by & alike)
    return pairs.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def _smaller() -> Column:
    """Whether set y of a pair is the smaller one."""
    return (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.fp") < F.col("x.fp")))


def _all_pairs(met: DataFrame, similarity: float) -> DataFrame:
    return _may_be_like(met, met.where("low"), similarity, _smaller())


def _first_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs of ``_all_pairs`` those of a set and one that stands for a larger component at the element, another one
    at each."""
    chosen = F.min_by(F.struct(*[c for c in met.columns if c not in ("element", "root")]), F.xxhash64("element", "fp"))
    standing = met.groupBy("element", "root").agg(chosen.alias("one")).select("element", "root", "one.*")
    larger = F.struct("y.members", "y.root") > F.struct("x.members", "x.root")
    return _may_be_like(met, standing, similarity, larger & F.when(_smaller(), F.col("y.low")).otherwise(F.col("x.low")))


def apart(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of sets of different components that may reach the similarity: all that do, and few others.

    ``sets``: fp, hashes (distinct longs), root (the component, of the type of fp). Sets of size 0 are in no pair.
    """
    return _all_pairs(_shared(_heads_of(sets.withColumn("members", F.lit(0).cast("long")), similarity)), similarity)


def rerooted(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """``rooted`` (root, and more) with the components that ``links`` (a, b: members of them, by ``fp``) make of its own."""
    of = rooted.select("fp", "root").distinct()
    met = links.join(of.toDF("a", "of_a"), "a").join(of.toDF("b", "of_b"), "b")
    moved = components(met.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).toDF("root", "least")
    return rooted.join(moved, "root", "left").withColumn("root", F.coalesce("least", "root")).drop("least")


def linked(sets: DataFrame, similarity: float, confirmed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links between the components of ``sets`` (as in ``apart``) that join all which a pair at the similarity joins;
    ``confirmed`` writes those of the pairs that reach it.

    A text may be like thousands of another component, and one link is enough. So at each element first every set meets
    one set of each larger component only; what that leaves apart meets as in ``apart``, which loses nothing.
    """
    members = sets.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    met = _shared(_heads_of(written(sets.join(members, "root")), similarity))
    first = confirmed(_first_pairs(met, similarity))
    return first.union(confirmed(_all_pairs(_shared(written(rerooted(met, first))), similarity)))


def to_centre(shared: DataFrame) -> DataFrame:
    """``shared`` (key, fp, many: texts of the key, and more) with ``centre``: fp and the other columns of the text of
    each key that meets most others over all its keys."""
    rest = [c for c in shared.columns if c not in ("key", "fp", "many")]
    degree = shared.groupBy("fp").agg(F.sum("many").alias("degree"))
    centre = shared.join(degree, "fp").groupBy("key").agg(F.max(F.struct("degree", "fp", *rest)).alias("centre"))
    return shared.join(centre, "key")
