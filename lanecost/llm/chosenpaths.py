"""Near copies by a chosen-path set similarity join.

A text is the set of its word shingles, with ``PLACES`` minwise tokens of it as a sketch. In each
of ``TREES`` independent trees a node branches its texts by their tokens at one or two places,
drawn by the node itself (1.25 = 1 / 0.8 on average), so a pair at the threshold shares one child
on average and stays together down to a depth of d with probability of about 2 / (d + 2). Nodes
of at most ``LEAF`` texts are compared exhaustively on the sketches. Missing a pair at 0.8 in all
trees has a probability of about 3e-5; more alike pairs are missed less often.

Large groups of near copies would never fall apart by branching. In a larger node every text is
compared with the node's least ones, texts close to the least stay held there together with all that
may be like them, and only the others branch on. What the sketches call alike is confirmed on
the full sets before it is a link. In a second pass, texts held in one node that are not yet in
one component are compared: in a node of more than ``MINORS`` of them first each with the one that is held together with
most others, then, with the components that gives, all by a join on the rarest shingles (``prefixes``), first with one text of
each larger component, then, where that left them apart, with every text, which loses no link.

Equal sets are one row from the start. A level is one shuffle by node; a node of more than ``HOT``
rows is dealt over several tasks, whose texts meet again in its children. Tasks keep at most
``LEAF`` rows of a node and a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import prefixes, wordsplit
from .common import bounded_batches, written
from .components import components

TREES, PLACES, LEAF, HOT, DEPTH = 12, 48, 128, 50_000, 8
#: Places in 48 that agree: to be compared on full sets, to be held at a node, not to branch on. At the
#: threshold 38 agree on average, and 25 or less once in 300,000 pairs; what is like a text that does not
#: branch on shares 0.45 of its node's least text, 22 places on average.
ALIKE, NEAR, CLOSE = 26, 16, 36
#: Texts of a large node that all others are compared with in the first pass, and texts of a node above which
#: the second pass compares them with one of them first.
HEADS, MINORS = 16, 128
#: Tokens of a fine sketch (a closer estimate of the similarity; the join does without), and how many must agree: 820 do on average at the threshold, and under 759 less often
#: than once in 600,000 pairs. A pair at 0.72 is let through once in 13 times, one at 0.7 once in 400.
FINE, FINELY = 1024, 759
_KINDS = wordsplit.separators(b" \t\n\v\f\r")
_RANDOM = np.random.default_rng(13)
_FACTORS = _RANDOM.integers(0, 1 << 32, PLACES, np.uint32) | np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, PLACES, np.uint32)
_FINE_FACTORS = _RANDOM.integers(0, 1 << 32, FINE, np.uint32) | np.uint32(1)
_FINE_SHIFTS = _RANDOM.integers(0, 1 << 32, FINE, np.uint32)
PAIR, HELD, GROW = 0, 1, 2
_ROW = "node long, fp binary, n long, sketch binary"
_STEP = "kind int, node long, fp binary, n long, sketch binary, other binary"


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct hashes of each text's two-word shingles, ascending. A text of one
    word is one shingle, a text without words has none."""
    found = wordsplit.split(texts, _KINDS)
    known = wordsplit.hashes(found.distinct)
    word = known[found.ids] if len(found.ids) else np.zeros(0, np.uint64)
    per = np.bincount(found.doc, minlength=len(texts))
    follows = np.append(found.doc[1:] == found.doc[:-1], False) if len(word) else np.zeros(0, bool)
    hashed = wordsplit.pair_hashes(word, np.append(word[1:], word[:1]))
    alone = per[found.doc] == 1 if len(word) else np.zeros(0, bool)
    hashed[alone] = wordsplit.pair_hashes(word[alone], np.full(int(alone.sum()), 1, np.uint64))
    use = follows | alone
    doc, hashed = found.doc[use], hashed[use]
    order = np.lexsort((hashed, doc))
    doc, hashed = doc[order], hashed[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
    return hashed[first], np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=len(texts)))]).astype(np.int64)


def _tokens(hashed: np.ndarray, bounds: np.ndarray, factors: np.ndarray, shifts: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits of one minwise token of each set and factor; no set is empty."""
    folded = (hashed ^ hashed >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, len(factors)), f"u{bits // 8}")
    for k in range(len(factors)):
        least = np.minimum.reduceat(folded * factors[k] + shifts[k], bounds[:-1])
        out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return out


def sketches(hashed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bits of each of the ``PLACES`` minwise tokens of the sets, which are not empty."""
    return _tokens(hashed, bounds, _FACTORS, _SHIFTS, 16)


def fine_sketches(hashed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """8 bits of each of ``FINE`` further minwise tokens of the sets, which are not empty."""
    return _tokens(hashed, bounds, _FINE_FACTORS, _FINE_SHIFTS, 8)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, fp (digest of the set), n, sketch; without shingles fp and sketch are null."""
    for batch in batches:
        hashed, bounds = shingle_sets(batch.column("text"))
        n = np.diff(bounds)
        some = n > 0
        raw = hashed.tobytes()
        held = memoryview(raw)
        fp = [xxhash.xxh3_128_digest(held[8 * a : 8 * b]) if b > a else None
              for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        sketch = [None] * len(n)
        if some.any():
            made = sketches(hashed, np.concatenate([bounds[:-1][some], bounds[-1:]]))
            for at, row in zip(np.flatnonzero(some).tolist(), made, strict=True):
                sketch[at] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(fp, pa.binary()), pa.array(n.astype(np.int64)), pa.array(sketch, pa.binary())],
            names=["doc_id", "fp", "n", "sketch"])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return wordsplit.pair_hashes(a, b.astype(np.uint64))


def children(node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child): each row's nodes a level down. Places are drawn by the node: one, or in a
    quarter of all nodes two; the child is named by node, place and token."""
    draw = _mixed(node, np.full(len(node), 7))
    first = (draw % np.uint64(PLACES)).astype(np.int64)
    second = (first + 1 + ((draw >> np.uint64(20)) % np.uint64(PLACES - 1)).astype(np.int64)) % PLACES
    rows, named = [], []
    for place, use in ((first, np.arange(len(node))), (second, np.flatnonzero(draw >> np.uint64(62) == 0))):
        at = place[use]
        token = sketch[use, at].astype(np.uint64) | at.astype(np.uint64) << np.uint64(16)
        rows.append(use)
        named.append(_mixed(node[use], token + np.uint64(1)))
    return np.concatenate(rows), np.concatenate(named)


def _sketch_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, PLACES)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes below the roots of all trees."""
    for batch in batches:
        sketch = _sketch_matrix(batch.column("sketch"))
        for tree in range(TREES):
            rows, named = children(_mixed(np.full(len(sketch), tree, np.uint64), np.full(len(sketch), 1)), sketch)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(named.view(np.int64)), *(batch.column(c).take(at) for c in ("fp", "n", "sketch"))],
                names=["node", "fp", "n", "sketch"])


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sizes allow the similarity."""
    return 100 * np.minimum(a, b) >= 80 * np.maximum(a, b)


class _Rows:
    """Rows of nodes in a task, as arrays."""

    def __init__(self, node, fp, n, sketch):
        self.node, self.fp, self.n, self.sketch = node, fp, n, sketch

    @classmethod
    def of(cls, batch: pa.RecordBatch):
        return cls(batch.column("node").to_numpy(), np.array(batch.column("fp").to_pylist(), dtype=object),
                   batch.column("n").to_numpy(), _sketch_matrix(batch.column("sketch")))

    def pick(self, at) -> "_Rows":
        return _Rows(self.node[at], self.fp[at], self.n[at], self.sketch[at])

    def after(self, other: "_Rows | None") -> "_Rows":
        if other is None:
            return self
        both = zip((other.node, other.fp, other.n, other.sketch), (self.node, self.fp, self.n, self.sketch), strict=True)
        return _Rows(*(np.concatenate(x) for x in both))


def _out(kind: int, rows: _Rows, other=None, full: bool = True) -> pa.RecordBatch:
    m = len(rows.node)
    raw = pa.array([x.tobytes() for x in rows.sketch], pa.binary()) if full else pa.nulls(m, pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(m, kind, np.int32)), pa.array(rows.node), pa.array(list(rows.fp), pa.binary()), pa.array(rows.n), raw,
         pa.nulls(m, pa.binary()) if other is None else pa.array(list(other), pa.binary())],
        names=["kind", "node", "fp", "n", "sketch", "other"])


def _small(rows: _Rows) -> Iterator[pa.RecordBatch]:
    """Compare the texts of each node, all with all. Each goes out with the one before it that is most alike,
    the likeliest link; if there are other pairs, the node's texts are held for the second pass."""
    starts = np.flatnonzero(np.diff(rows.node, prepend=rows.node[0] - 1 if len(rows.node) else 0) != 0)
    size = np.diff(np.append(starts, len(rows.node)))
    place = np.arange(len(rows.node)) - np.repeat(starts, size)
    many, best, partner = (np.zeros(len(rows.node), np.int64) for _ in range(3))
    for step in range(1, int(size.max(initial=1))):
        right = np.flatnonzero(place >= step)
        left = right - step
        fits = _fits(rows.n[left], rows.n[right])
        left, right = left[fits], right[fits]
        agree = (rows.sketch[left] == rows.sketch[right]).sum(axis=1)
        like = agree >= ALIKE
        left, right, agree = left[like], right[like], agree[like]
        many[right] += 1
        many[left] += 1
        closer = agree > best[right]
        best[right[closer]], partner[right[closer]] = agree[closer], left[closer]
    linked = np.flatnonzero(best)
    if len(linked):
        yield _out(PAIR, rows.pick(linked), rows.fp[partner[linked]], full=False)
    others = np.add.reduceat(many, starts) > 2 * np.add.reduceat((best > 0).astype(np.int64), starts) if len(starts) else np.zeros(0, bool)
    hold = np.flatnonzero(np.repeat(others, size) & (many > 0))
    if len(hold):
        yield _out(HELD, rows.pick(hold), full=False)


def _large(rows: _Rows, heads: _Rows) -> Iterator[pa.RecordBatch]:
    """Texts of one node that is larger than a leaf; ``heads`` are its least texts. Each goes out with the
    head that is most alike; nearness to the least one decides who is held and who branches on."""
    agree = (rows.sketch == heads.sketch[0]).sum(axis=1)
    best, partner = np.zeros(len(rows.node), np.int64), np.zeros(len(rows.node), np.int64)
    for k in range(len(heads.node)):
        own = (rows.sketch == heads.sketch[k]).sum(axis=1) * (_fits(rows.n, heads.n[k]) & (rows.fp != heads.fp[k]))
        closer = own > best
        best[closer], partner[closer] = own[closer], k
    at = np.flatnonzero(best >= ALIKE)
    if len(at):
        yield _out(PAIR, rows.pick(at), heads.fp[partner[at]], full=False)
    yield _out(HELD, rows.pick(np.flatnonzero(agree >= NEAR)), full=False)
    further = rows.pick(np.flatnonzero(agree < CLOSE))
    at, named = children(further.node.view(np.uint64), further.sketch)
    grown = further.pick(at)
    grown.node = named.view(np.int64)
    yield _out(GROW, grown)


def _level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One level: rows come sorted by node. At most a leaf of rows is carried from batch to batch."""
    carry: _Rows | None = None
    head: _Rows | None = None  # of a node too large for a leaf, of which more rows may come
    for batch in batches:
        rows = _Rows.of(batch).after(carry)
        carry = None
        if not len(rows.node):
            continue
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(rows.node) != 0) + 1, [len(rows.node)]])
        leaves = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            last = b == len(rows.node)
            if head is not None and rows.node[a] == head.node[0]:
                yield from _large(rows.pick(slice(a, b)), head)
            elif b - a > LEAF:
                head = rows.pick(slice(a, a + HEADS))
                yield from _large(rows.pick(slice(a, b)), head)
            elif last:
                carry = rows.pick(slice(a, b))
            elif b - a > 1:
                leaves.append(np.arange(a, b))
        if leaves:
            yield from _small(rows.pick(np.concatenate(leaves)))
    if carry is not None and len(carry.node) > 1:
        yield from _small(carry)


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, held): pairs (a, b) of sets whose sketches are alike, and (node, fp) of texts to be compared
    with others of the node if they are in different components."""
    rows = nodes.mapInArrow(_roots, _ROW)
    pairs, held = [], []
    for depth in range(DEPTH):
        crowded = written(rows.groupBy("node").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > HOT))
        dealt = rows.join(crowded, "node", "left").withColumn("part", F.when(
            F.col("many").isNotNull(), F.pmod(F.xxhash64("fp"), F.ceil(F.col("many") / HOT))).otherwise(F.lit(0).cast("long")))
        ordered = dealt.select("node", "part", "fp", "n", "sketch").repartition("node", "part").sortWithinPartitions("node", "part", "fp")
        step = written(ordered.select("node", "fp", "n", "sketch").mapInArrow(_level, _STEP))
        pairs.append(step.where(F.col("kind") == PAIR).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")))
        held.append(step.where(F.col("kind") == HELD).select("node", "fp"))
        grow = step.where(F.col("kind") == GROW)
        if depth + 1 == DEPTH:
            held.append(grow.select("node", "fp"))  # what is still crowded is compared by component
        if not grow.head(1):
            break
        rows = grow.select("node", "fp", "n", "sketch")
    join = lambda tables: written(_union(tables).distinct())
    return join(pairs), join(held)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.union(more)
    return out


def _of_sets(docs: DataFrame, wanted: DataFrame, name: str, kind: str, make) -> DataFrame:
    """(fp, ``name``): what ``make`` makes of the hashes and bounds of the sets in ``wanted`` (fp, least); least
    is the doc_id of a row that has it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed, bounds = shingle_sets(batch.column("text"))
            held = memoryview(hashed.tobytes())
            fp = [xxhash.xxh3_128_digest(held[8 * a : 8 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), make(hashed, bounds)], names=["fp", name])

    asked = wanted.select(F.col("least").alias("id")).distinct()
    rows = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
    made = rows.mapInArrow(run, f"fp binary, {name} {kind}")
    return made.join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])


def _hash_lists(hashed: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashed.view(np.int64)))


def _fine_rows(hashed: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A row whose doc_id is that of a wanted one may have no shingles; it has no fine sketch."""
    some = np.diff(bounds) > 0
    made = iter(fine_sketches(hashed, np.append(bounds[:-1][some], bounds[-1])) if some.any() else ())
    return pa.array([next(made).tobytes() if has else None for has in some.tolist()], pa.binary())


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, hashes): the sets in ``wanted`` (fp, least)."""
    return written(_of_sets(docs, wanted, "hashes", "array<long>", _hash_lists))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that reach the similarity on their full sets."""
    shared = F.size(F.array_intersect("in_a", "in_b"))
    union = F.size("in_a") + F.size("in_b") - shared
    found = pairs.join(sets.toDF("b", "in_b"), "b").join(sets.toDF("a", "in_a"), "a")
    return written(found.where(100 * shared >= 80 * union).select("a", "b"))


def _apart(held: DataFrame, links: DataFrame) -> DataFrame:
    """(node, fp, root, many) of the nodes whose held texts are in several components; many: texts of the node."""
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = held.join(roots, "fp", "left").select("node", "fp", F.coalesce("root", "fp").alias("root"))
    several = rooted.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("many")).where("low <> high")
    return written(rooted.join(several, "node").select("node", "fp", "root", "many"))


def _to_centre(apart: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of each text of a large node and the one that is held together with most others, of another component."""
    shared = apart.where(F.col("many") > MINORS).withColumnRenamed("node", "key").join(nodes.select("fp", "n"), "fp")
    fits = 100 * F.least("n", "centre.n") >= 80 * F.greatest("n", "centre.n")
    return prefixes.to_centre(written(shared)).where(fits & (F.col("root") != F.col("centre.root"))).select(
        F.least("fp", "centre.fp").alias("a"), F.greatest("fp", "centre.fp").alias("b")).distinct()


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the component of near copies of each row, and whether it
    is the one of it that stays.

    component_id is the smallest doc_id of the component (nulls aside); a row without shingles is
    its own. Repeated rows are members like any other, so rows that share their doc_id with the
    component's smallest are all kept. Rows with a null doc_id get their component's id and are
    never kept unless the whole component has none. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    marked = written(texts.mapInArrow(_marks, f"doc_id {kind}, fp binary, n long, sketch binary"))
    nodes = written(marked.where("n > 0").groupBy("fp").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    pairs, held = candidates(nodes)
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    links = confirmed(pairs, _sets(texts, nodes.join(wanted, "fp", "left_semi")))
    apart = _apart(held, links)
    sets = _sets(texts, nodes.join(apart.select("fp").distinct(), "fp", "left_semi"))
    central = written(_to_centre(apart, nodes).join(pairs, ["a", "b"], "left_anti"))
    by_centre = confirmed(central, sets)
    open_ = prefixes.rerooted(apart.select("fp", "root").distinct(), by_centre)
    rest = prefixes.linked(written(sets.join(open_, "fp")), 0.8, lambda found: confirmed(found, sets))
    links = written(links.union(by_centre).union(rest))
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = nodes.select("fp", "least").join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = written(rooted.join(classes, "root").select("fp", "component_id"))
    out = marked.join(table, "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT k, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
g AS (SELECT k, unnest(s) AS g FROM s),
p AS (SELECT x.k AS a, y.k AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.k <> y.k GROUP BY x.k, y.k),
l AS (SELECT a, b FROM p JOIN s x ON x.k = a JOIN s y ON y.k = b
    WHERE 100 * shared >= 80 * (len(x.s) + len(y.s) - shared)),
r(k, root) AS (SELECT k, k FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.k WHERE l.b > r.root),
c AS (SELECT r.k, min(t.doc_id) AS component_id FROM r JOIN s t ON t.k = r.root GROUP BY r.k)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (k)"""
