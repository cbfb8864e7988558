import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lanecost.llm import collocations as co

from .helpers import odd_rows, table


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for _, t, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    frequent = {g: a for g, a in f.items() if a >= least}
    inside = {}
    for (lang, g), a in frequent.items():
        for k in range(1, len(g)):
            for i in range(len(g) - k + 1):
                key = lang, g[i : i + k]
                inside[key] = max(inside.get(key, 0), a)
    out = []
    for (lang, g), a in frequent.items():
        if len(g) > 1 and inside.get((lang, g), 0) < a:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]])
                                 for k in range(1, len(g)))
            out.append((lang, -score, -a, " ".join(g).encode(), l, r))
    ranked, place = [], Counter()
    for lang, score, a, g, l, r in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], g.decode(), -a, l, r, n[lang], -score))
    return ranked


def found(spark, rows, least, top=2000):
    out = co.collocations(table(spark, rows), least, top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def corpus(seed, n):
    """Few words, so that phrases repeat; passages that many texts share; pieces of all lengths."""
    rng = random.Random(seed)
    passages = [" ".join(f"p{k}x{j}" for j in range(4 + 5 * k)) for k in range(5)]
    rows = []
    for k in range(n):
        parts = [rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(rng.randrange(40))]
        parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        parts = [p + rng.choice(["", "", "", ",", "!", "\n", "\t", " . "]) for p in parts]
        rows.append((k, (" the" * 9 if k % 3 == 0 else "") + " ".join(parts).title(), ["aa", "bb", None, "und"][k % 4], "s"))
    return rows


@pytest.mark.parametrize("least", [2, 7, 25])
def test_equals_brute_force(spark, least):
    rows = corpus(least, 160)
    want = brute(rows, least, 2000)
    assert found(spark, rows, least) == want and len(want) > 10
    assert found(spark, rows, least, 3) == brute(rows, least, 3)


def test_hot_phrases_odd_rows_and_empty_table(spark):
    rows = odd_rows() + [(100 + k, "One two three four five six. ONE\x1ctwo", "en", "s") for k in range(50)]
    assert found(spark, rows, 2) == brute(rows, 2, 2000)
    assert found(spark, [], 2) == [] and found(spark, odd_rows(), 10 ** 6) == []


def test_unary_paths_are_compacted(spark):
    """A passage that is always read whole is one path; where texts part, paths end."""
    rows = [(k, "a b c d e f g h i j" + (" k l m n o" if k % 2 else " q r s t u"), "en", "s") for k in range(10)]
    _, counts, paths = co.graph(table(spark, rows), 2)
    got = sorted((r.path, r.edges, r.a) for r in paths.collect())
    # the node (g h i j) has two ways on
    assert got == [("a b c d e f g h i j", 6, 10), ("g h i j k l m n o", 5, 5), ("g h i j q r s t u", 5, 5)]
    assert co.phrases_of(paths).count() == 16
    assert {(r.phrase, r.a) for r in counts[1].collect()} >= {("a b", 10), ("j k", 5), ("t u", 5)}


def test_bitmaps_let_few_rare_phrases_through(spark):
    """A rare phrase that is taken for a frequent one is a row of the last pass; with one bit 1.2 in 100 were."""
    hashed = lambda low, high: spark.range(low, high).selectExpr("cast(xxhash64(id) >> 32 as int) as gram")
    frequent = hashed(0, 100_000)
    bitmap = co._bitmap(frequent).value
    of = lambda rows: np.array([r.gram for r in rows.collect()], np.int32)
    assert len(bitmap) == co.FILTER_BITS // 8 and co._in(bitmap, of(frequent)).all()
    assert co._in(bitmap, of(hashed(200_000, 400_000))).mean() < 0.002


def test_phrases_are_added_up_in_few_tasks(spark):
    """Each task of the last pass hands on most frequent phrases, so its tasks must not grow with the input."""
    many = 5 * co.WAVES * spark.sparkContext.defaultParallelism
    docs = table(spark, corpus(3, 60)).repartition(many)
    assert co._few_tasks(docs).rdd.getNumPartitions() == many // 5
    assert found(spark, corpus(3, 60), 7) == sorted(tuple(r) for r in co.collocations(docs, 7).collect())


def test_texts_are_split_in_bounded_parts(spark):
    batch = pa.record_batch({"lang": ["en"] * 40, "text": ["x" * 100_000] * 39 + [None]})
    parts = list(co._slices(iter([batch, batch.slice(0, 0)])))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) >= 4
    assert max(p.nbytes for p in parts) < 2 * co.TEXT_BYTES


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    wide = lambda c: F.lit(c).cast("decimal(18,0)")
    row = spark.range(1).select((F.lit(1000).cast("decimal(4,0)") * (wide(10 ** 15) * wide(10 ** 16))).alias("over"),
                                (wide(10 ** 15) * wide(10 ** 15)).alias("under")).selectExpr("over div under as q").first()
    assert row.q == 10_000
