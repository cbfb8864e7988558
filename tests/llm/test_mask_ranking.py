import math
import random
from collections import Counter

import pytest

from lanecost.llm import maskrank

from .helpers import odd_rows, table

TERM = maskrank._TERM_BYTES


def terms(text):
    out, now = [], b""
    for c in (text or "").encode() + b" ":
        if c in TERM:
            now += bytes([c + 32 if 65 <= c <= 90 else c])
        elif now:
            out.append(now.decode())
            now = b""
    return out


def brute(items, rows, k):
    docs = [(i, Counter(terms(t))) for i, t, _, _ in rows]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c in docs:
            m = 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def search(spark, items, rows, k):
    frame = spark.createDataFrame(items, "item_id long, text string")
    out = maskrank.search(frame, table(spark, rows), k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in out.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    pool = [f"t{int(rng.paretovariate(0.6)) % 150}" for _ in range(400)]
    return [(k, ", ".join(rng.choices(pool, k=rng.randrange(1, 60))), "en", "s") for k in range(n)]


@pytest.mark.parametrize("k", [1, 5, 50])
def test_equals_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(maskrank, "ITEMS", 4)  # several groups of items
    rows = corpus(1, 300) + [(k_ + 1000, "t1 T1 t2", "en", "s") for k_ in range(30)] + odd_rows()
    items = [(k_, " ".join(f"t{random.Random(k_).randrange(160)}" for k_ in range(70 * i, 70 * i + 3 + 9 * i))) for i, k_ in enumerate(range(12))]
    assert search(spark, items, rows, k) == brute(items, rows, k)


def test_blocks_are_scored_by_mask_and_not_whole():
    rng = random.Random(3)
    import numpy as np
    places = [np.array(sorted(rng.sample(range(2000), n))) for n in (1900, 900, 300, 20, 5)]
    impact = [np.array([rng.randrange(1, top) for _ in p], np.int64) for p, top in zip(places, (4, 30, 200, 4000, 9000), strict=True)]
    full = np.zeros(2000, np.int64)
    for p, x in zip(places, impact, strict=True):
        full[p] += x
    best = np.sort(full)[::-1][:10]
    for floor in (0, int(best[-1])):
        found, score, scored = maskrank.best_of_block(places, impact, 2000, 10, floor)
        assert (score == full[found]).all() and np.sort(score)[::-1][:10].tolist() == best.tolist()
        assert scored < 400
        assert set(np.flatnonzero(full >= best[-1])) <= set(found)  # ties at the k-th are all there


def test_more_terms_than_a_word_of_bits(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(k % 90 + 1)), "en", "s") for k in range(120)]
    items = [(7, " ".join(f"w{j}" for j in range(90))), (7, "w3"), (None, "w5 w6"), (8, None), (9, "")]
    assert search(spark, items, rows, 5) == brute([i for i in items if i[0] != 8], rows, 5)


def test_odd_rows_and_empty_tables(spark):
    items = [(1, "line One"), (2, "日本語"), (3, "--")]
    assert search(spark, items, odd_rows(), 4) == brute(items, odd_rows(), 4)
    assert search(spark, items, [], 4) == [] == search(spark, [], odd_rows(), 4)
