import random

import numpy as np
import pyarrow as pa

from lanecost.llm import chosenpaths as cp

from .helpers import odd_rows, table, words


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def brute(rows):
    """Union-find over all pairs."""
    sets = [shingles(t) for _, t, _, _ in rows]
    root = list(range(len(rows)))

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared) and shared:
                root[of(a)] = of(b)
    least = {}
    for k, (i, _, _, _) in enumerate(rows):
        if i is not None:
            least[of(k)] = min(i, least.get(of(k), i))
    out = []
    for k, (i, _, _, _) in enumerate(rows):
        c = least.get(of(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


def groups(spark, rows):
    out = cp.groups(table(spark, rows))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def edited(own, seed, n):
    rng, out = random.Random(seed), list(own)
    for k in range(n):
        out[rng.randrange(len(out))] = f"edit{seed}{k}"
    return " ".join(out)


def corpus():
    rows = [(500 + k, " ".join(words(k, 30 + k % 90, 60)), "en", "s") for k in range(150)]
    for k in range(30):
        own = words(f"base{k}", 60 + 7 * k)
        rows += [(10 * k + c, edited(own, f"{k}c{c}", c * (1 + k // 6)), "en", "s") for c in range(5)]
    return rows + [(900 + k, rows[3][1], "en", "s") for k in range(4)]


def test_equals_brute_force(spark):
    rows = corpus() + odd_rows()
    got = groups(spark, rows)
    assert got == brute(rows)
    assert 20 < len({c for _, _, c, _ in got if c is not None and c < 300}) < 140


def test_large_group_of_near_copies_is_not_torn(spark, monkeypatch):
    """More near copies than a leaf holds, and strangers that share their frequent shingles."""
    base = words("hot", 120, 4_000)
    rows = [(k, edited(base, k, 1 + k % 9), "en", "s") for k in range(400)]
    rows += [(1000 + k, " ".join(base[: 20 + k % 60] + words(k, 60)), "en", "s") for k in range(60)]
    monkeypatch.setattr(cp, "HOT", 100)
    assert groups(spark, rows) == brute(rows)


def test_a_chain_is_one_component(spark):
    base = words(3, 100)
    rows = [(k, " ".join([f"e{k}x{i}" for i in range(3 * k)] + base[3 * k :]), "en", "s") for k in range(12)]
    got = groups(spark, rows)
    assert got == brute(rows) and len({c for _, _, c, _ in got}) < 12


def test_sets_are_those_of_the_texts():
    texts = ["A a A a", "one", None, "", " \x0b ", "x y z", "One", "é É"]
    hashed, bounds = cp.shingle_sets(pa.array(texts))
    assert np.diff(bounds).tolist() == [len(shingles(t)) if t != "é É" else 1 for t in texts]
    sets = [frozenset(hashed[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert sets[1] == sets[6] and len({s for s in sets if s}) == 4


def test_empty_table(spark):
    assert groups(spark, []) == [] and len(groups(spark, [(1, None, None, None), (2, "", "x", "y")])) == 2


def test_fine_sketches_agree_as_often_as_the_sets_are_alike():
    texts = [" ".join(words("fine", 300)), edited(words("fine", 300), "a", 12), edited(words("fine", 300), "b", 60), ""]
    hashed, bounds = cp.shingle_sets(pa.array(texts))
    made = [np.frombuffer(x, np.uint8) if x else None for x in cp._fine_rows(hashed, bounds).to_pylist()]
    assert made[3] is None and len(made[0]) == cp.FINE
    agree = lambda a, b: int((made[a] == made[b]).sum())
    for other in (1, 2):
        a, b = shingles(texts[0]), shingles(texts[other])
        like = len(a & b) / len(a | b)
        assert abs(agree(0, other) - cp.FINE * like) < 60 and (agree(0, other) >= cp.FINELY) == (like >= 0.8)


def test_second_pass_links_across_components_of_a_node(spark, monkeypatch):
    """Two groups of near copies, linked only by one text of each, in nodes that hold them all."""
    base = words("pass", 200)
    rows = [(k, edited(base, f"u{k % 2}v{k}", 4 + k % 12), "en", "s") for k in range(120)]
    monkeypatch.setattr(cp, "LEAF", 8)
    monkeypatch.setattr(cp, "MINORS", 4)
    assert groups(spark, rows) == brute(rows)
