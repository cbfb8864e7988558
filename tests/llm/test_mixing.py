import hashlib
import re
from collections import Counter, defaultdict

from lanecost.llm.mixing import mixed, plan_mix

from .helpers import odd_rows, table, words


def fill(sizes, weights, budget, repeats):
    """Targets by sharing out again and again until none is above its limit."""
    targets, free, left = {}, dict(sizes), budget
    while True:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > repeats * sizes[s]] if total else []
        if not over:
            return targets | {s: left * weights[s] / total for s in free}
        for s in over:
            targets[s] = repeats * sizes[s]
            left -= targets[s]
            del free[s]


def brute(rows, weights=(3, 1, 2), share=1.5, repeats=2):
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, s in rows]
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    sizes = Counter({s: 0 for s in sources})
    for _, s, n in docs:
        sizes[s] += n
    budget = share * sum(sizes.values())
    queue, entries = defaultdict(list), []
    for k, (i, s, n) in enumerate(docs):
        queue[s].append((hashlib.md5(f"{'' if i is None else i}|mix".encode()).hexdigest(), n, k))
    for s, own in queue.items():
        upto = 0
        for round_ in range(repeats):
            for _, n, k in sorted(own):
                upto += n
                if n:
                    entries.append((upto / w[s], sources.index(s), round_, upto, n, k))
    taken, used = Counter(), 0
    for *_, n, k in sorted(entries):
        used += n
        if used > budget:
            break
        taken[k] += n
    targets = fill(sizes, w, budget, repeats) if budget else dict.fromkeys(sources, 0.0)
    return [(i, n, sizes[s], round(float(targets[s]), 6), taken[k]) for k, (i, s, n) in enumerate(docs)]


def check(spark, rows):
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in plan_mix(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    return got


def test_matches_brute_force(spark):
    rows = [(k, " ".join(words(k, 3 + k % 40)), "en", ["a", "b", "c", None, "e"][min(4, k % 9)]) for k in range(400)]
    got = check(spark, rows)
    by_source = defaultdict(lambda: [0, 0.0])
    for row, (_, _, _, target, taken) in zip(sorted(rows), sorted(got, key=lambda g: g[0]), strict=True):
        by_source[row[3]][0] += taken
        by_source[row[3]][1] = target
    for taken, target in by_source.values():
        assert abs(taken - target) <= 100  # about the size of two documents
    assert all(taken <= 2 * size for _, size, _, _, taken in got)


def test_many_buckets_and_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr("lanecost.llm.mixing.BUCKET_ROWS", 7)
    check(spark, [(k, " ".join(words(k, 1 + k % 30)), "en", "hot" if k % 3 else f"s{k % 10}") for k in range(300)])


def test_odd_rows_and_empty_tables(spark):
    check(spark, odd_rows())
    check(spark, [(1, "", "en", "a"), (2, None, "en", "a")])
    assert plan_mix(table(spark, [])).count() == 0
    assert mixed(table(spark, [])).count() == 0


def test_mixed_keeps_columns_and_repeats(spark):
    rows = [(k, " ".join(words(k, 20)), "en", "a" if k < 5 else "b") for k in range(60)]
    out = mixed(table(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size"]
    times = Counter(r.doc_id for r in out.collect())
    assert times == Counter({g[0]: g[4] // g[1] for g in brute(rows) if g[4]})
