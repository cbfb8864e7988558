import hashlib
import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from lanecost.llm import imatch, simhash
from lanecost.llm.components import components

from .helpers import odd_rows, table, words


def bits(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    hashed = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def classes(nodes, linked):
    """Least reachable node of each node, by search from every node."""
    near = {n: [m for m in nodes if linked(n, m)] for n in nodes}
    out = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out[n] = seen
    return out


def corpus():
    rows = odd_rows()
    for k in range(30):
        own = words(k, 120 + k)
        for copy in range(1 + k % 4):
            edited = list(own)
            if copy:
                edited[copy * 7] = f"edit{copy}"
            rows.append((100 + 10 * k + copy, " ".join(edited), "en", "s"))
    rows += [(900 + k, "the very same text of a large group of copies", "en", "s") for k in range(50)]
    return rows


def test_fingerprints_and_classes(spark):
    rows = corpus()
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.digests(table(spark, rows)).collect()}
    prints = {bits(t) for _, t, _, _ in rows}
    reach = classes(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    ids = {f: [i for i, t, _, _ in rows if bits(t) == f and i is not None] for f in prints}
    want = set()
    for i, t, _, _ in rows:
        members = [m for f in reach[bits(t)] for m in ids[f]]
        want.add((i, format(bits(t), "016x"), min(members, default=None)))
    assert got == want
    assert simhash.digests(table(spark, rows)).count() == len(rows)


def test_links_lose_nothing(spark):
    rng = random.Random(2)
    start = [rng.getrandbits(64) for _ in range(40)]
    prints = set(start)
    for f in start:
        for n in (1, 2, 3, 3, 4, 5):
            prints.add(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = {f: f - (1 << 64) if f >> 63 else f for f in prints}
    frame = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    for most in (1, 3, 4):
        got = [tuple(r) for r in simhash.links(frame, most).collect()]
        want = {(min(signed[f], signed[g]), max(signed[f], signed[g])) for f in prints for g in prints
                if f != g and (f ^ g).bit_count() <= most}
        assert sorted(got) == sorted(want)


def test_probes_are_never_broadcast(spark):
    """A ball of 33 probes a fingerprint is sized as one row of it, so a small table would be sent as a large one."""
    plan = simhash.links(spark.range(50).toDF("fp"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_one_of_each(spark):
    rows = corpus()
    out = simhash.one_of_each(table(spark, rows))
    kept = Counter(r.doc_id for r in out.collect())
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size"]
    assert kept == Counter(dict(simhash.groups(table(spark, rows)).select("root", "component_id").distinct().collect()).values())
    again = [(1, "a b c d", "en", "s"), (1, "quite another text here", "en", "s"), (1, "a b c d", "en", "s")]
    assert sorted(r.text for r in simhash.one_of_each(table(spark, again)).collect()) == ["a b c d", "quite another text here"]
    assert simhash.one_of_each(table(spark, [])).count() == 0


def test_components_of_paths_stars_and_nothing(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 60)] + [(1, 1), (None, 3), (7, 6), (7, 6)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {n: r for n, r in got.items() if n != r} == {**{k: 100 for k in range(101, 161)}, **{k: 5 for k in range(6, 60)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_imatch_edits_and_equal_texts(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 7)
    rows = corpus()
    frame = imatch.digests(table(spark, rows))
    got = sorted(map(tuple, frame.select("doc_id", "n_chars", "edited_sha256").collect()), key=str)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, prints = [], {}
    for k, (i, t, _, _) in enumerate(ordered):
        text, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(text) // 4
        want.append((i, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    for r in frame.join(table(spark, rows).select("doc_id", "text"), "doc_id").collect():
        if r.text:
            prints.setdefault(r.text, set()).add(r.fingerprint)
    several = [p for t, p in prints.items() if sum(t == x[1] for x in rows) > 1 and t != "One line.\nTwo lines."]
    assert several and all(len(p) == 1 for p in several)


def test_imatch_likeness(spark):
    rows = [(k, " ".join(words(k, 300, 5000)), "en", "s") for k in range(80)] + [(100 + k, " ".join(words(7, 300, 5000)), "en", "s") for k in range(2)]
    out = {r.doc_id: r for r in imatch.compare(table(spark, rows), 0.0, 0.9).collect()}
    assert out[100].near_next == 1.0
    assert sum(r.near_edited for r in out.values()) / len(out) > 0.3
    assert sum(r.near_next for i, r in out.items() if i < 78) / 78 < 0.05


def test_imatch_marks_are_those_of_the_same_terms(spark):
    words = imatch.lexicon(spark.createDataFrame([("b a a c",), ("a b",), ("x",)], "text string"), 0.0, 1.0)
    ids = {r.id for r in spark.createDataFrame([("a",), ("b",)], "t string").select(F.xxhash64("t").alias("id")).collect()}
    assert {r.id for r in words.collect()} == ids
    texts = spark.createDataFrame([(1, "B, a! a"), (2, "a b"), (3, "zzz"), (4, ""), (5, "a")], "k int, text string")
    out = imatch.fingerprints(texts, ["k"], F.col("k"), words)
    marks = {r.carried: list(r.marks) for r in out.collect()}
    assert marks[1] == marks[2] and None not in marks[1] and set(marks[3]) == set(marks[4]) == {None}
    # a chain whose deepest sub-lexicon holds a only gives the mark of a alone
    assert any(x == y for x, y in zip(marks[1], marks[5])) and marks[1] != marks[5]


def test_imatch_empty_table(spark):
    assert imatch.digests(table(spark, [])).count() == 0
    one = imatch.digests(table(spark, [(1, "abcd efgh", "en", "s")])).select(F.col("edited_sha256"), "near_next").first()
    assert one[0] == hashlib.sha256(b"abcd efab").hexdigest()
