import hashlib
import random
from collections import Counter

import pytest

from lanecost.llm import suffixdedup as sd

from .helpers import odd_rows, table


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t, _, _ in rows]
    found = Counter(d[x : x + length] for _, d in data for x in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for x in range(len(d) - length + 1):
            if found[d[x : x + length]] > 1:
                gone[x : x + length] = b"\1" * length
        spans = []
        for x in range(len(d)):
            if gone[x] and (not x or not gone[x - 1]):
                spans.append([x, x])
            if gone[x]:
                spans[-1][1] = x + 1
        out.append((i, len(d), [tuple(s) for s in spans], bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return sorted(out, key=str)


def check(spark, rows, length, seed):
    out = sd.remove_repeats(table(spark, rows), length=length, seed=seed)
    got = [(r.doc_id, r.n_bytes, [(s.begin, s.end) for s in r.spans], bytes(r.kept)) for r in out.collect()]
    assert sorted(got, key=str) == brute(rows, length)


def passages(seed, n):
    """Texts over few letters with shared, shifted and overlapping passages, and periods."""
    rng = random.Random(seed)
    draw = lambda n, letters="abcdé ": "".join(rng.choice(letters) for _ in range(n))
    pool = [draw(rng.randrange(20, 160)) for _ in range(8)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            kind = rng.randrange(4)
            if kind == 0:
                parts.append(draw(rng.randrange(60)))
            elif kind == 1:
                p = rng.choice(pool)
                a = rng.randrange(len(p))
                parts.append(p[a : a + rng.randrange(20, 160)])
            elif kind == 2:
                parts.append(rng.choice(pool))
            else:
                parts.append(draw(rng.randrange(1, 6)) * rng.randrange(30))
        rows.append((k, "".join(parts), "en", "s"))
    return rows


@pytest.mark.parametrize("seed, length, word", [(1, 40, 8), (2, 40, 16), (3, 64, 32)])
def test_matches_brute_force(spark, seed, length, word):
    check(spark, passages(seed, 60), length, word)


def test_odd_rows_copies_and_empty_table(spark):
    check(spark, odd_rows()[:6] + odd_rows()[7:] + [(k, "group of copies " * 4, "en", "s") for k in range(200, 260)], 40, 8)
    assert sd.remove_repeats(table(spark, [])).count() == 0


def test_anchors_across_windows(monkeypatch):
    data = passages(5, 40)
    text = "".join(t for _, t, _, _ in data).encode()
    whole = [x.tolist() for x in sd.anchors(text, 40, 8)]
    monkeypatch.setattr(sd, "WINDOW", 50)
    assert [x.tolist() for x in sd.anchors(text, 40, 8)] == whole
    place, first, last = whole
    assert first[0] == 0 and last[-1] == len(text) - 40 and all(b == e + 1 for b, e in zip(first[1:], last[:-1], strict=True))
    assert all(a >= e and a + 8 <= f + 40 for a, f, e in zip(place, first, last, strict=True))


def test_digests(spark):
    text = "".join(random.Random(4).choice("abcdef ") for _ in range(900))
    rows = [(1, text[:600], "en", "s"), (2, "x" + text[:500], "en", "s"), (3, text[450:], "en", "s"), (4, None, None, None)]
    got = sorted(map(tuple, sd.digests(table(spark, rows)).collect()))
    want = [(i, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in brute(rows, 400)]
    assert got == sorted(want)


def test_query_shows_the_remaining_text(spark, tmp_path):
    """Sizes and digests don't tell what was removed; the query also returns what is left."""
    from lanecost.llm.queries import QUERIES

    passage = "".join(random.Random(4).choice("abcdef ") for _ in range(450))
    rows = [(1, "one " + passage + " é end", "en", "s"), (2, "other " + passage, "en", "s"), (3, "alone", "en", "s"), (4, None, "en", "s"),
            (5, "à" + "x" * 399, "en", "s"), (6, "á" + "x" * 399, "en", "s"), (7, "\u0420" + "x" * 399, "en", "s")]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op10_suffix_dedup"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    got = {r.doc_id: r for r in out.collect()}
    kept = {i: k for i, _, _, k in brute(rows, 400)}
    assert {i: r.text for i, r in got.items()} == {i: k.decode(errors="replace") for i, k in kept.items()}
    assert got[1].text == "one é end" and got[2].text == "other" and got[4].text == "" and got[5].text == "\ufffd"
