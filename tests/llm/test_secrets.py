import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from lanecost.llm import secrets

from .helpers import odd_rows, table

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
RANDOM = "tR9xQ2vLm7Zk4WbN8sHdJ1yPc6Gf3EoA"
TEXTS = [
    "password = hunter22 token:abc secret:'abcdef' é API_KEY=\"Zz9+/=\"", "password: token: abcdefgh", "token=secret=abcdefg",
    "AKIA" + "B" * 16 + " AKIA123 xAKIAAKIA" + "Q" * 14, "日本 " + "0123456789abcdef" * 2 + " deadbeef" * 2, "a" * 40, "Deadbeef" + "a1" * 12,
    f"key {RANDOM} end", "0123456789abcdefghijklmnopqrstuvwxyz", "path/to/some/very/long/directory/name", f"example-{RANDOM}",
    "secret", "secret=", "secret= \n abcdefgh", "passwordpasswd:=abcdefgh", RANDOM * 40,
    f"{RANDOM}/example", f"example{RANDOM}dummy{RANDOM[::-1]}", "example/" + "dummy_" * 9, RANDOM[:14] + "example" + RANDOM[14:]]


def entropy(part):
    return -sum(n / len(part) * math.log2(n / len(part)) for n in Counter(part).values())


def brute(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    base = [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]
    for place, c in enumerate(secrets.CLASSES, 3):
        for m in re.finditer(f"[{c.characters}]+", text):
            run = m[0]
            harmless = lambda x: any(re.search(p, x) for p in secrets.HARMLESS)
            left = [x for x in re.split(secrets.HARMLESS_PARTS, run) if len(x) >= c.window and not harmless(x)]
            if len(run) >= c.least and not harmless(run) and max(
                    (entropy(x[i : i + c.window]) for x in left for i in range(len(x) - c.window + 1)), default=-1) >= c.bits - 1e-9:
                spans.append((m.start(), place, m.end(), c.kind))
    return base, [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]


def test_matches_brute_force(spark):
    rows = [*odd_rows(), *[(50 + k, t, "en", "s") for k, t in enumerate(TEXTS)]]
    got = {(r.doc_id, r.spans, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secrets.digests(table(spark, rows)).collect()}
    want = set()
    for i, t, _, _ in rows:
        base, spans = brute(t or "")
        count = Counter(x.split(":")[0] for x in base)
        want.add((i, ",".join(spans), hashlib.sha256(",".join(base).encode()).hexdigest(), count["assign"], count["access"], count["hex"]))
    assert got == want
    assert any("entropy_base64" in g[1] for g in got)
    # a secret glued to a harmless word is found, the word by itself is not
    spans = {TEXTS[i - 50]: s for i, s, *_ in got if i and i >= 50}
    assert spans[f"{RANDOM}/example"] == f"entropy_base64:0:{len(RANDOM) + 8}" and spans["example/" + "dummy_" * 9] == ""


def test_rows_and_columns_stay(spark):
    out = secrets.scan(table(spark, odd_rows()))
    assert out.count() == len(odd_rows()) and out.columns[-1] == "secrets" and "size" in out.columns
    assert secrets.scan(table(spark, [])).count() == 0


def test_windows_slide_over_section_edges(spark):
    flat, noisy = "ab" * 245, RANDOM[:24]
    texts = [flat + noisy + flat, flat[:-7] + noisy, noisy + flat * 3]
    frame = spark.createDataFrame([(t,) for t in texts], "found string")
    got = [r[0] for r in frame.select(secrets.peak_entropy(F.col("found"), 24)).collect()]
    for t, bits in zip(texts, got, strict=True):
        assert abs(bits - max(entropy(t[i : i + 24]) for i in range(len(t) - 23))) < 1e-9
