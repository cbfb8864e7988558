import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lanecost.llm import bpe
from lanecost.llm.tokencount import RULES, attribute_tokens

from .helpers import odd_rows, table

PATTERN = public_tokenizers.PATTERN
TEXTS = [
    "Hello world, it's  2  spaces\n\n and\tTabs \n x", "a" * 500, "ab" * 700, "日本語" * 90, "é\x1c \x85z　 q", " ", "  ", "\n \n",
    "don't can't I'll", "<|endoftext|>", "\U0001f600 \U0001f600", "x " * 50 + " ", "".join(chr(0x300 + k % 80) for k in range(300))]


def encoder(name):
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    more = ["".join(rng.choice("ab1 .\n\t'séß　") for _ in range(rng.randrange(60))) for _ in range(200)]
    return [*odd_rows(), *[(100 + k, t, "en", "s") for k, t in enumerate([*TEXTS, *more])]]


def test_bpe_equals_the_library(spark, rows):
    own = encoder("byte_bpe_multi_50k.tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.decode(bpe.encode(table(spark, rows), path, PATTERN), path)
    want = sorted(((i, t, own.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in rows), key=str)
    got = sorted(((r.doc_id, r.text, list(r.token_ids), bytes(r.decoded)) for r in out.collect()), key=str)
    assert got == want
    assert {"size", "lang", "n_chars"} <= set(out.columns)


def test_bpe_digests(spark, rows):
    own = encoder("byte_bpe_multi_50k.tiktoken")
    got = bpe.digests(table(spark, rows), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), PATTERN).collect()
    want = []
    for i, t, _, _ in rows:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_bpe_small_parts_and_forgetting(monkeypatch, rows):
    own = encoder("byte_bpe_multi_50k.tiktoken")
    for name, value in (("PIECES", 3), ("REMEMBERED", 5), ("CELLS", 256), ("LONG", 16)):
        monkeypatch.setattr(bpe, name, value)
    texts = [t for _, t, _, _ in rows if t is None or len(t) < 3000]
    ids, counts = bpe.encode_texts(texts, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), PATTERN)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert ids[at : at + n].tolist() == own.encode_ordinary(text or "")
        at += n


def test_bpe_empty_table(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.digests(table(spark, []), path, PATTERN).count() == 0


def brute_sections(own, row, rule):
    """Token by token and byte by byte."""
    i, text, lang, source = row
    parts = [("source", 0, source or ""), ("lang", 0, lang or "")] + [("text", k, p) for k, p in enumerate((text or "").split("\n"))]
    owner = [k for k, (_, _, p) in enumerate(parts) for _ in range(len(p.encode()) + 1)]
    tokens, crossing, at = [0] * len(parts), [0] * len(parts), 0
    for token in own.encode_ordinary("\n".join(p for _, _, p in parts) + "\n"):
        held = owner[at : at + len(own.decode_single_token_bytes(token))]
        at += len(held)
        k = {"start": held[0], "end": held[-1], "most": max(sorted(set(held)), key=held.count)}[rule]
        tokens[k] += 1
        crossing[k] += held[0] != held[-1]
    start, out = 0, []
    for k, (field, section, p) in enumerate(parts):
        out.append((i, field, section, start, start + len(p) + 1, tokens[k], crossing[k]))
        start += len(p) + 1
    return out


@pytest.mark.parametrize("rule", RULES)
def test_attribution(spark, rows, rule):
    own = encoder("byte_bpe_50k.tiktoken")
    some = [r for r in rows if r[1] is None or len(r[1]) < 3000]
    out = attribute_tokens(table(spark, some), public_tokenizers.path("byte_bpe_50k.tiktoken"), PATTERN,
                           ("source", "lang", "text"), ("text",), rule=rule)
    want = [s for r in some for s in brute_sections(own, r, rule)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_attribution_long_text_and_empty_table(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    long = [r for r in odd_rows() if r[0] == 5]
    out = attribute_tokens(table(spark, long), path, PATTERN, ("text",))
    assert out.first().n_tokens == len(encoder("byte_bpe_50k.tiktoken").encode_ordinary(long[0][1] + "\n"))
    assert attribute_tokens(table(spark, []), path, PATTERN, ("text",)).count() == 0
