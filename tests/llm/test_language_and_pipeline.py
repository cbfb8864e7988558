import random
import zlib
from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lanecost.llm import langid
from lanecost.llm.queries import QUERIES

from . import test_line_dedup, test_mixing
from .helpers import odd_rows, table
from .test_near_copies import bits, classes
from .test_near_copies_by_shingles import jaccard
from .test_tokens import encoder

SYLLABLES = {"aa": ["tha", "ing", "ou", "st", "er"], "bb": ["ción", "os", "ar", "lle", "aña"], "cc": ["sch", "ung", "ei", "ver", "ß"]}


def prose(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus():
    rows = [(k, prose(lang, k, 20 + k % 50), lang, f"s{k % 3}") for k, lang in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(501 + k, "1234 !!", "aa", "s1") for k in range(3)] + [(600, prose("bb", 1, 40), None, "s1")]
    rows += [(700 + k, rows[5][1], "cc", "s2") for k in range(4)]
    for copy in range(3):  # edited copies of a longer text, alike by five-word shingles but not by fingerprint bits
        words = prose("aa", "edited", 90).split()
        words[20:20 + copy] = [f"edit{copy}"] * copy
        rows.append((800 + copy, " ".join(words), "aa", "s1"))
    return [(i, t if i % 4 else t + "\nsame footer", lang, s) for i, t, lang, s in rows]


def test_held_out_accuracy_and_bounds(spark):
    docs = table(spark, corpus())
    model = langid.fit(docs.where(langid.learnable(F.col("doc_id"))), passages=10, passage_chars=100)
    assert sorted(model) == ["aa", "bb", "cc"] and all(len(d) <= 10 * 210 for d in model.values())
    out = langid.predict(docs, model)
    rows = out.where(~langid.learnable(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("doc_id") < 500)).collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert {r.lang_pred for r in out.where("doc_id between 501 and 503").collect()} == {"und"}
    assert out.columns[:6] == docs.columns


def test_held_out_rows_are_those_of_the_contract(spark):
    ids = spark.range(200).select(langid.learnable(F.col("id")).alias("fit"), "id").collect()
    assert all(r.fit == (zlib.crc32(str(r.id).encode()) % 4 != 2) for r in ids)


def test_odd_rows_ties_and_empty_tables(spark):
    docs = table(spark, odd_rows())
    model = langid.fit(docs)
    out = {(r.doc_id, r.lang_pred, r.rejected) for r in langid.predict(docs, model).collect()}
    assert {(2, "und", True), (3, "und", True), (4, "und", True)} <= out
    assert langid.fit(table(spark, [])) == {}
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}
    assert langid.judge("abc", (("x", b"same words here"), ("y", b"same words here")), 0.003) == ("x", 0.0, True)
    assert langid.judge("abc", (("x", b"words"),), 0.003) == ("x", 1.0, False)
    assert langid.predict(table(spark, []), model).count() == 0


def test_blocks_add_up():
    import zstandard
    c = zstandard.ZstdCompressor(level=langid.LEVEL)
    text = prose("aa", 3, 2000)
    parts = [text.encode()[i : i + langid.BLOCK] for i in range(0, len(text.encode()), langid.BLOCK)]
    assert len(parts) > 3 and langid.sizes(text, [c]) == [sum(len(c.compress(p)) for p in parts)]


def brute_pipeline(spark, rows):
    """The stages after one another with plain Python; the language model is the fitted one."""
    model = tuple(sorted(langid.fit(table(spark, rows)).items()))
    rows = [(i, t, lang, s) for i, t, lang, s in rows if not langid.judge(t, model, 0.003)[2]]
    texts = test_line_dedup.brute(rows, 0.03, 5)
    rows = [(i, t, lang, s) for (i, _, lang, s), (_, t, _, _) in zip(rows, texts, strict=True)]
    reach = classes({t for _, t, _, _ in rows}, lambda a, b: jaccard(a, b) >= 0.8)
    rows = [r for r in rows if r[0] == min(i for i, t, _, _ in rows if t in reach[r[1]])]
    own: tiktoken.Encoding = encoder("byte_bpe_multi_50k.tiktoken")
    out = Counter()
    for (i, t, _, s), (_, size, _, _, taken) in zip(rows, test_mixing.brute(rows), strict=True):
        if taken:
            out[i, s, tuple(own.encode_ordinary(t))] += taken // size
    return out


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = corpus()
    table(spark, rows).drop("size").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {i: t for i, t, _, _ in rows}
    assert jaccard(texts[800], texts[802]) >= 0.8 and (bits(texts[800]) ^ bits(texts[802])).bit_count() > 3
    assert len({r.doc_id for r in out} & {800, 801, 802}) <= 1
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in out)
    assert Counter((r.doc_id, r.source, tuple(r.token_ids)) for r in out) == brute_pipeline(spark, rows)


def test_stages_keep_columns_and_survive_odd_rows(spark):
    docs = table(spark, odd_rows())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert stage(spark, table(spark, []), "").count() == 0
        out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(odd_rows())


def test_queries_registered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    assert public_tokenizers.PATTERN


def test_one_copy_of_each_story_stays(spark, tmp_path):
    """Two stories of six copies in a source of a hundred pages: neither is taken for boilerplate."""
    rows = [(k, prose("aa", k, 40), "aa", "s") for k in range(100)]
    rows += [(200 + k, prose("aa", f"story{k // 6}", 60) + "\n" + prose("aa", f"end{k // 6}", 20), "aa", "s") for k in range(12)]
    table(spark, rows).drop("size").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, str(tmp_path))
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert {i for i in kept if i >= 200} == {200, 206} and kept[206] == rows[106][1]
