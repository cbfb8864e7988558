"""Registered queries of the corpus operators, with oracle SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chosenpaths, collocations, imatch, kdsearch, langid, linededup, maskrank, mixing, secrets, simhash, suffixdedup, tokencount

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL if there is any."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_line_dedup", linededup.oracle(0.03, 5))
def line_dedup(spark, sf_dir):
    return linededup.drop_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text")).drop("source")


@query("op2_source_mixing", mixing.ORACLE)
def source_mixing(spark, sf_dir):
    return mixing.plan_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_token_counts")
def token_counts(spark, sf_dir):
    return tokencount.attribute_tokens(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        fields=("source", "lang", "text"), lines_of=("text",))


@query("op4_imatch")
def imatch_fingerprints(spark, sf_dir):
    return imatch.digests(documents(spark, sf_dir))


@query("op5_kd_search", kdsearch.ORACLE)
def kd_search(spark, sf_dir):
    vectors = kdsearch.scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return kdsearch.top_k(vectors, vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"))


@query("op6_language_id")
def language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(langid.learnable(F.col("doc_id"))))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (~langid.learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")


@query("op7_secret_scan")
def secret_scan(spark, sf_dir):
    return secrets.digests(documents(spark, sf_dir))


@query("op8_byte_bpe")
def byte_bpe(spark, sf_dir):
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                       public_tokenizers.PATTERN)


@query("op9_simhash")
def simhash_groups(spark, sf_dir):
    return simhash.digests(documents(spark, sf_dir))


@query("op10_suffix_dedup")
def suffix_dedup(spark, sf_dir):
    return suffixdedup.digests(documents(spark, sf_dir), shown=True)


@query("op11_mask_ranking", maskrank.ORACLE)
def mask_ranking(spark, sf_dir):
    return maskrank.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))


@query("op12_collocations", collocations.oracle(100, 2000))
def phrase_collocations(spark, sf_dir):
    return collocations.collocations(documents(spark, sf_dir))


@query("op13_chosen_paths", chosenpaths.ORACLE)
def chosen_path_groups(spark, sf_dir):
    return chosenpaths.groups(documents(spark, sf_dir))
