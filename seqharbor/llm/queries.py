"""The registered queries of the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import context_trees, decontaminate, embeddings, licenses, lines, oracles, periods, pieces, ranked, simhash, substrings, token_counts, toxicity, urls
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), words=3, budget=2)


@query(oracles.DECONTAMINATE)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query(oracles.URLS)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query(oracles.LINES)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_boilerplate(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_dropped").alias("n_dropped"), F.col("ld_text").alias("text")
    )


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_trees.score_texts(table(spark, sf_dir, "documents"))


@query(oracles.SUBSTRINGS)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed_words(table(spark, sf_dir, "documents"))


@query(oracles.LICENSES)
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(oracles.RANKED)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periods.with_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periods.run_digest(periods.find_runs(docs))
