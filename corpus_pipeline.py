"""The corpus pipeline: stages that call the operators, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqharbor.llm import decontaminate, lines, near_copies, pieces, toxicity
from seqharbor.llm.common import free_prefix, materialize, table

REJECTED = 0.5
NEAR_WORDS = 5


def _measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``n_chars`` follows a text that a stage has changed."""
    return docs.withColumn("n_chars", F.length(text).cast("bigint")) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; nulls and empty texts are scored like any other."""
    names = free_prefix(docs, "tox_")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), names=names)
    return scored.filter(F.col(f"{names}score") < REJECTED).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines; one that loses all of them stays empty."""
    names = free_prefix(docs, "ld_")
    kept = lines.drop_boilerplate(docs, names=names)
    new = kept.withColumn("text", F.col(f"{names}text")).select(*[F.col(f"`{c}`") for c in docs.columns])
    return _measured(new)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id.

    Copies are linked by an exact Jaccard similarity of 0.8 or more of their five-word shingles. A row
    without an id comes after all others, so it stays only for a group in which no row has one. Rows
    are told apart by number: of repeated rows one stays, and of rows with one id and near texts too.
    """
    return near_copies.first_of_each(docs, NEAR_WORDS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that benchmark windows cover."""
    return _measured(decontaminate.remove_passages(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left."""
    return pieces.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("sentencepiece", encode),
]
#: Learned scores, fingerprint groups and piece ids have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
