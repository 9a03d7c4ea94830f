"""Folds to chunk probabilities, chunks to calls, chunks to genomes, reports.

Fold is a column. Every combination is a grouped sum with partial aggregation, so neither many
folds nor one genome with very many chunks needs a group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import CHUNK_DOMAIN_COLUMNS, GENOME_COLUMNS, LABEL_RENAMES, UNASSIGNED
from ..functions.scalars import first_argmax, largest, round_half_even, total
from ..functions.vectors import entries, names, pack, with_entries, with_softmax
from ..sources.models import Calibration
from .calibration import DIGITS, calibrate
from .sequences import genome_id

MODES = ("logit", "probability", "entropy")


def label_list(mapping: dict[int, str], num_classes: int | None = None) -> list[str]:
    """Class names by index, renamed for display; an unnamed class is ``class_{i}``."""
    size = num_classes if num_classes is not None else len(mapping)
    return [
        LABEL_RENAMES.get(mapping[i], mapping[i]) if i in mapping else f"class_{i}"
        for i in range(size)
    ]


def prokaryote_index(labels: list[str]) -> int | None:
    return next((i for i, name in enumerate(labels) if "prokaryote" in name.lower()), None)


# --- folds to chunks --------------------------------------------------------------------------


def _chunk_keys(scores: DataFrame, length: str) -> list[str]:
    """A chunk's own columns: they go along through the fold mean."""
    return ["accession", length, *(["genome"] if "genome" in scores.columns else [])]


def _fold_mean(scores: DataFrame, vector: str, num_classes: int, length: str) -> DataFrame:
    means = [F.avg(v).alias(f"_a{i}") for i, v in enumerate(entries(vector, num_classes))]
    return scores.groupBy(*_chunk_keys(scores, length)).agg(*means)


def ensemble_logit(
    scores: DataFrame,
    calibration: Calibration,
    num_classes: int,
    logits: str = "logits",
    length: str = "chunk_len",
) -> DataFrame:
    """Mean of the folds' scores, then calibration."""
    mean = pack(_fold_mean(scores, logits, num_classes, length), "a", num_classes, "logits")
    return calibrate(mean, calibration, num_classes, "logits", length).drop("logits")


def ensemble_probability(
    fold_probs: DataFrame, num_classes: int, length: str = "chunk_len"
) -> DataFrame:
    """Mean of the folds' calibrated (rounded) probabilities, rounded."""
    mean = _fold_mean(fold_probs, "probs", num_classes, length)
    mean = with_entries(
        mean, "a", [round_half_even(F.col(c), DIGITS) for c in names("a", num_classes)]
    )
    return pack(mean, "a", num_classes, "probs")


def ensemble_entropy(
    fold_probs: DataFrame, num_classes: int, length: str = "chunk_len"
) -> DataFrame:
    """Mean of the folds' calibrated probabilities weighted by inverse entropy, rounded."""
    p = entries("probs", num_classes)
    weighed = fold_probs.withColumn(
        "_w", F.lit(1.0) / (-total([v * F.log(v + F.lit(1e-9)) for v in p]) + F.lit(1e-4))
    )
    sums = [F.sum(F.col("_w") * v).alias(f"_a{i}") for i, v in enumerate(p)]
    grouped = weighed.groupBy(*_chunk_keys(fold_probs, length)).agg(
        F.sum("_w").alias("_sum"), *sums
    )
    grouped = with_entries(
        grouped,
        "a",
        [round_half_even(F.col(c) / F.col("_sum"), DIGITS) for c in names("a", num_classes)],
    )
    return pack(grouped.drop("_sum"), "a", num_classes, "probs")


def combine_folds(
    scores: DataFrame, calibration: Calibration, num_classes: int, mode: str = "logit"
) -> DataFrame:
    """``(accession, chunk_len, probs)`` from fold scores, by the chosen mode."""
    if mode not in MODES:
        raise ValueError(f"unknown aggregation mode: {mode}")
    if mode == "logit":
        return ensemble_logit(scores, calibration, num_classes)
    calibrated = calibrate(scores, calibration, num_classes)
    combine = ensemble_probability if mode == "probability" else ensemble_entropy
    return combine(calibrated, num_classes)


# --- calls ------------------------------------------------------------------------------------


def call_class(
    df: DataFrame, labels: list[str], probs: str = "probs", digits: int | None = None
) -> DataFrame:
    """Add ``predicted_host`` (first maximum) and ``confidence`` (the maximum)."""
    p = entries(probs, len(labels))
    top = largest(p)
    return df.withColumns(
        {
            "_call": first_argmax(p),
            "confidence": top if digits is None else round_half_even(top, digits),
        }
    ).withColumn("predicted_host", F.element_at(F.array(*[F.lit(n) for n in labels]), F.col("_call") + 1)).drop("_call")


def resolve_conflict(df: DataFrame, labels: list[str], probs: str = "probs") -> DataFrame:
    """Add ``chunk_weight`` and blank the call of a row that is called prokaryote while the other
    classes together outweigh it: host ``Unassigned``, no confidence."""
    weighed = df.withColumn("chunk_weight", largest(entries(probs, len(labels))))
    at = prokaryote_index(labels)
    if at is None:
        return weighed
    p = F.col(probs)[at]
    conflict = (first_argmax(entries(probs, len(labels))) == at) & (1.0 - p > p)
    return weighed.withColumn("_conflict", conflict).withColumns(
        {
            "predicted_host": F.when(F.col("_conflict"), UNASSIGNED).otherwise(
                F.col("predicted_host")
            ),
            "confidence": F.when(~F.col("_conflict"), F.col("confidence")),
        }
    ).drop("_conflict")


def domain_call(df: DataFrame, labels: list[str], probs: str = "probs") -> DataFrame:
    """Add domain scores and the domain call; nothing when no class is a prokaryote."""
    at = prokaryote_index(labels)
    if at is None:
        return df
    p = F.col(probs)[at]
    return df.withColumns(
        {
            "prokaryote_score": round_half_even(p, DIGITS),
            "eukaryote_score": round_half_even(1.0 - p, DIGITS),
            "predicted_domain": F.when(p >= 0.5, "Prokaryote").otherwise("Eukaryote"),
            "domain_confidence": round_half_even(F.when(p >= 0.5, p).otherwise(1.0 - p), DIGITS),
        }
    )


def call_chunks(chunk_probs: DataFrame, labels: list[str]) -> DataFrame:
    """All calls of a chunk, with ``chunk_weight`` kept for the genome roll-up."""
    return domain_call(resolve_conflict(call_class(chunk_probs, labels), labels), labels)


def genome_consensus(
    chunk_probs: DataFrame, labels: list[str], ordered: bool = True
) -> DataFrame:
    """One call per genome: class probabilities averaged over its chunks, weighted by each chunk's
    highest probability.

    ``chunk_probs(accession, probs)``; the genome is the carried ``genome`` column or, without
    one, the accession less its chunk suffix. One partially aggregated group-by.
    """
    size = len(labels)
    p = entries("probs", size)
    genome = F.col("genome") if "genome" in chunk_probs.columns else genome_id("accession")
    weighed = chunk_probs.select(genome.alias("genome"), "probs", largest(p).alias("_w"))
    grouped = weighed.groupBy("genome").agg(
        F.sum("_w").alias("_sum"),
        *[F.sum(v * F.col("_w")).alias(f"_a{i}") for i, v in enumerate(p)],
    )
    grouped = with_entries(
        grouped, "a", [F.col(c) / F.col("_sum") for c in names("a", size)]
    )
    mean = pack(grouped.drop("_sum"), "a", size, "probs")
    called = domain_call(resolve_conflict(call_class(mean, labels), labels), labels)
    report = called.withColumn("confidence", round_half_even(F.col("confidence"), DIGITS)).select(
        *[c for c in GENOME_COLUMNS if c in called.columns]
    )
    return report.orderBy("genome") if ordered else report


# --- reports ----------------------------------------------------------------------------------


def _class_columns(labels: list[str], probs: str = "probs", prefix: str = "") -> list[Column]:
    return [F.col(probs)[i].alias(f"{prefix}{name}") for i, name in enumerate(labels)]


def fold_report(fold_probs: DataFrame, labels: list[str]) -> DataFrame:
    """Calibrated predictions per fold. The conflict rule does not apply here."""
    alpha = F.col("alpha") if "alpha" in fold_probs.columns else F.lit(None).cast("double")
    called = call_class(fold_probs, labels)
    return called.select(
        "accession",
        "fold",
        "predicted_host",
        round_half_even(F.col("confidence"), DIGITS).alias("confidence"),
        round_half_even(F.when(~F.isnan(alpha), alpha), DIGITS).alias("glm_gate_weight"),
        *_class_columns(labels),
    )


def model_scores_report(fold_probs: DataFrame, labels: list[str]) -> DataFrame:
    """The fold report with each stream's probabilities.

    Uses ``logits`` (mixture), ``tree_probs`` when present, ``model_logits`` when present,
    ``n_genes``.
    """
    size = len(labels)
    df = fold_probs
    shown: list[Column] = []

    def rounded_softmax(source: str, prefix: str) -> None:
        nonlocal df
        df = with_softmax(df, entries(source, size), prefix)

    if "tree_probs" in df.columns:
        shown += [
            round_half_even(v, DIGITS).alias(f"xgb_{n}")
            for v, n in zip(entries("tree_probs", size), labels)
        ]
    if "model_logits" in df.columns:
        rounded_softmax("model_logits", "g")
        shown += [
            round_half_even(F.col(c), DIGITS).alias(f"glm_{n}")
            for c, n in zip(names("g", size), labels)
        ]
    rounded_softmax("logits", "u")
    shown += [
        round_half_even(F.col(c), DIGITS).alias(f"uncalibrated_ensemble_{n}")
        for c, n in zip(names("u", size), labels)
    ]
    alpha = F.col("alpha") if "alpha" in df.columns else F.lit(None).cast("double")
    return call_class(df, labels).select(
        "accession",
        "fold",
        "n_genes",
        "predicted_host",
        "confidence",
        round_half_even(F.when(~F.isnan(alpha), alpha), DIGITS).alias("glm_gate_weight"),
        *_class_columns(labels),
        *shown,
    )


def chunk_report(called: DataFrame, labels: list[str], ordered: bool = True) -> DataFrame:
    """Chunk predictions, without the internal weight."""
    report = called.select(
        "accession",
        "predicted_host",
        "confidence",
        *_class_columns(labels),
        *[c for c in CHUNK_DOMAIN_COLUMNS if c in called.columns],
    )
    return report.orderBy("accession") if ordered else report


def features_report(union: DataFrame, first_fold: str) -> DataFrame:
    """The model inputs of the first fold."""
    return union.where(F.col("fold") == first_fold).drop("fold")
