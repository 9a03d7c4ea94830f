"""Class scores to calibrated probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import clamp, first_argmax, round_half_even, sigmoid, total
from ..functions.vectors import entries, names, pack, with_entries, with_softmax
from ..sources.models import Calibration, Posthoc

DIGITS = 4


def softmax(df: DataFrame, num_classes: int, logits: str = "logits", out: str = "probs") -> DataFrame:
    """Stable softmax, rounded to 4 digits."""
    soft = with_softmax(df, entries(logits, num_classes), "p")
    soft = with_entries(
        soft, "p", [round_half_even(F.col(c), DIGITS) for c in names("p", num_classes)]
    )
    return pack(soft, "p", num_classes, out)


def _log_length(length: str, scale: float) -> Column:
    return F.log(clamp(F.col(length).cast("double"), low=1e-6) / F.lit(float(scale)))


def _temperature(w0: float, w1: float, log_length: Column) -> Column:
    return F.exp(F.lit(float(w0)) + F.lit(float(w1)) * log_length)


def _vector_scaled(
    df: DataFrame, calibration: Calibration, num_classes: int, logits: str, length: str
) -> DataFrame:
    df = df.withColumn("_ln", _log_length(length, calibration.length_scale))
    scaled = [
        logit / _temperature(w0, w1, F.col("_ln"))
        for logit, (w0, w1) in zip(entries(logits, num_classes), calibration.weights(num_classes))
    ]
    return with_softmax(df, scaled, "p")


def _posthoc(df: DataFrame, rule: Posthoc, num_classes: int) -> DataFrame:
    """Re-scale the target class where it is the top class; the others share what is left."""
    probs = [F.col(c) for c in names("p", num_classes)]
    df = df.withColumn("_hit", first_argmax(probs) == rule.target_class)
    df = df.withColumn("_t", clamp(probs[rule.target_class], 1e-7, 1.0 - 1e-7))
    heat = _temperature(rule.w0, rule.w1, F.col("_ln"))
    df = df.withColumn("_tc", sigmoid(F.log(F.col("_t") / (1.0 - F.col("_t"))) / heat))
    rest = clamp(1.0 - F.col("_tc"), low=0.0) / clamp(1.0 - F.col("_t"), low=1e-8)
    df = df.withColumn("_rest", rest)
    df = with_entries(
        df,
        "q",
        [
            F.col("_tc") if i == rule.target_class else p * F.col("_rest")
            for i, p in enumerate(probs)
        ],
    )
    df = df.withColumn("_sum", total([F.col(c) for c in names("q", num_classes)]))
    df = with_entries(
        df,
        "p",
        [
            F.when(F.col("_hit"), F.col(q) / F.col("_sum")).otherwise(p)
            for p, q in zip(probs, names("q", num_classes))
        ],
    )
    return df.drop("_hit", "_t", "_tc", "_rest", "_sum", *names("q", num_classes))


def vector_scaling(
    df: DataFrame,
    calibration: Calibration,
    num_classes: int,
    logits: str = "logits",
    length: str = "chunk_len",
    out: str = "probs",
) -> DataFrame:
    """Length-aware temperature per class, then softmax. Not rounded."""
    scaled = _vector_scaled(df, calibration, num_classes, logits, length)
    return pack(scaled.drop("_ln"), "p", num_classes, out)


def posthoc_top_label(
    df: DataFrame,
    calibration: Calibration,
    num_classes: int,
    probs: str = "probs",
    length: str = "chunk_len",
) -> DataFrame:
    """The single-class correction on probabilities, rounded to 4 digits."""
    df = with_entries(df, "p", entries(probs, num_classes))
    if calibration.posthoc:
        df = df.withColumn("_ln", _log_length(length, calibration.length_scale))
        df = _posthoc(df, calibration.posthoc, num_classes).drop("_ln")
    df = with_entries(df, "p", [round_half_even(F.col(c), DIGITS) for c in names("p", num_classes)])
    return pack(df, "p", num_classes, probs)


def calibrate(
    df: DataFrame,
    calibration: Calibration,
    num_classes: int,
    logits: str = "logits",
    length: str = "chunk_len",
    out: str = "probs",
) -> DataFrame:
    """Scaling, softmax, correction, rounding: one projection, no shuffle."""
    if calibration.classes is None:
        return softmax(df, num_classes, logits, out)
    df = _vector_scaled(df, calibration, num_classes, logits, length)
    if calibration.posthoc:
        df = _posthoc(df, calibration.posthoc, num_classes)
    df = with_entries(df, "p", [round_half_even(F.col(c), DIGITS) for c in names("p", num_classes)])
    return pack(df.drop("_ln"), "p", num_classes, out)
