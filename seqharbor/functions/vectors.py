"""Class-score vectors, unrolled to plain columns.

A score vector has one entry per class, so its width is known when the plan is built. Unrolled
columns stay inside whole-stage codegen, which higher-order array functions do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scalars import largest, total


def entries(vector: str | Column, size: int) -> list[Column]:
    column = F.col(vector) if isinstance(vector, str) else vector
    return [column[i] for i in range(size)]


def names(prefix: str, size: int) -> list[str]:
    return [f"_{prefix}{i}" for i in range(size)]


def with_entries(df: DataFrame, prefix: str, values: list[Column]) -> DataFrame:
    return df.withColumns({f"_{prefix}{i}": value for i, value in enumerate(values)})


def with_softmax(df: DataFrame, scores: list[Column], prefix: str) -> DataFrame:
    """Add ``_{prefix}0.._{prefix}n-1`` holding the stable softmax of ``scores``."""
    n = len(scores)
    df = with_entries(df, "sm_z", scores)
    df = df.withColumn("_sm_top", largest([F.col(c) for c in names("sm_z", n)]))
    df = with_entries(df, "sm_e", [F.exp(F.col(c) - F.col("_sm_top")) for c in names("sm_z", n)])
    df = df.withColumn("_sm_sum", total([F.col(c) for c in names("sm_e", n)]))
    df = with_entries(df, prefix, [F.col(c) / F.col("_sm_sum") for c in names("sm_e", n)])
    return df.drop("_sm_top", "_sm_sum", *names("sm_z", n), *names("sm_e", n))


def pack(df: DataFrame, prefix: str, size: int, out: str) -> DataFrame:
    """Gather ``_{prefix}*`` into one array column and drop the parts."""
    parts = names(prefix, size)
    return df.withColumn(out, F.array(*[F.col(c) for c in parts])).drop(*parts)
