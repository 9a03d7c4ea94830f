"""Helpers the operators share: raw text columns, bounded slices of Arrow batches, scratch tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqharbor.session import materialize

__all__ = [
    "binary_column", "bounded", "crc_fold", "free_prefix", "materialize", "sha256", "slices_by_bytes", "table",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of a session that leaves them at ten thousand rows of any size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > 1000:
        spark.conf.set(key, "1000")
    return spark


def crc_fold(doc_id: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0))


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [value or b"" for value in column.cast(kind).to_pylist()]


def free_prefix(docs: DataFrame, prefix: str) -> str:
    """``prefix``, with underscores in front until no column starts with it."""
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def slices_by_bytes(
    batches: Iterable[pa.RecordBatch], column: str, most: int
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts add up to ``most`` bytes, one longer text by itself."""
    for batch in batches:
        texts = binary_column(batch, column)
        start = size = 0
        for i, text in enumerate(texts):
            if i > start and size + len(text) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(text)
        if start < len(texts):
            yield batch.slice(start), texts[start:]
