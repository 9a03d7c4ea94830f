"""Delimited tables: markers, alignment hits, features, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import ARCH_FEATURES, HIT_COLUMNS
from ..functions.scalars import nan_to_null, zero_if_missing

# Texts read as a missing value in the marker table.
NULL_TOKENS = ["", "NA", "na", "NaN", "nan"]
# Accepted names of an identifier column, by preference.
ID_NAMES = ["accession", "chunk_id", "id"]

SPACE = " \t\r\n\f\x0b"
INTEGER = r"^[+-]?[0-9]+$"
REAL = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"


def read_delimited(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A delimited file with a header, every column as text."""
    return spark.read.csv(path, sep=sep, header=True, nullValue="")


def read_marker_metadata(spark: SparkSession, path: str) -> DataFrame:
    raw = read_delimited(spark, path)
    clean = raw.toDF(*[name.strip().lower() for name in raw.columns])
    for needed in ("marker", "specificity_class"):
        if needed not in clean.columns:
            raise ValueError(f"no '{needed}' column in {path}; found {clean.columns}")
    return clean.select(
        *[F.when(~F.col(c).isin(NULL_TOKENS), F.col(c)).alias(c) for c in clean.columns]
    )


def _whole(field: Column) -> Column:
    text = F.btrim(field, F.lit(SPACE))
    return F.when(text.rlike(INTEGER), text.try_cast("bigint"))


def _real(field: Column) -> Column:
    text = F.btrim(field, F.lit(SPACE))
    return F.when(text.rlike(REAL), text.try_cast("double"))


def parse_alignment_hits(lines: DataFrame) -> DataFrame:
    """Alignment lines (column ``value``) to typed hits.

    Lines with fewer than 11 fields are no hits. An unreadable score counts as 1.0; one
    unreadable integer sets all seven integers to 0. ``evalue`` keeps its text.
    """
    fields = lines.select(F.split(F.btrim("value", F.lit(SPACE)), "\t").alias("f")).where(
        F.size("f") >= len(HIT_COLUMNS)
    )
    whole = HIT_COLUMNS[4:]
    parsed = fields.select(
        F.col("f")[0].alias("query"),
        F.col("f")[1].alias("target"),
        F.col("f")[2].alias("evalue"),
        F.coalesce(_real(F.col("f")[3]), F.lit(1.0)).alias("bits"),
        *[_whole(F.col("f")[i]).alias(c) for i, c in enumerate(whole, start=4)],
    )
    readable = F.lit(True)
    for c in whole:
        readable = readable & F.col(c).isNotNull()
    return parsed.select(
        *HIT_COLUMNS[:4],
        *[F.when(readable, F.col(c)).otherwise(F.lit(0)).cast("bigint").alias(c) for c in whole],
    )


def read_alignment_hits(spark: SparkSession, path: str) -> DataFrame:
    return parse_alignment_hits(spark.read.text(path))


def id_column(columns: list[str]) -> str:
    return next((name for name in ID_NAMES if name in columns), columns[0])


def feature_table(raw: DataFrame, id_name: str | None = None, keep_missing: bool = False) -> DataFrame:
    """Text columns to ``(accession, <numeric features>)``; unreadable or missing is 0.0, or null with ``keep_missing``."""
    fill = nan_to_null if keep_missing else zero_if_missing
    key = id_name or id_column(raw.columns)
    features = [c for c in raw.columns if c != key]
    if not features:
        raise ValueError("the feature table has no feature column")
    return raw.select(
        F.col(key).cast("string").alias("accession"),
        *[fill(_real(F.col(c).cast("string"))).alias(c) for c in features],
    )


def read_feature_table(
    spark: SparkSession, path: str, sep: str = "\t", id_name: str | None = None, keep_missing: bool = False
) -> DataFrame:
    return feature_table(read_delimited(spark, path, sep), id_name, keep_missing)


def read_gate_features(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame | None:
    """Only the architecture columns, in model order; None when the file has none of them."""
    table = read_feature_table(spark, path, sep)
    present = [c for c in ARCH_FEATURES if c in table.columns]
    return table.select("accession", *present) if present else None


def read_labels(
    spark: SparkSession, path: str, sep: str = "\t", skip_short: bool = False
) -> DataFrame:
    """The first two columns as ``(accession, label)``; ``skip_short`` drops rows without a label."""
    raw = read_delimited(spark, path, sep)
    if len(raw.columns) < 2:
        raise ValueError("a label file needs two columns (accession, label)")
    first, second = raw.columns[:2]
    labels = raw.select(
        F.col(first).cast("string").alias("accession"), F.col(second).cast("string").alias("label")
    )
    return labels.where(F.col("label").isNotNull()) if skip_short else labels
