"""Report files and the hand-off between the feature job and the scoring job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_report(df: DataFrame, path: str, mode: str = "error", single: bool = False) -> None:
    """Tab-separated with a header; NULL is empty. ``single`` is for small reports only."""
    frame = df.coalesce(1) if single else df
    frame.write.csv(path, sep="\t", header=True, nullValue="", emptyValue="", mode=mode)


def stage_features(
    folder: str, arch: DataFrame, hits: DataFrame, annotations: DataFrame | None = None, mode: str = "error"
) -> None:
    """Save what the feature job computed, for the scoring job."""
    arch.write.mode(mode).parquet(f"{folder}/arch_features")
    hits.write.mode(mode).parquet(f"{folder}/hits")
    if annotations is not None:
        annotations.write.mode(mode).parquet(f"{folder}/annotations")


def load_staged_features(
    spark: SparkSession, folder: str, chunks: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Reload ``(arch, hits)``; fails unless the staged chunk ids are exactly those of ``chunks``."""
    arch = spark.read.parquet(f"{folder}/arch_features")
    tally = (
        chunks.select("accession", F.lit(1).alias("side"))
        .unionByName(arch.select("accession", F.lit(-1).alias("side")))
        .groupBy("accession")
        .agg(F.sum("side").alias("balance"))
    )
    if not tally.where("balance <> 0").isEmpty():
        raise ValueError(
            "the staged chunks are not those of this run: "
            "use the chunk size and overlap of the feature job"
        )
    return arch, spark.read.parquet(f"{folder}/hits")
