"""Best hits as JSON objects ``{accession: {marker: bitscore}}``.

Import and export only: between jobs hits stay in long form as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_hits_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One object per line, or with ``multi_line`` one object per file, to ``(accession, marker, bitscore)``.

    A line that is no such object fails the job and is named.
    """
    lines = spark.read.text(path, wholetext=multi_line).where(F.trim("value") != "")
    nested = F.from_json("value", "map<string,map<string,double>>", {"mode": "PERMISSIVE"})
    broken = F.raise_error(
        F.concat(F.lit("not a JSON object of hits (one object over several lines needs multi_line): "), F.substring("value", 1, 200))
    ).cast("map<string,map<string,double>>")
    return (
        lines.select(F.coalesce(nested, broken).alias("nested"))
        .select(F.explode("nested").alias("accession", "markers"))
        .select("accession", F.explode("markers").alias("marker", "bitscore"))
    )


def write_hits_json(hits: DataFrame, path: str, parts: int = 1, mode: str = "error") -> None:
    """One object per accession and line.

    ``parts`` splits the markers of an accession over that many lines, which the reader joins
    again, so an accession with very many markers needs no huge row.
    """
    part = F.pmod(F.hash("marker"), F.lit(parts))
    lines = (
        hits.groupBy("accession", part.alias("_part"))
        .agg(F.map_from_entries(F.collect_list(F.struct("marker", "bitscore"))).alias("m"))
        .select(F.to_json(F.create_map("accession", "m")).alias("value"))
    )
    lines.write.mode(mode).text(path)
