"""FASTA in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LINE_WIDTH = 80


def _without_whitespace(text: Column) -> Column:
    for blank in ("\n", "\r", " ", "\t"):
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def read_fasta(spark: SparkSession, path: str | list[str], upper: bool = True) -> DataFrame:
    """Multi-FASTA files as ``(accession, seq, seq_len)``, one row per record.

    Records are split by the reader on a newline followed by ``>``, so large files stay
    splittable. The accession is the first word of the header.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", r"\A>", "")
    header = F.substring_index("record", "\n", 1)
    body = F.expr("substring(record, length(header) + 2)")
    seq = _without_whitespace(body)
    return (
        raw.where(F.length(F.btrim("value", F.lit(" \r\n\t"))) > 0)
        .select(record.alias("record"))
        .withColumn("header", header)
        .select(
            F.regexp_extract("header", r"^\s*(\S+)", 1).alias("accession"),
            (F.upper(seq) if upper else seq).alias("seq"),
        )
        .withColumn("seq_len", F.length("seq"))
    )


def fasta_text(df: DataFrame, name: str, seq: str, width: int | None) -> DataFrame:
    lines = F.col(seq)
    if width:
        lines = F.regexp_replace(lines, f"(.{{{width}}})(?=.)", "$1\n")
    title = F.concat(F.lit(">"), F.col(name))
    return df.select(
        F.when(F.length(seq) > 0, F.concat(title, F.lit("\n"), lines)).otherwise(title)
        .alias("value")
    )


def write_fasta(df: DataFrame, path: str, name: str = "accession", seq: str = "seq") -> None:
    """Sequences wrapped at 80 letters, as a folder of text files."""
    fasta_text(df, name, seq, LINE_WIDTH).write.text(path)


def write_protein_fasta(
    df: DataFrame, path: str, name: str = "protein_id", seq: str = "amino_acid_sequence"
) -> None:
    """Proteins, one unwrapped line each."""
    fasta_text(df, name, seq, None).write.text(path)
