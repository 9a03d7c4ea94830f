"""Input checks: find every problem first, then fail once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MOST_SHOWN = 100  # problems that an error lists
PROBLEM_SCHEMA = "table_name string, problem string, detail string, n_rows bigint"


@dataclass(frozen=True)
class TableCheck:
    """What one input table must satisfy.

    ``refs`` maps a column to ``(table label, other frame, other column)``: every value must be
    found there.
    """

    name: str
    df: DataFrame
    required: list[str]
    key: list[str] = field(default_factory=list)
    refs: dict[str, tuple[str, DataFrame, str]] = field(default_factory=dict)


def _shown(columns: list[str]):
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def find_problems(spark: SparkSession, checks: list[TableCheck]) -> DataFrame:
    """All violations as rows: missing columns, null keys, repeated keys, dangling references."""
    missing = [
        (c.name, "missing column", column, 0)
        for c in checks
        for column in c.required
        if column not in c.df.columns
    ]
    parts = [spark.createDataFrame(missing, PROBLEM_SCHEMA)]

    def add(name: str, problem: str | Column, rows: DataFrame) -> None:
        parts.append(
            rows.select(
                F.lit(name).alias("table_name"),
                (F.lit(problem) if isinstance(problem, str) else problem).alias("problem"),
                "detail",
                F.col("n_rows").cast("bigint"),
            )
        )

    for check in checks:
        key = [c for c in check.key if c in check.df.columns]
        if key:
            empty = F.lit(False)
            for c in key:
                empty = empty | F.col(c).isNull()
            # keys with a null in any part count together; one pass over a table that may be costly to read
            keys = check.df.select(empty.alias("_empty"), *[F.when(~empty, F.col(c)).alias(c) for c in key])
            counted = keys.groupBy("_empty", *key).agg(F.count(F.lit(1)).alias("n_rows")).where("_empty or n_rows > 1")
            problem = F.when(F.col("_empty"), "null key").otherwise("duplicate key")
            detail = F.when(F.col("_empty"), "|".join(key)).otherwise(_shown(key))
            add(check.name, problem, counted.withColumn("detail", detail))
        for column, (label, other, theirs) in check.refs.items():
            if column not in check.df.columns:
                continue
            known = other.select(F.col(theirs).alias(column))
            dangling = (
                check.df.where(F.col(column).isNotNull())
                .groupBy(column)
                .agg(F.count(F.lit(1)).alias("n_rows"))
                .join(known, column, "left_anti")
            )
            add(check.name, f"not in {label}", dangling.withColumn("detail", F.col(column).cast("string")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def validate_inputs(spark: SparkSession, checks: list[TableCheck], most: int = MOST_SHOWN) -> None:
    """Raise one error that lists the problems, if there are any: the first ``most`` of them."""
    ordered = find_problems(spark, checks).orderBy("table_name", "problem", "detail")
    problems = ordered.limit(most + 1).collect()
    if problems:
        lines = [f"{p.table_name}: {p.problem} {p.detail} ({p.n_rows})" for p in problems[:most]]
        raise ValueError("\n  ".join(["input checks failed:", *lines, *(["and more"] if len(problems) > most else [])]))


def require_paths(spark: SparkSession, paths: dict[str, str]) -> None:
    """Raise one error that names every path (or pattern) that leads to no file; keys say what a path is for."""
    conf = spark._jsc.hadoopConfiguration()
    missing = []
    for purpose, name in paths.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if not path.getFileSystem(conf).globStatus(path):
            missing.append(f"{purpose}: {name}")
    if missing:
        raise FileNotFoundError("\n  ".join(["inputs not found:", *missing]))


def require_unique(sequences: DataFrame, name: str = "sequences") -> None:
    """Fail on accessions that are missing or stand twice, naming the first of them."""
    check = TableCheck(name, sequences.select("accession"), ["accession"], ["accession"])
    validate_inputs(sequences.sparkSession, [check])
