"""Model side inputs: calibration, fold manifest, per-fold marker reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


@dataclass(frozen=True)
class Posthoc:
    target_class: int
    w0: float
    w1: float = 0.0


@dataclass(frozen=True)
class Calibration:
    """Per-class temperatures ``exp(w0 + w1*log(length/length_scale))``.

    ``classes`` is None when the file has no class section: plain softmax is used then.
    """

    classes: dict[int, tuple[float, float]] | None = None
    length_scale: float = 1000.0
    posthoc: Posthoc | None = None

    def weights(self, size: int) -> list[tuple[float, float]]:
        return [(self.classes or {}).get(i, (0.0, 0.0)) for i in range(size)]


_WEIGHTS = T.StructType(
    [T.StructField("w0", T.DoubleType()), T.StructField("w1", T.DoubleType())]
)
CALIBRATION_SCHEMA = T.StructType(
    [
        T.StructField("classes", T.MapType(T.StringType(), _WEIGHTS)),
        T.StructField("length_scale", T.DoubleType()),
        T.StructField(
            "posthoc_top_label",
            T.StructType(
                [
                    T.StructField("enabled", T.BooleanType()),
                    T.StructField("target_class", T.IntegerType()),
                    T.StructField("w0", T.DoubleType()),
                    T.StructField("w1", T.DoubleType()),
                ]
            ),
        ),
    ]
)


def _number(value: float | None, default: float) -> float:
    return default if value is None else float(value)


def load_calibration(spark: SparkSession, path: str | None) -> Calibration:
    """The calibration file: one small JSON object, held as literals."""
    if not path:
        raise ValueError("a calibration file is required")
    row = spark.read.json(path, schema=CALIBRATION_SCHEMA, multiLine=True).first()
    if row is None:
        raise ValueError(f"no calibration object in {path}")
    classes = None
    if row["classes"] is not None:
        classes = {
            int(k): (_number(w and w["w0"], 0.0), _number(w and w["w1"], 0.0))
            for k, w in row["classes"].items()
        }
    top = row["posthoc_top_label"]
    posthoc = None
    if top is not None and top["enabled"]:
        posthoc = Posthoc(int(top["target_class"]), float(top["w0"]), _number(top["w1"], 0.0))
    return Calibration(classes, _number(row["length_scale"], 1000.0), posthoc)


FOLD_NUMBER = r"fold_(\d+)$"


def load_folds(manifest: DataFrame) -> DataFrame:
    """Fold names in numeric order; names without a number come last."""
    number = F.regexp_extract("fold", FOLD_NUMBER, 1)
    position = F.when(number != "", number.cast("int"))
    return manifest.where(F.col("fold").startswith("fold_")).orderBy(position.asc_nulls_last(), "fold")


def select_folds(
    manifest: DataFrame,
    explicit: list[str] | None = None,
    fold_index: int | None = None,
    num_folds: int = 5,
) -> list[str]:
    """Names of the folds to run. The manifest has one row per trained fold (a handful)."""
    if explicit:
        found = {r["fold"] for r in manifest.where(F.col("fold").isin(explicit)).collect()}
        missing = [name for name in explicit if name not in found]
        if missing:
            raise ValueError(f"folds not found: {missing}")
        names = list(explicit)
    else:
        names = [r["fold"] for r in load_folds(manifest).select("fold").collect()]
        if not names:
            raise ValueError("the manifest has no fold_* entry")
    if fold_index is not None:
        if fold_index < 0:
            raise ValueError("fold_index must be >= 0")
        if f"fold_{fold_index}" not in names:
            raise ValueError(f"fold_{fold_index} is not among {names}")
        return [f"fold_{fold_index}"]
    if num_folds > len(names):
        raise ValueError(f"{num_folds} folds asked for, {len(names)} found")
    return names[:num_folds]


FOLD_CONFIG_SCHEMA = T.StructType(
    [
        T.StructField("label_mapping", T.MapType(T.StringType(), T.StringType())),
        T.StructField("num_classes", T.IntegerType()),
        T.StructField("gate_marker_dim", T.IntegerType()),
        T.StructField("raw_feature_dim", T.IntegerType()),
    ]
)


def read_fold_configs(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a model folder: one row per ``fold_*/config.json``."""
    configs = spark.read.json(f"{folder}/fold_*/config.json", FOLD_CONFIG_SCHEMA, multiLine=True)
    return configs.select(
        F.regexp_extract("_metadata.file_path", r"/(fold_[^/]*)/config\.json$", 1).alias("fold"),
        "label_mapping",
        F.coalesce("num_classes", F.lit(5)).alias("num_classes"),
        F.coalesce("gate_marker_dim", F.lit(0)).alias("gate_marker_dim"),
        F.coalesce("raw_feature_dim", F.lit(0)).alias("raw_feature_dim"),
    )


def load_marker_ref(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``(fold, marker, class_code, cutoff)`` from Parquet or a delimited file."""
    raw = (
        spark.read.parquet(path)
        if fmt == "parquet"
        else spark.read.csv(path, sep="\t", header=True, nullValue="")
    )
    return raw.select(
        F.col("fold").cast("string"),
        F.col("marker").cast("string"),
        F.col("class_code").cast("string"),
        F.col("cutoff").cast("double"),
    )
