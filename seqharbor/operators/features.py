"""Feature tables for the tree models and the gate, aligned by accession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    ARCH_FEATURES,
    ARCH_MODEL_FEATURES,
    BOUNDARY_GROUP,
    DENSITY_GROUP,
    DOMAIN_MARKER_FEATURES,
    HOST_MARKER_FEATURES,
)
from ..functions.scalars import zero_if_missing

GATE_DIM = 13
MASKS = {
    "none": [],
    "density": DENSITY_GROUP,
    "boundary": BOUNDARY_GROUP,
    "density_plus_boundary": DENSITY_GROUP + BOUNDARY_GROUP,
}
TARGETS = ("all", "domain_only", "host_only")


def assemble_features(arch: DataFrame, markers: DataFrame) -> DataFrame:
    """Architecture and marker features of a (fold, chunk) on one row: a single join.

    Each model's matrix, their union and the gate's input are column selections of this table.
    """
    return arch.join(markers, "accession").select(
        "fold", "accession", "n_genes", *ARCH_FEATURES, *DOMAIN_MARKER_FEATURES, *HOST_MARKER_FEATURES
    )


def mask_features(df: DataFrame, mask: str = "none") -> DataFrame:
    """Set a group of columns to NULL, where present."""
    if mask not in MASKS:
        raise ValueError(f"unknown mask: {mask}")
    hidden = {c: F.lit(None).cast("double") for c in MASKS[mask] if c in df.columns}
    return df.withColumns(hidden) if hidden else df


def mask_for(model: str, mask: str, target: str) -> str:
    """The mask that reaches ``model`` (domain_only / host_only) under a mask target."""
    if target not in TARGETS:
        raise ValueError(f"unknown mask target: {target}")
    return mask if target in ("all", model) else "none"


def domain_matrix(wide: DataFrame, mask: str = "none", target: str = "all") -> DataFrame:
    shown = wide.select("fold", "accession", *ARCH_MODEL_FEATURES, *DOMAIN_MARKER_FEATURES)
    return mask_features(shown, mask_for("domain_only", mask, target))


def host_matrix(wide: DataFrame, mask: str = "none", target: str = "all") -> DataFrame:
    shown = wide.select("fold", "accession", *ARCH_MODEL_FEATURES, *HOST_MARKER_FEATURES)
    return mask_features(shown, mask_for("host_only", mask, target))


def union_feature_columns(wide: DataFrame, mask: str = "none", target: str = "all") -> DataFrame:
    """The domain matrix plus the columns only the host matrix has."""
    shown = wide.select(
        "fold", "accession", *ARCH_MODEL_FEATURES, *DOMAIN_MARKER_FEATURES, *HOST_MARKER_FEATURES
    )
    return mask_features(shown, mask_for("domain_only", mask, target))


def select_model_features(
    df: DataFrame, names: list[str], model: str, keys: tuple[str, ...] = ("fold", "accession")
) -> DataFrame:
    """Columns in the model's order, float32."""
    if not names:
        raise ValueError(f"{model} has no feature list")
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{model} needs features that were not built: {missing}")
    return df.select(*keys, *[F.col(n).cast("float").alias(n) for n in names])


def gate_inputs(
    rows: DataFrame,
    raw_feature_dim: int = GATE_DIM,
    gate_marker_dim: int = 0,
    probs: str = "probs",
) -> DataFrame:
    """Add ``raw``, the 13 gate features with missing as 0, and ``features``, the class
    probabilities followed by the gene count when the gate takes it.

    ``rows`` carries the domain matrix's (masked) architecture columns, so a mask on that matrix
    reaches the gate; ``fragment_size`` is never masked.
    """
    if raw_feature_dim != GATE_DIM:
        raise ValueError(f"the gate takes {GATE_DIM} raw features, the model says {raw_feature_dim}")
    features = (
        F.concat(probs, F.array(F.col("n_genes").cast("double")))
        if gate_marker_dim > 0
        else F.col(probs)
    )
    return rows.withColumns(
        {
            "raw": F.array(*[zero_if_missing(F.col(c)) for c in ARCH_FEATURES]),
            "features": features,
        }
    )


def align_features(accessions: DataFrame, table: DataFrame, strict: bool = False) -> DataFrame:
    """A feature table for exactly the given accessions; missing values are 0.0.

    ``strict`` fails the job on an accession the table does not have and keeps its missing values.
    """
    names = [c for c in table.columns if c != "accession"]
    joined = accessions.select("accession").join(
        table.withColumn("_here", F.lit(True)), "accession", "left"
    )
    absent = F.raise_error(F.concat(F.lit("no features for "), F.col("accession"))).cast("double")

    def value(name: str) -> Column:
        number = F.col(name).cast("double")
        if strict:
            return F.when(F.col("_here").isNull(), absent).otherwise(number)
        return zero_if_missing(number)

    return joined.select("accession", *[value(n).cast("float").alias(n) for n in names])
