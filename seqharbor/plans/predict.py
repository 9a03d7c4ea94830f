"""Whole runs: the feature job, the scoring job, and the marker export."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..constants import (
    ARCH_FEATURES,
    ARCH_MODEL_FEATURES,
    DOMAIN_MARKER_FEATURES,
    HOST_MARKER_FEATURES,
)
from ..operators.ensemble import (
    call_chunks,
    chunk_report,
    combine_folds,
    features_report,
    fold_report,
    genome_consensus,
    model_scores_report,
    prokaryote_index,
)
from ..operators.calibration import calibrate
from ..operators.features import (
    GATE_DIM,
    MASKS,
    assemble_features,
    gate_inputs,
    mask_features,
    mask_for,
)
from ..operators.genes import (
    arch_features,
    gene_context,
    gene_table,
    most_orfs,
    orf_scan,
    protein_table,
)
from ..operators.gene_chain import gene_chain
from ..operators.markers import annotate_hits, extract_markers, marker_features, marker_summary
from ..operators.scoring import (
    GateWeights,
    gate_alpha,
    hierarchical_probs,
    mix_probs,
    score_batches,
    score_trees,
    stream_fallback,
)
from ..operators.sequences import chunk_overlap, length_bucket_batches
from ..session import materialize
from ..sources.fasta import write_protein_fasta
from ..sources.models import Calibration
from .checks import require_unique

Search = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class FeatureTables:
    """What the feature job yields. ``chunks`` holds the sequences, the rest is narrow."""

    chunks: DataFrame
    proteins: DataFrame
    arch: DataFrame
    hits: DataFrame
    best: DataFrame
    annotations: DataFrame


def run_features(
    sequences: DataFrame,
    metadata: DataFrame,
    search: Search | DataFrame,
    chunk_size: int = 10000,
    overlap: int = 1000,
    evalue: float = 1e-3,
    min_coverage: float = 0.0,
    min_identity: float = 0.0,
    one_chain: bool = False,
) -> FeatureTables:
    """Chunk, scan genes, search markers.

    ``search`` is a table of alignment hits or a function from the protein table to one. Chunks
    feed the gene scan, the features and the sequence model, and genes feed the features and
    the search: both are written once in the shared folder. Later steps then read the columns
    they need, not the sequence files again. A repeated or missing accession fails the run. With ``one_chain``
    overlapping frames do not all stay: each chunk keeps its best chain of genes.
    """
    require_unique(sequences)
    chunks = materialize(chunk_overlap(sequences, chunk_size, overlap), "chunks")
    orfs = materialize(gene_chain(chunks) if one_chain else orf_scan(chunks), "orfs")
    context = gene_context(gene_table(orfs), most_genes=most_orfs(chunk_size))
    arch = arch_features(chunks, context, chunk_size)
    proteins = protein_table(orfs)
    raw = search if isinstance(search, DataFrame) else search(proteins)
    kept, best = extract_markers(raw, metadata, evalue, min_coverage, min_identity)
    return FeatureTables(chunks, proteins, arch, kept, best, annotate_hits(kept, proteins, metadata))


@dataclass(frozen=True)
class Ensemble:
    """A trained ensemble as tables and literals.

    ``domain_trees`` and ``host_trees`` are node tables with a fold column. Without ``gates`` there
    is no mixture: the sequence model alone, or the trees alone, make the score. Intercepts are one
    number or one per fold; ``host_base_score`` is ``base_score`` unless given.
    """

    folds: list[str]
    labels: list[str]
    calibration: Calibration
    marker_ref: DataFrame
    domain_trees: DataFrame
    host_trees: DataFrame
    host_classes: list[int]
    gates: dict[str, GateWeights] = field(default_factory=dict)
    gate_marker_dim: int = 0
    raw_feature_dim: int = GATE_DIM
    base_score: float | dict[str, float] = 0.0
    host_base_score: float | dict[str, float] | None = None
    domain_features: list[str] = field(
        default_factory=lambda: ARCH_MODEL_FEATURES + DOMAIN_MARKER_FEATURES
    )
    host_features: list[str] = field(
        default_factory=lambda: ARCH_MODEL_FEATURES + HOST_MARKER_FEATURES
    )


def score_folds(
    chunks: DataFrame,
    arch: DataFrame,
    best: DataFrame,
    ensemble: Ensemble,
    model_logits: DataFrame | None = None,
    mask: str = "none",
    mask_target: str = "all",
) -> DataFrame:
    """One row per (fold, chunk): tree probabilities, model logits, gate weight, mixed log scores.

    Features, trees, gate and mixture are columns of one row: a single join by accession brings
    architecture and marker features together for both models.
    """
    size = len(ensemble.labels)
    prokaryote = prokaryote_index(ensemble.labels)
    if prokaryote is None:
        raise ValueError("tree scores need a prokaryote class")
    ungated = sorted(set(ensemble.folds) - set(ensemble.gates)) if ensemble.gates else []
    if ungated:
        raise ValueError(f"no gate for folds {ungated}")
    markers = marker_features(marker_summary(chunks, best, ensemble.marker_ref, ensemble.folds))
    own = ["chunk_len", *(["genome"] if "genome" in chunks.columns else [])]
    rows = assemble_features(arch, markers).join(chunks.select("accession", *own), "accession")
    unseen = MASKS[mask_for("host_only", mask, mask_target)]
    host_row = [
        (F.lit(None).cast("double") if c in unseen else F.col(c)).alias(c)
        for c in ensemble.host_features
    ]
    rows = rows.withColumn("_host", F.struct(*host_row))
    rows = mask_features(rows, mask_for("domain_only", mask, mask_target))
    rows = score_trees(
        rows, ensemble.domain_trees, ensemble.domain_features, 2, ensemble.base_score, "_domain_probs"
    )
    rows = rows.withColumn("_raw", F.struct(*ARCH_FEATURES)).select(
        "fold", "accession", *own, "n_genes", "_raw", "_domain_probs", "_host.*"
    )
    rows = score_trees(
        rows,
        ensemble.host_trees,
        ensemble.host_features,
        len(ensemble.host_classes),
        ensemble.base_score if ensemble.host_base_score is None else ensemble.host_base_score,
        "_host_probs",
    )
    tree_probs = hierarchical_probs("_domain_probs", "_host_probs", size, prokaryote, ensemble.host_classes)
    rows = rows.select(
        "fold", "accession", *own, "n_genes", "_raw.*", tree_probs.alias("tree_probs")
    )
    rows = gate_inputs(rows, ensemble.raw_feature_dim, ensemble.gate_marker_dim, "tree_probs")
    rows = rows.select("fold", "accession", *own, "n_genes", "raw", "tree_probs")
    if model_logits is None:
        return stream_fallback(rows, size, None, "tree_probs", "logits").drop("raw")
    unscored = F.raise_error(
        F.concat(F.lit("no model logits for "), F.col("fold"), F.lit(" "), F.col("accession"))
    ).cast("array<double>")
    rows = rows.join(
        model_logits.select("fold", "accession", F.col("logits").alias("model_logits")),
        ["fold", "accession"],
        "left",
    ).withColumn("model_logits", F.coalesce("model_logits", unscored))
    if not ensemble.gates:
        return stream_fallback(rows, size, "model_logits", None, "logits").drop("raw")
    rows = rows.withColumn("marker", F.array(F.col("n_genes").cast("double")))
    rows = gate_alpha(
        rows,
        ensemble.gates,
        size,
        ensemble.raw_feature_dim,
        1 if ensemble.gate_marker_dim > 0 else 0,
        logits="model_logits",
    )
    return mix_probs(rows, size, "alpha", "model_logits", "tree_probs", "logits").drop("raw", "marker")


def score_model(
    chunks: DataFrame,
    models: dict[str, Callable],
    inputs: list[str],
    batch_size: int = 16,
    tolerance: int = 200,
    input_shapes: list | None = None,
) -> DataFrame:
    """``(fold, accession, logits)``: every chunk scored by every fold's model, in batches of like lengths.

    ``models`` has a ``make_predict`` per fold, ``inputs`` are the columns of ``chunks`` that it
    takes. Batches are laid out once, in length order, and read once for all folds.
    """
    laid_out = length_bucket_batches(chunks.select("accession", "chunk_len", *inputs), batch_size, tolerance)
    return score_batches(laid_out, models, inputs, input_shapes=input_shapes)


@dataclass(frozen=True)
class Reports:
    chunks: DataFrame
    folds: DataFrame
    genomes: DataFrame | None = None
    model_scores: DataFrame | None = None
    features: DataFrame | None = None


def report_run(
    fold_scores: DataFrame,
    ensemble: Ensemble,
    mode: str = "logit",
    aggregate_chunks: bool = True,
    model_scores: bool = False,
    features: DataFrame | None = None,
) -> Reports:
    """All reports of a run from its fold scores."""
    size = len(ensemble.labels)
    calibrated = calibrate(fold_scores, ensemble.calibration, size)
    combined = combine_folds(fold_scores, ensemble.calibration, size, mode)
    called = call_chunks(combined, ensemble.labels)
    return Reports(
        chunks=chunk_report(called, ensemble.labels),
        folds=fold_report(calibrated, ensemble.labels),
        genomes=genome_consensus(combined, ensemble.labels) if aggregate_chunks else None,
        model_scores=model_scores_report(calibrated, ensemble.labels) if model_scores else None,
        features=features_report(features, ensemble.folds[0]) if features is not None else None,
    )


def export_marker_hits(
    sequences: DataFrame,
    metadata: DataFrame,
    search: Search | DataFrame,
    path: str,
    proteins_path: str | None = None,
    annotations_path: str | None = None,
    evalue: float = 1e-3,
    min_coverage: float = 0.0,
    min_identity: float = 0.0,
) -> DataFrame:
    """Whole sequences to best hits as Parquet, with proteins and annotations on request."""
    require_unique(sequences)
    orfs = materialize(orf_scan(sequences), "orfs")
    proteins = protein_table(orfs)
    raw = search if isinstance(search, DataFrame) else search(proteins)
    kept, best = extract_markers(raw, metadata, evalue, min_coverage, min_identity)
    best.write.parquet(path)
    if proteins_path:
        write_protein_fasta(proteins, proteins_path)
    if annotations_path:
        annotate_hits(kept, proteins, metadata).write.parquet(annotations_path)
    return sequences.sparkSession.read.parquet(path)
