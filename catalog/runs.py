"""Whole runs: sequences to genome calls."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqharbor.operators.ensemble import combine_folds, genome_consensus
from seqharbor.plans.predict import Ensemble, run_features, score_folds, score_model

from . import ensemble, features, genes, markers, scoring, views
from .registry import query, tidy
from .sequences import OVERLAP, SIZE
from .views import CLASSES, sql

RUN_FOLDS = markers.MARKER_FOLDS
SMALL_CHUNKS = {
    name: text.replace("10000", str(SIZE)) if name == "arch" else text
    for name, text in features.TREE_CTES.items()
}
BASES = "ACGT"
LOGIT_WEIGHT = [[((i * 3 + j * 5) % 7 - 3) / 4 for j in range(4)] for i in range(CLASSES)]
FOLD_WEIGHT = [0.25 * (i % 3) for i in range(CLASSES)]
RUN_CTES = {
    **genes.ORF_CTES,
    "v_genes": """select accession, (row_number() over (partition by accession
        order by begin_pos, end_pos, strand))::int idx, begin_pos, end_pos, strand,
        length(amino_acid_sequence)::int aa_len, nullif(rbs_motif,'') motif, rbs_score score from orfs""",
    "v_gene_chunks": "select accession, length(seq)::int chunk_len from c",
    **markers.PROTEIN_SEED_CTES,
    **SMALL_CHUNKS,
    "raw_rows": "select w.fold, w.accession, c.genome, g.chunk_len, w.n_genes, "
    + ", ".join(f"coalesce(w.{n},0) raw{i}" for i, n in enumerate(features.GATE_RAW))
    + ", "
    + ", ".join(
        "("
        + "+".join(f"(length(c.seq)-length(replace(c.seq,'{base}','')))*{LOGIT_WEIGHT[i][j]}::double" for j, base in enumerate(BASES))
        + f")/100.0::double+right(w.fold,1)::int*{FOLD_WEIGHT[i]}::double s{i}, t.p{i} tree{i}"
        for i in range(CLASSES)
    )
    + """ from wide w join class_probs t on t.fold=w.fold and t.accession=w.accession
        join v_gene_chunks g on g.accession=w.accession join c on c.accession=w.accession""",
    **{name: text for name, text in scoring.GATE_CTES.items() if name != "raw_rows"},
    "mixed": "select accession, genome, chunk_len, fold, "
    + ", ".join(
        f"ln(greatest(alpha*g{i}+(1-alpha)*tree{i}, 1e-7)) s{i}" for i in range(CLASSES)
    )
    + " from gated",
    "mean": "select accession, genome, chunk_len, "
    + ", ".join(f"avg(s{i}) s{i}" for i in range(CLASSES))
    + " from mixed group by 1, 2, 3",
    **ensemble.calibration_ctes("mean", "combined"),
    **{name: text for name, text in ensemble.GENOME_CTES.items() if name in ("weighed", "genome_mean", "genome_calls")},
}


def trained(spark, sf) -> Ensemble:
    return Ensemble(
        folds=RUN_FOLDS,
        labels=views.LABELS,
        calibration=ensemble.CALIBRATION,
        marker_ref=views.marker_ref(spark, sf),
        domain_trees=features.trees(spark, features.TREES),
        host_trees=features.trees(spark, features.HOST_TREES),
        host_classes=[0, 1, 2, 3],
        gates=scoring.GATES,
        gate_marker_dim=1,
    )


def chunk_model(fold: int):
    """A small sequence model: linear in the base counts, with a shift per fold."""

    def make_predict():
        weight, shift = np.asarray(LOGIT_WEIGHT).T / 100.0, fold * np.asarray(FOLD_WEIGHT)
        return lambda counts: np.asarray(counts, dtype=float) @ weight + shift

    return make_predict


def model_logits(chunks):
    """Every chunk scored by every fold's model, in batches of like lengths."""
    counts = F.array(*[(F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).cast("double") for b in BASES])
    models = {fold: chunk_model(int(fold[-1])) for fold in RUN_FOLDS}
    return score_model(chunks.withColumn("counts", counts), models, ["counts"], input_shapes=[[len(BASES)]])


@query("genome_calls", sql(["v_sequences", "v_references", "v_markers", "v_marker_ref"], ensemble.GENOMES, RUN_CTES))
def genome_calls(spark, sf):
    """Chunks, genes, own marker search, trees, model, gate, mixture, fold mean, calibration, genome roll-up."""
    tables = run_features(
        views.sequences(spark, sf), views.markers(spark, sf), markers.protein_search(spark, sf), SIZE, OVERLAP
    )
    model = trained(spark, sf)
    scores = score_folds(tables.chunks, tables.arch, tables.best, model, model_logits(tables.chunks))
    return tidy(genome_consensus(combine_folds(scores, model.calibration, CLASSES), model.labels))
