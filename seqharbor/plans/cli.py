"""Command line of the batch jobs.

    python -m seqharbor proteins --fasta in.fasta --output out
    python -m seqharbor features --fasta in.fasta --hits hits.tsv --metadata markers.tsv --output out
    python -m seqharbor predict  --fasta in.fasta --features out/run --ensemble-dir models --output out

``proteins`` writes the proteins for a search tool, ``features`` stages features from its hits,
``predict`` scores them. ``predict`` can also take ``--hits`` and ``--metadata`` instead of staged
features. In place of ``--hits``, ``--marker-proteins`` names a FASTA file of the markers' sequences, which are then searched
here. ``--model package.module:function`` names a function from a fold's name to a ``make_predict`` over batches of
sequences, in place of ``--model-logits``. A model folder holds ``fold_*/config.json``, ``calibration.json``, ``ensemble.json`` and
the Parquet tables ``marker_ref``, ``domain_trees`` and ``host_trees``.
"""

from __future__ import annotations

import argparse
from collections import Counter
from dataclasses import replace
from functools import reduce
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.spread import spread
from ..operators.alignment import search_alignments
from ..operators.ensemble import MODES, label_list
from ..operators.features import MASKS, TARGETS, assemble_features, union_feature_columns
from ..operators.gene_chain import gene_chain
from ..operators.genes import orf_scan
from ..operators.markers import marker_features, marker_summary
from ..operators.scoring import GateWeights
from ..operators.sequences import chunk_overlap
from ..session import build_session, materialize, scratch_run
from ..sources.fasta import read_fasta, write_protein_fasta
from ..sources.hits_json import write_hits_json
from ..sources.models import load_calibration, load_marker_ref, read_fold_configs, select_folds
from ..sources.reports import load_staged_features, stage_features, write_report
from ..sources.tables import read_alignment_hits, read_marker_metadata
from .checks import TableCheck, require_paths, require_unique, validate_inputs
from .predict import Ensemble, protein_table, report_run, run_features, score_folds, score_model

_NUMBERS = T.ArrayType(T.DoubleType())
ENSEMBLE_SCHEMA = T.StructType(
    [
        T.StructField("host_classes", T.ArrayType(T.IntegerType())),
        T.StructField("domain_features", T.ArrayType(T.StringType())),
        T.StructField("host_features", T.ArrayType(T.StringType())),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("base_scores", T.MapType(T.StringType(), T.StructType(
            [T.StructField("domain", T.DoubleType()), T.StructField("host", T.DoubleType())]
        ))),
        T.StructField(
            "gates",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("hidden_weight", T.ArrayType(_NUMBERS)),
                        T.StructField("hidden_bias", _NUMBERS),
                        T.StructField("out_weight", _NUMBERS),
                        T.StructField("out_bias", T.DoubleType()),
                    ]
                ),
            ),
        ),
    ]
)


def load_folder(
    spark: SparkSession, folder: str, folds: list[str], calibration: str | None = None, names: dict[str, str] | None = None
) -> Ensemble:
    """The given folds of one model folder, called by ``names`` where that renames them."""
    names = {fold: (names or {}).get(fold, fold) for fold in folds}
    configs = read_fold_configs(spark, folder)
    first = configs.where(configs.fold == folds[0]).first()
    mapping = {int(k): v for k, v in (first["label_mapping"] or {}).items()}
    spec = spark.read.json(f"{folder}/ensemble.json", ENSEMBLE_SCHEMA, multiLine=True).first()
    gates = {
        names[fold]: GateWeights(g["hidden_weight"], g["hidden_bias"], g["out_weight"], g["out_bias"])
        for fold, g in (spec["gates"] or {}).items()
        if fold in names
    }
    differing = [
        c for c in ("label_mapping", "num_classes", "gate_marker_dim", "raw_feature_dim")
        if configs.where(configs.fold.isin(folds)).select(F.to_json(F.struct(c))).distinct().count() > 1
    ]
    if differing:
        raise ValueError(f"the folds differ in {differing}")
    own = spec["base_scores"] or {}
    common = spec["base_score"] or 0.0
    base = {
        part: {names[f]: own[f][part] if f in own and own[f][part] is not None else common for f in folds}
        for part in ("domain", "host")
    }

    def of_folds(table: DataFrame) -> DataFrame:
        called = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        return table.where(F.col("fold").isin(folds)).withColumn("fold", called[F.col("fold")])

    lists = {k: list(spec[k]) for k in ("domain_features", "host_features") if spec[k]}
    return Ensemble(
        folds=[names[fold] for fold in folds],
        labels=label_list(mapping, len(mapping) or first["num_classes"]),
        calibration=load_calibration(spark, calibration or f"{folder}/calibration.json"),
        marker_ref=of_folds(load_marker_ref(spark, f"{folder}/marker_ref")),
        domain_trees=of_folds(spark.read.parquet(f"{folder}/domain_trees")),
        host_trees=of_folds(spark.read.parquet(f"{folder}/host_trees")),
        host_classes=list(spec["host_classes"]),
        gates=gates,
        gate_marker_dim=first["gate_marker_dim"],
        raw_feature_dim=first["raw_feature_dim"],
        base_score=base["domain"],
        host_base_score=base["host"],
        **lists,
    )


def join_ensembles(parts: list[Ensemble]) -> Ensemble:
    """One ensemble of the folds of several. They must agree in classes, features, dimensions and in having gates."""
    first = parts[0]
    same = ("labels", "host_classes", "domain_features", "host_features", "gate_marker_dim", "raw_feature_dim", "calibration")
    differing = [name for name in same if any(getattr(p, name) != getattr(first, name) for p in parts)]
    if len({bool(p.gates) for p in parts}) > 1:
        differing.append("gates")
    if differing:
        raise ValueError(f"the model folders differ in {differing}")
    tables = {
        name: reduce(DataFrame.unionByName, [getattr(p, name) for p in parts])
        for name in ("marker_ref", "domain_trees", "host_trees")
    }
    joined = {
        name: {k: v for p in parts for k, v in getattr(p, name).items()} for name in ("gates", "base_score", "host_base_score")
    }
    return replace(first, folds=[fold for p in parts for fold in p.folds], **tables, **joined)


def _picked_folders(folders: list[str]) -> dict[str, list[str]]:
    """Fold folders by the model folder they lie in, in the order they are named."""
    found: dict[str, list[str]] = {}
    for path in folders:
        parent, _, fold = path.rstrip("/").rpartition("/")
        own = found.setdefault(parent or ".", [])
        if fold in own:
            raise ValueError(f"fold folder named twice: {path}")
        own.append(fold)
    return found


def load_ensemble(spark: SparkSession, options: argparse.Namespace) -> Ensemble:
    """The selected folds of ``--ensemble-dir``, or the fold folders of ``--fold-dirs``, from any number of model folders.

    A fold whose name stands in two model folders is called ``folder/fold``. ``--calibration`` holds for all;
    without it the model folders must hold the same calibration.
    """
    if not options.fold_dirs:
        configs = read_fold_configs(spark, options.ensemble_dir)
        folds = select_folds(configs, options.folds, options.fold_index, options.num_folds)
        return load_folder(spark, options.ensemble_dir, folds, options.calibration)
    picked = _picked_folders(options.fold_dirs)
    for folder, folds in picked.items():
        select_folds(read_fold_configs(spark, folder), folds, num_folds=len(folds))
    counted = Counter(fold for folds in picked.values() for fold in folds)
    parts = [
        load_folder(
            spark, folder, folds, options.calibration,
            {fold: f"{folder.rpartition('/')[2]}/{fold}" for fold in folds if counted[fold] > 1},
        )
        for folder, folds in picked.items()
    ]
    names = [fold for part in parts for fold in part.folds]
    if len(set(names)) < len(names):
        raise ValueError(f"model folders of one name hold folds of one name: {names}")
    return join_ensembles(parts)


def run_proteins(spark: SparkSession, o: argparse.Namespace) -> None:
    chunks = chunk_overlap(read_fasta(spark, o.fasta), o.chunk_size, o.overlap)
    chunks = spread(chunks, "accession")
    orfs = gene_chain(chunks) if o.one_chain else orf_scan(chunks)
    write_protein_fasta(protein_table(orfs), f"{o.output}/{o.prefix}.proteins")


def marker_search(spark: SparkSession, path: str):
    """The search of proteins against the markers of a FASTA file, which are named like the marker table."""
    markers = read_fasta(spark, path).select(F.col("accession").alias("target"), "seq")

    def search(proteins: DataFrame) -> DataFrame:
        queries = proteins.select(F.col("protein_id").alias("query"), F.col("amino_acid_sequence").alias("seq"))
        return search_alignments(queries, markers)

    return search


def load_models(name: str, folds: list[str]) -> dict:
    """``make_predict`` of each fold from ``package.module:function``."""
    module, _, function = name.partition(":")
    if not function:
        raise ValueError("a model is named package.module:function")
    make = getattr(import_module(module), function)
    return {fold: make(fold) for fold in folds}


def _features(spark: SparkSession, o: argparse.Namespace):
    return run_features(
        read_fasta(spark, o.fasta),
        read_marker_metadata(spark, o.metadata),
        read_alignment_hits(spark, o.hits) if o.hits else marker_search(spark, o.marker_proteins),
        o.chunk_size,
        o.overlap,
        o.evalue,
        o.min_coverage,
        o.min_identity,
        o.one_chain,
    )


def run_feature_job(spark: SparkSession, o: argparse.Namespace) -> None:
    tables = _features(spark, o)
    folder = f"{o.output}/{o.prefix}"
    stage_features(folder, tables.arch, tables.best, tables.annotations, o.mode)
    staged = [spark.read.parquet(f"{folder}/{name}") for name in ("arch_features", "hits", "annotations")]
    write_report(staged[0], f"{folder}.arch_features.tsv", o.mode)
    write_report(staged[2], f"{folder}.viral_marker_genes.tsv", o.mode)
    if o.hits_json:
        write_hits_json(staged[1], f"{folder}.hits.json", mode=o.mode)


def _staged_or_new(
    spark: SparkSession, o: argparse.Namespace
) -> tuple[DataFrame, DataFrame, DataFrame]:
    if o.features:
        sequences = read_fasta(spark, o.fasta)
        require_unique(sequences)
        chunks = chunk_overlap(sequences, o.chunk_size, o.overlap)
        kept = ["seq"] if o.model else []
        index = materialize(chunks.select("genome", "accession", "chunk_len", *kept), "chunk-index")
        staged = load_staged_features(spark, o.features, index)
        write_report(spark.read.parquet(f"{o.features}/annotations"), f"{o.output}/{o.prefix}.viral_marker_genes.tsv", o.mode)
        return (index, *staged)
    tables = _features(spark, o)
    write_report(tables.annotations, f"{o.output}/{o.prefix}.viral_marker_genes.tsv", o.mode)
    return tables.chunks, tables.arch, tables.best


def input_paths(o: argparse.Namespace) -> dict[str, str]:
    """All that a job is going to read, by what it is for."""
    found = {"sequences": o.fasta}
    if o.job == "proteins":
        return found
    if getattr(o, "features", None):
        found |= {f"staged {name}": f"{o.features}/{name}" for name in ("arch_features", "hits", "annotations")}
    else:
        found |= {"alignment hits": o.hits} if o.hits else {"marker proteins": o.marker_proteins}
        found["marker table"] = o.metadata
    if o.job == "features":
        return found
    folders = _picked_folders(o.fold_dirs) if o.fold_dirs else {o.ensemble_dir: o.folds or ["fold_*"]}
    for folder, folds in folders.items():
        found |= {f"{folder}: {name}": f"{folder}/{name}" for name in ("ensemble.json", "marker_ref", "domain_trees", "host_trees")}
        found |= {f"{folder}: {fold}": f"{folder}/{fold}/config.json" for fold in folds}
        found |= {"calibration": o.calibration} if o.calibration else {f"{folder}: calibration": f"{folder}/calibration.json"}
    return found | ({"model logits": o.model_logits} if o.model_logits else {})


def run_predict(spark: SparkSession, o: argparse.Namespace) -> None:
    model = load_ensemble(spark, o)
    logits = spark.read.parquet(o.model_logits) if o.model_logits else None
    given = [TableCheck("marker reference", model.marker_ref, ["fold", "marker", "class_code", "cutoff"], ["fold", "marker"])]
    if logits is not None:
        given.append(TableCheck("model logits", logits, ["fold", "accession", "logits"], ["fold", "accession"]))
    validate_inputs(spark, given)
    chunks, arch, best = _staged_or_new(spark, o)
    if o.model:
        models = load_models(o.model, model.folds)
        logits = score_model(chunks, models, ["seq"], o.batch_size, o.pad_tolerance)
    scores = score_folds(chunks.select("genome", "accession", "chunk_len"), arch, best, model, logits, o.mask_features, o.mask_target)
    scores = materialize(scores, "fold-scores")
    features = None
    if o.save_features:
        summary = marker_summary(chunks, best, model.marker_ref, model.folds[:1])
        wide = assemble_features(arch, marker_features(summary))
        features = union_feature_columns(wide, o.mask_features, o.mask_target)
    reports = report_run(scores, model, o.aggregation_mode, o.aggregate_chunks, o.model_scores, features)
    for name in ("chunks", "folds", "genomes", "model_scores", "features"):
        table = getattr(reports, name)
        if table is not None:
            write_report(table, f"{o.output}/{o.prefix}.{name}.tsv", o.mode)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqharbor", description=__doc__.splitlines()[0])
    jobs = top.add_subparsers(dest="job", required=True)
    for name, run in (("proteins", run_proteins), ("features", run_feature_job), ("predict", run_predict)):
        job = jobs.add_parser(name)
        job.set_defaults(run=run)
        job.add_argument("--fasta", required=True)
        job.add_argument("--output", required=True)
        job.add_argument("--prefix", default="run")
        job.add_argument("--force", dest="mode", action="store_const", const="overwrite", default="error")
        job.add_argument("--chunk-size", type=int, default=10000)
        job.add_argument("--overlap", type=int, default=1000)
        job.add_argument("--one-chain", action="store_true", help="choose among overlapping genes by their coding score")
        if name == "proteins":
            continue
        job.add_argument("--hits", help="alignment hits of the proteins, 11 columns")
        job.add_argument("--marker-proteins", help="FASTA of the markers, searched in place of --hits")
        job.add_argument("--metadata", help="marker table")
        job.add_argument("--evalue", type=float, default=1e-3)
        job.add_argument("--min-coverage", type=float, default=0.0)
        job.add_argument("--min-identity", type=float, default=0.0, help="share of equal residues, with --marker-proteins")
        if name == "features":
            job.add_argument("--hits-json", action="store_true")
            continue
        job.add_argument("--features", help="folder staged by the features job")
        models = job.add_mutually_exclusive_group(required=True)
        models.add_argument("--ensemble-dir", help="one model folder")
        models.add_argument("--fold-dirs", nargs="+", help="fold_* folders of one or several model folders")
        job.add_argument("--model-logits", help="Parquet (fold, accession, logits) of the sequence model")
        job.add_argument("--model", help="package.module:function, from a fold to its make_predict over sequences")
        job.add_argument("--batch-size", type=int, default=16)
        job.add_argument("--pad-tolerance", type=int, default=200)
        job.add_argument("--calibration")
        job.add_argument("--folds", nargs="*")
        job.add_argument("--fold-index", type=int)
        job.add_argument("--num-folds", type=int, default=5)
        job.add_argument("--aggregation-mode", choices=MODES, default="logit")
        job.add_argument("--aggregate-chunks", action=argparse.BooleanOptionalAction, default=True)
        job.add_argument("--mask-features", choices=list(MASKS), default="none")
        job.add_argument("--mask-target", choices=TARGETS, default="all")
        job.add_argument("--model-scores", action="store_true")
        job.add_argument("--save-features", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = parser()
    options = top.parse_args(argv)
    if options.job != "proteins" and not getattr(options, "features", None):
        if not ((options.hits or options.marker_proteins) and options.metadata):
            top.error("--hits or --marker-proteins, and --metadata, are needed without staged features")
    spark = spark or build_session()
    require_paths(spark, input_paths(options))
    with scratch_run(spark, options.job):
        options.run(spark, options)
