from __future__ import annotations

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from seqharbor.plans import checks, predict
from seqharbor.sources import fasta

SF = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries)
    assert all(callable(f) for f in queries.values())


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["genome", "predicted_domain", "domain_confidence", "predicted_host", "confidence"]
    assert df.count() > 0


def test_problems_are_found_together(spark, rows):
    table = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, v int")
    other = spark.createDataFrame([(1,), (2,)], "v int")
    check = checks.TableCheck("t", table, ["k", "v", "w"], ["k"], {"v": ("other", other, "v")})
    assert rows(checks.find_problems(spark, [check])) == [
        ("t", "duplicate key", "a", 2), ("t", "missing column", "w", 0), ("t", "not in other", "3", 1),
        ("t", "not in other", "4", 1), ("t", "null key", "k", 1)]
    with pytest.raises(ValueError, match="(?s)duplicate key a.*missing column w"):
        checks.validate_inputs(spark, [check])
    checks.validate_inputs(spark, [checks.TableCheck("o", other, ["v"], ["v"])])


def small_run(spark):
    rng = random.Random(11)
    data = [(f"g{i}", "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((50, 900, 2500, 4001))]
    data.append(("g4", "GCC" * 400))  # no stop codon: open in all six frames
    return spark.createDataFrame(data, "accession string, seq string")


def metadata(spark):
    return spark.createDataFrame([("m0", "VV"), ("m1", "vv"), ("m2", "CC")], "marker string, specificity_class string")


def search(proteins):
    size = F.length("amino_acid_sequence").cast("bigint")
    return proteins.select(
        F.col("protein_id").alias("query"), F.concat(F.lit("m"), size % 3).alias("target"), F.lit("1e-9").alias("evalue"),
        (size * 1.0).alias("bits"), *[size.alias(c) for c in ("qlen", "tlen")], F.lit(1).cast("bigint").alias("qstart"),
        size.alias("qend"), F.lit(1).cast("bigint").alias("tstart"), size.alias("tend"), size.alias("alnlen"))


def test_feature_job(spark, rows):
    tables = predict.run_features(small_run(spark), metadata(spark), search, 1000, 100)
    ids = rows(tables.chunks, "accession")
    assert rows(tables.arch, "accession") == ids and ("g0",) in ids and ("g3_chunk3600_4001",) in ids
    assert {r["marker"] for r in tables.best.collect()} == {"m0", "m1"}
    assert tables.annotations.count() == tables.hits.count() > 0
    again = predict.run_features(small_run(spark), metadata(spark), search(tables.proteins), 1000, 100)
    assert rows(again.best) == rows(tables.best)


def test_whole_run_reports(spark, rows):
    from catalog import features, load, runs, scoring, views

    load()
    tables = predict.run_features(small_run(spark), metadata(spark), search, 1000, 100)
    ref = spark.createDataFrame([(f, f"m{i}", "KAT"[i], 50.0) for f in runs.RUN_FOLDS for i in range(3)],
                                "fold string, marker string, class_code string, cutoff double")
    model = predict.Ensemble(
        runs.RUN_FOLDS, views.LABELS, runs.ensemble.CALIBRATION, ref, features.trees(spark, features.TREES),
        features.trees(spark, features.HOST_TREES), [0, 1, 2, 3], scoring.GATES, 1)
    logits = runs.model_logits(tables.chunks)
    n = tables.chunks.count()
    mixed = predict.score_folds(tables.chunks, tables.arch, tables.best, model, logits)
    for mode in ("logit", "probability", "entropy"):
        reports = predict.report_run(mixed, model, mode, model_scores=True)
        assert reports.chunks.count() == n and reports.folds.count() == 2 * n == reports.model_scores.count()
        assert [r["genome"] for r in reports.genomes.collect()] == ["g0", "g1", "g2", "g3", "g4"]
    # No genes: the sequence model decides alone.
    alone = mixed.where("n_genes = 0")
    assert alone.count() and alone.where("alpha <> 1").count() == 0
    trees = predict.score_folds(tables.chunks, tables.arch, tables.best, model)
    assert "alpha" not in trees.columns and trees.count() == 2 * n
    # A split on a density feature: dense chunks go right, a masked one takes the default, left.
    split = [(f, 0, 0, 0, "gene_density", 0.9, 1, 2, True, None) for f in runs.RUN_FOLDS]
    leaves = [(f, 0, 0, i, None, None, None, None, None, 1.0 - i) for f in runs.RUN_FOLDS for i in (1, 2)]
    model = dataclasses.replace(model, domain_trees=features.trees(spark, split + leaves))

    def logits_of(mask, target):
        scored = predict.score_folds(tables.chunks, tables.arch, tables.best, model, None, mask, target)
        return rows(scored.where("n_genes > 1"), "fold", "accession", "logits")

    plain = logits_of("none", "all")
    assert plain and plain == logits_of("density", "host_only") == logits_of("boundary", "all")
    assert not set(map(str, plain)) & set(map(str, logits_of("density", "domain_only")))
    with pytest.raises(ValueError):
        predict.score_folds(tables.chunks, tables.arch, tables.best, model, None, "density", "nobody")


def test_export(spark, rows, tmp_path):
    proteins, notes = str(tmp_path / "p"), str(tmp_path / "n")
    best = predict.export_marker_hits(
        small_run(spark), metadata(spark), search, str(tmp_path / "hits"), proteins, notes)
    assert best.count() > 0 and spark.read.parquet(notes).count() >= best.count()
    assert fasta.read_fasta(spark, proteins).count() > 0
