from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from seqharbor.plans import cli
from seqharbor.plans.checks import require_unique
from seqharbor.sources import fasta, hits_json


def read(spark, path):
    return spark.read.csv(path, sep="\t", header=True)


def model_folder(spark, folder):
    from catalog import features, load, scoring

    load()
    labels = ["Metazoa (All Animals)", "Viridiplantae (Plants)", "Fungi", "Protist", "Prokaryote"]
    for i in range(2):
        (folder / f"fold_{i}").mkdir(parents=True)
        (folder / f"fold_{i}" / "config.json").write_text(
            json.dumps({"label_mapping": dict(enumerate(labels)), "gate_marker_dim": 1, "raw_feature_dim": 13}, indent=1)
        )
    (folder / "calibration.json").write_text('{"classes": {"0": {"w0": 0.1, "w1": 0.0}}}')
    gates = {n: vars(g) for n, g in scoring.GATES.items()}
    (folder / "ensemble.json").write_text(json.dumps({"host_classes": [0, 1, 2, 3], "gates": gates}))
    ref = [(f"fold_{i}", f"m{k}", "KAT"[k], 50.0) for i in range(2) for k in range(3)]
    spark.createDataFrame(ref, "fold string, marker string, class_code string, cutoff double").write.parquet(
        str(folder / "marker_ref"))
    features.trees(spark, features.TREES).write.parquet(str(folder / "domain_trees"))
    features.trees(spark, features.HOST_TREES).write.parquet(str(folder / "host_trees"))


def constant_model(fold):
    """A model that ignores its sequences."""
    return lambda: lambda seqs: [[float(i) for i in range(5)] for _ in seqs]


def test_jobs(spark, tmp_path):
    rng = random.Random(2)
    text = "".join(f">g{i} some virus\n" + "".join(rng.choice("ACGT") for _ in range(n)) + "\n" for i, n in enumerate((900, 2500)))
    (tmp_path / "in.fasta").write_text(text)
    (tmp_path / "markers.tsv").write_text("marker\tspecificity_class\nm0\tVV\nm1\tvv\nm2\tCC\n")
    model_folder(spark, tmp_path / "models")
    common = ["--fasta", str(tmp_path / "in.fasta"), "--output", str(tmp_path / "out"), "--chunk-size", "1000", "--overlap", "100"]

    cli.main(["proteins", *common], spark)
    proteins = fasta.read_fasta(spark, str(tmp_path / "out" / "run.proteins"))
    assert proteins.count() > 0
    cli.main(["proteins", *common, "--one-chain", "--prefix", "chain"], spark)
    chain = fasta.read_fasta(spark, str(tmp_path / "out" / "chain.proteins"))
    assert chain.select("seq").subtract(proteins.select("seq")).count() == 0 and chain.count() < proteins.count()
    size = F.col("seq_len").cast("string")
    one = F.lit("1")
    line = F.concat_ws("\t", "accession", F.concat(F.lit("m"), F.col("seq_len") % 3), F.lit("1e-8"), size, size, size, one, size, one, size, size)
    proteins.select(line.alias("value")).write.text(str(tmp_path / "hits"))
    searched = ["--hits", str(tmp_path / "hits"), "--metadata", str(tmp_path / "markers.tsv")]

    cli.main(["features", *common, *searched, "--hits-json"], spark)
    staged = str(tmp_path / "out" / "run")
    assert read(spark, staged + ".arch_features.tsv").count() == 4
    best = spark.read.parquet(staged + "/hits")
    assert sorted(map(str, hits_json.read_hits_json(spark, staged + ".hits.json").collect())) == sorted(map(str, best.collect()))

    chunks = spark.read.parquet(staged + "/arch_features").select("accession")
    folds = F.explode(F.array(F.lit("fold_0"), F.lit("fold_1")))
    logits = chunks.select(folds.alias("fold"), "accession", F.array(*[F.lit(float(i)) for i in range(5)]).alias("logits"))
    logits.write.parquet(str(tmp_path / "logits"))
    models = ["--ensemble-dir", str(tmp_path / "models"), "--num-folds", "2"]
    cli.main(["predict", *common, "--features", staged, *models, "--model-logits", str(tmp_path / "logits"), "--prefix", "two",
              "--model-scores", "--save-features"], spark)
    out = str(tmp_path / "out" / "two")
    assert read(spark, out + ".chunks.tsv").count() == 4 and read(spark, out + ".folds.tsv").count() == 8
    assert {r["genome"] for r in read(spark, out + ".genomes.tsv").collect()} == {"g0", "g1"}
    assert "Animal" in read(spark, out + ".chunks.tsv").columns
    assert "glm_Plant" in read(spark, out + ".model_scores.tsv").columns
    assert read(spark, out + ".features.tsv").count() == 4

    # One job without staging gives the same calls.
    cli.main(["predict", *common, *searched, *models, "--model-logits", str(tmp_path / "logits"), "--prefix", "one"], spark)
    once = str(tmp_path / "out" / "one")
    for name in (".chunks.tsv", ".folds.tsv", ".genomes.tsv"):
        assert sorted(map(str, read(spark, once + name).collect())) == sorted(map(str, read(spark, out + name).collect()))

    # From FASTA alone: the markers are searched here, and the model is named on the command line.
    first = proteins.where(F.length("seq") > 60).orderBy("accession").first()["seq"]
    (tmp_path / "markers.fasta").write_text(f">m0\n{first}\n>m1\nACDEFGHIKLMNPQRSTVWY\n")
    own = ["--marker-proteins", str(tmp_path / "markers.fasta"), "--metadata", str(tmp_path / "markers.tsv"), "--min-identity", "0.9"]
    cli.main(["predict", *common, *own, *models, "--model", f"{__name__}:constant_model", "--prefix", "own"], spark)
    assert read(spark, str(tmp_path / "out" / "own.chunks.tsv")).count() == 4
    genes = read(spark, str(tmp_path / "out" / "own.viral_marker_genes.tsv")).collect()
    assert genes and {r["marker_id"] for r in genes} == {"m0"} and min(float(r["evalue"]) for r in genes) < 1e-10
    cli.main(["predict", *common, "--features", staged, *models, "--model", f"{__name__}:constant_model", "--prefix", "staged"], spark)
    assert read(spark, str(tmp_path / "out" / "staged.folds.tsv")).count() == 8

    with pytest.raises(ValueError, match="chunk"):
        cli.main(["predict", *common[:-4], "--features", staged, *models, "--prefix", "bad"], spark)
    with pytest.raises(SystemExit):
        cli.main(["predict", *common, *models], spark)


def test_folds_of_several_model_folders(spark, tmp_path):
    for name in ("a", "b"):
        model_folder(spark, tmp_path / name)
    fold = lambda name, i: str(tmp_path / name / f"fold_{i}")
    options = lambda *rest: cli.parser().parse_args(["predict", "--fasta", "x", "--output", "y", *rest])

    one = cli.load_ensemble(spark, options("--ensemble-dir", str(tmp_path / "a"), "--num-folds", "2"))
    mixed = cli.load_ensemble(spark, options("--fold-dirs", fold("b", 1), fold("a", 0)))
    assert mixed.folds == ["fold_1", "fold_0"] and set(mixed.gates) == set(one.gates) == {"fold_0", "fold_1"}
    for name in ("marker_ref", "domain_trees", "host_trees"):
        tables = [sorted(map(str, getattr(e, name).collect())) for e in (one, mixed)]
        assert tables[0] == tables[1] and tables[0]

    both = cli.load_ensemble(spark, options("--fold-dirs", fold("a", 0), fold("b", 0) + "/", fold("b", 1)))
    assert both.folds == ["a/fold_0", "b/fold_0", "fold_1"] and set(both.gates) == set(both.folds) == set(both.base_score)
    counts = {r["fold"]: r["count"] for r in both.domain_trees.groupBy("fold").count().collect()}
    assert set(counts) == set(both.folds) and counts["a/fold_0"] == counts["b/fold_0"]

    with pytest.raises(ValueError, match="folds not found"):
        cli.load_ensemble(spark, options("--fold-dirs", fold("a", 0), fold("b", 7)))
    with pytest.raises(ValueError, match="twice"):
        cli.load_ensemble(spark, options("--fold-dirs", fold("a", 0), fold("a", 0)))
    (tmp_path / "b" / "calibration.json").write_text('{"classes": {"0": {"w0": 0.7, "w1": 0.0}}}')
    with pytest.raises(ValueError, match="calibration"):
        cli.load_ensemble(spark, options("--fold-dirs", fold("a", 0), fold("b", 1)))
    given = str(tmp_path / "a" / "calibration.json")
    assert cli.load_ensemble(spark, options("--fold-dirs", fold("a", 0), fold("b", 1), "--calibration", given)).calibration == one.calibration
    with pytest.raises(SystemExit):
        options("--fold-dirs", fold("a", 0), "--ensemble-dir", str(tmp_path / "a"))


def test_inputs_are_checked_before_a_job_runs(spark, tmp_path):
    model_folder(spark, tmp_path / "models")
    (tmp_path / "in.fasta").write_text(">g0\n" + "ACGT" * 100 + "\n")
    common = ["predict", "--fasta", str(tmp_path / "*.fasta"), "--output", str(tmp_path / "out"), "--features", str(tmp_path / "staged")]
    with pytest.raises(FileNotFoundError) as raised:
        cli.main([*common, "--fold-dirs", str(tmp_path / "models" / "fold_0"), str(tmp_path / "none" / "fold_1"), "--model-logits", str(tmp_path / "logits")], spark)
    text = str(raised.value)
    named = ("staged/arch_features", "staged/hits", "staged/annotations", "none/ensemble.json", "none/marker_ref", "none/domain_trees",
             "none/host_trees", "none/fold_1/config.json", "none/calibration.json", "logits")
    assert text.count("\n") == len(named) and all(f"{tmp_path}/{name}" in text for name in named)

    for name in ("arch_features", "hits", "annotations"):
        (tmp_path / "staged" / name).mkdir(parents=True)
    twice = [("fold_0", "g0_1", [0.0] * 5)] * 2 + [(None, "g0_1", [0.0] * 5)]
    spark.createDataFrame(twice, "fold string, accession string, logits array<double>").write.parquet(str(tmp_path / "logits"))
    with pytest.raises(ValueError) as raised:
        cli.main([*common, "--ensemble-dir", str(tmp_path / "models"), "--num-folds", "2", "--model-logits", str(tmp_path / "logits")], spark)
    assert "model logits: null key fold|accession (1)" in str(raised.value)
    assert "model logits: duplicate key fold_0|g0_1 (2)" in str(raised.value)


def test_an_error_lists_a_bounded_number_of_problems(spark):
    frame = spark.range(300).selectExpr("cast(id % 150 as string) accession")
    with pytest.raises(ValueError) as raised:
        require_unique(frame)
    assert len(str(raised.value).splitlines()) == 102 and str(raised.value).endswith("and more")
