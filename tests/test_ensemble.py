from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from seqharbor.operators import calibration as cal
from seqharbor.operators import ensemble as ops
from seqharbor.sources.models import Calibration, Posthoc

LABELS = ["Animal", "Fungi", "Prokaryotes"]
FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SCALED = Calibration({0: (0.3, -0.2), 1: (-0.1, 0.1)}, 1000.0, Posthoc(1, 0.4, -0.3))


def reference(logits, length, c: Calibration):
    """One row in float64 numpy."""
    ln = math.log(max(length, 1e-6) / c.length_scale)
    heat = np.array([math.exp(a + b * ln) for a, b in c.weights(len(logits))])
    z = np.array(logits) / heat
    p = np.exp(z - z.max())
    p /= p.sum()
    if c.posthoc and int(np.argmax(p)) == c.posthoc.target_class:
        t = min(max(p[c.posthoc.target_class], 1e-7), 1 - 1e-7)
        tc = 1 / (1 + math.exp(-math.log(t / (1 - t)) / math.exp(c.posthoc.w0 + c.posthoc.w1 * ln)))
        q = p * max(1 - tc, 0) / max(1 - t, 1e-8)
        q[c.posthoc.target_class] = tc
        p = q / q.sum()
    return p


def scores(spark, rows):
    return spark.createDataFrame(rows, "accession string, fold string, chunk_len int, logits array<double>")


@FEW
@given(
    st.lists(
        st.tuples(st.integers(0, 20000), st.lists(st.floats(-30, 30), min_size=3, max_size=3)), min_size=1, max_size=20
    )
)
def test_calibration_equals_numpy(spark, data):
    df = scores(spark, [(f"c{i}", "fold_0", n, v) for i, (n, v) in enumerate(data)])
    for c in (SCALED, Calibration({}, 500.0), Calibration({0: (1.0, 0.0)}, 1000.0, Posthoc(2, -0.5))):
        found = {r["accession"]: r["probs"] for r in cal.calibrate(df, c, 3).collect()}
        split = cal.posthoc_top_label(cal.vector_scaling(df, c, 3), c, 3)
        assert found == {r["accession"]: r["probs"] for r in split.collect()}
        for i, (n, v) in enumerate(data):
            assert found[f"c{i}"] == pytest.approx(np.round(reference(v, n, c), 4), abs=1e-4 + 1e-12)
            assert abs(sum(found[f"c{i}"]) - 1) <= 3 * 5e-5 + 1e-12


def test_plain_softmax_and_extremes(spark):
    df = scores(spark, [("a", "fold_0", 0, [1000.0, 0.0, -1000.0]), ("b", "fold_0", 10, [0.0, 0.0, 0.0])])
    found = {r["accession"]: r["probs"] for r in cal.calibrate(df, Calibration(None), 3).collect()}
    assert found == {"a": [1.0, 0.0, 0.0], "b": [0.3333, 0.3333, 0.3333]}


def test_fold_combinations(spark):
    rows = [("a", f"fold_{i}", 900, v) for i, v in enumerate([[1.0, 0.0, -1.0], [0.0, 2.0, 0.0], [0.5, 0.5, 3.0]])]
    df = scores(spark, rows)
    probs = np.array([np.round(reference(v, 900, SCALED), 4) for *_, v in rows])
    mean = np.mean([v for *_, v in rows], axis=0)
    got = lambda mode: ops.combine_folds(df, SCALED, 3, mode).first()["probs"]
    assert got("logit") == pytest.approx(np.round(reference(mean, 900, SCALED), 4), abs=1e-9)
    assert got("probability") == pytest.approx(np.round(probs.mean(0), 4), abs=1e-9)
    h = -(probs * np.log(probs + 1e-9)).sum(1)
    w = 1 / (h + 1e-4)
    assert got("entropy") == pytest.approx(np.round((probs * (w / w.sum())[:, None]).sum(0), 4), abs=1e-9)
    with pytest.raises(ValueError):
        ops.combine_folds(df, SCALED, 3, "other")


def calls(spark, probs, labels=LABELS):
    df = spark.createDataFrame([(f"c{i}", p) for i, p in enumerate(probs)], "accession string, probs array<double>")
    return ops.call_chunks(df, labels).orderBy("accession").collect()


def test_calls_ties_and_conflicts(spark):
    found = calls(spark, [[0.4, 0.4, 0.2], [0.3, 0.3, 0.4], [0.25, 0.25, 0.5], [0.1, 0.2, 0.7]])
    assert [r["predicted_host"] for r in found] == ["Animal", "Unassigned", "Prokaryotes", "Prokaryotes"]
    assert [r["confidence"] for r in found] == [0.4, None, 0.5, 0.7]
    assert [r["chunk_weight"] for r in found] == [0.4, 0.4, 0.5, 0.7]
    assert [r["predicted_domain"] for r in found] == ["Eukaryote", "Eukaryote", "Prokaryote", "Prokaryote"]
    assert [r["domain_confidence"] for r in found] == [0.8, 0.6, 0.5, 0.7]
    plain = calls(spark, [[0.3, 0.3, 0.4]], ["a", "b", "c"])[0]
    assert plain["predicted_host"] == "c" and "predicted_domain" not in plain.asDict()


def test_labels():
    assert ops.label_list({0: "Metazoa (All Animals)", 2: "Viridiplantae (Plants)"}, 3) == ["Animal", "class_1", "Plant"]
    assert ops.prokaryote_index(["x", "All PROKARYOTES", "prokaryote"]) == 1 and ops.prokaryote_index(["x"]) is None


def test_genome_consensus(spark):
    data = [("g_chunk0_10", [0.6, 0.2, 0.2]), ("g_chunk9_19", [0.1, 0.1, 0.8]), ("solo", [0.3, 0.3, 0.4])]
    df = spark.createDataFrame(data, "accession string, probs array<double>")
    found = {r["genome"]: r for r in ops.genome_consensus(df, LABELS).collect()}
    w = np.array([0.6, 0.8])
    mean = (np.array([data[0][1], data[1][1]]) * w[:, None]).sum(0) / w.sum()
    assert found["g"]["predicted_host"] == "Prokaryotes" and found["g"]["confidence"] == pytest.approx(round(mean[2], 4))
    assert found["g"]["predicted_domain"] == "Prokaryote"
    solo = found["solo"]
    assert (solo["predicted_host"], solo["confidence"], solo["predicted_domain"], solo["domain_confidence"]) == (
        "Unassigned", None, "Eukaryote", 0.6)
    carried = df.withColumn("genome", F.lit("all"))
    assert [r["genome"] for r in ops.genome_consensus(carried, LABELS).collect()] == ["all"]


def test_consensus_ignores_partitioning(spark, rows):
    data = [(f"g{i % 3}_chunk{i}_{i + 1}", [0.1 + (i % 7) / 20, 0.2, 0.7 - (i % 7) / 20]) for i in range(60)]
    df = spark.createDataFrame(data, "accession string, probs array<double>")
    run = lambda d: rows(ops.genome_consensus(d, LABELS))
    assert run(df.coalesce(1)) == run(df.repartition(17)) == run(df.orderBy(F.desc("accession")))


def test_reports(spark):
    df = spark.createDataFrame(
        [("a", "fold_0", 5, [0.30004, 0.3, 0.39996], [0.0, 1.0, 2.0], float("nan")),
         ("b", "fold_0", 0, [0.1, 0.8, 0.1], [0.0, 0.0, 0.0], 0.123456)],
        "accession string, fold string, n_genes int, probs array<double>, logits array<double>, alpha double",
    )
    report = {r["accession"]: r for r in ops.fold_report(df, LABELS).collect()}
    assert list(report["a"].asDict()) == ["accession", "fold", "predicted_host", "confidence", "glm_gate_weight", *LABELS]
    # No conflict rule per fold.
    assert report["a"]["predicted_host"] == "Prokaryotes" and report["a"]["glm_gate_weight"] is None
    assert report["b"]["glm_gate_weight"] == 0.1235
    scored = ops.model_scores_report(df, LABELS)
    assert [c for c in scored.columns if c.startswith("uncal")] == [f"uncalibrated_ensemble_{n}" for n in LABELS]
    assert not [c for c in scored.columns if c.startswith(("xgb_", "glm_A"))]
    full = ops.model_scores_report(
        df.withColumn("tree_probs", F.col("probs")).withColumn("model_logits", F.col("logits")), LABELS
    )
    assert full.where("accession = 'b'").first()["glm_Animal"] == 0.3333
    chunk = ops.chunk_report(ops.call_chunks(df, LABELS), LABELS)
    assert chunk.columns == ["accession", "predicted_host", "confidence", *LABELS, "prokaryote_score", "eukaryote_score",
                             "predicted_domain", "domain_confidence"]
