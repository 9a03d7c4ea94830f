from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seqharbor.constants import ARCH_FEATURES, ARCH_MODEL_FEATURES, DOMAIN_MARKER_FEATURES, HOST_MARKER_FEATURES
from seqharbor.operators import features as ops


def wide(spark):
    arch = spark.createDataFrame(
        [("a", *[float(i) for i in range(13)], 4), ("b", 0.5, *[None] * 12, 0)],
        "accession string, " + ", ".join(f"{c} double" for c in ARCH_FEATURES) + ", n_genes bigint",
    )
    names = DOMAIN_MARKER_FEATURES + HOST_MARKER_FEATURES
    markers = spark.createDataFrame(
        [(f, a, *[0.25] * len(names)) for f in ("fold_0", "fold_1") for a in ("a", "b")],
        "fold string, accession string, " + ", ".join(f"{c} double" for c in names),
    )
    return ops.assemble_features(arch, markers)


def test_matrices_and_masks(spark):
    rows = wide(spark)
    assert rows.count() == 4
    domain, host = ops.domain_matrix(rows), ops.host_matrix(rows)
    assert domain.columns[2:] == ARCH_MODEL_FEATURES + DOMAIN_MARKER_FEATURES
    assert host.columns[2:] == ARCH_MODEL_FEATURES + HOST_MARKER_FEATURES
    assert ops.union_feature_columns(rows).columns[2:] == (
        ARCH_MODEL_FEATURES + DOMAIN_MARKER_FEATURES + HOST_MARKER_FEATURES
    )
    at = "accession = 'a' and fold = 'fold_0'"
    masked = ops.domain_matrix(rows, "density", "all").where(at).first()
    assert masked["gene_density"] is None and masked["strand_switch_rate"] is None and masked["leaderless_freq"] == 3.0
    assert ops.host_matrix(rows, "boundary", "domain_only").where(at).first()["leaderless_freq"] == 3.0
    assert ops.host_matrix(rows, "boundary", "host_only").where(at).first()["short_utr_freq"] is None
    assert ops.union_feature_columns(rows, "density", "host_only").where(at).first()["gene_density"] == 10.0
    for bad in (("other", "all"), ("density", "other")):
        with pytest.raises(ValueError):
            ops.domain_matrix(rows, *bad)


def test_model_selection(spark):
    domain = ops.domain_matrix(wide(spark))
    chosen = ops.select_model_features(domain, ["gene_density", "coding_density"], "m")
    assert chosen.dtypes[2:] == [("gene_density", "float"), ("coding_density", "float")]
    with pytest.raises(ValueError, match="no feature list"):
        ops.select_model_features(domain, [], "m")
    with pytest.raises(ValueError, match="nothing_like_it"):
        ops.select_model_features(domain, ["nothing_like_it"], "m")


def test_gate_inputs(spark):
    rows = wide(spark).withColumn("probs", F.array(F.lit(0.25), F.lit(0.75)))
    got = {r["accession"]: r for r in ops.gate_inputs(rows, 13, 1).where("fold = 'fold_0'").collect()}
    assert got["a"]["raw"] == [float(i) for i in range(13)] and got["a"]["features"] == [0.25, 0.75, 4.0]
    assert got["b"]["raw"] == [0.5] + [0.0] * 12
    assert ops.gate_inputs(rows).first()["features"] == [0.25, 0.75]
    with pytest.raises(ValueError):
        ops.gate_inputs(rows, 12)


def test_align(spark, rows):
    table = spark.createDataFrame([("a", 1.5), ("b", float("nan"))], "accession string, x double")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "accession string")
    assert rows(ops.align_features(keys, table)) == [("a", 1.5), ("b", 0.0), ("c", 0.0)]
    with pytest.raises(Exception, match="no features for c"):
        ops.align_features(keys, table, strict=True).collect()
    assert ops.align_features(keys.where("accession < 'c'"), table, strict=True).count() == 2
