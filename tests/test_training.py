from __future__ import annotations

import math

import numpy as np
import pytest

from seqharbor.operators import training as ops


def labelled(spark, **counts):
    rows = [(f"{name}{i}", name) for name, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "accession string, label string")


def test_index_and_join(spark, rows):
    labels = labelled(spark, b=2, a=1)
    assert rows(ops.label_index(labels)) == [("a", 0), ("b", 1)]
    seqs = spark.createDataFrame([("a0", "AC"), ("x", "GT")], "accession string, seq string")
    assert rows(ops.join_labels(seqs, labels)) == [("a0", "AC", "a")]
    assert rows(ops.skipped_sequences(seqs, labels)) == [("x",)]
    with pytest.raises(Exception, match="no label for x"):
        ops.join_labels(seqs, labels, strict=True).collect()
    with pytest.raises(ValueError, match="no sequence has a label"):
        ops.class_counts(labels.limit(0))


def test_distribution_and_weights(spark, rows):
    df = labelled(spark, a=1, b=3)
    assert rows(ops.class_distribution(df)) == [("a", 1, 25.0), ("b", 3, 75.0)]
    assert rows(ops.class_weights(df)) == [("a", 2.0), ("b", pytest.approx(4 / 6))]
    assert rows(ops.class_weights(df, 4))[0] == ("a", 1.0)


def test_split_quotas():
    assert ops.split_quotas([("a", 10), ("b", 5)], 0.2) == {"a": 2, "b": 1}
    quotas = ops.split_quotas([("a", 7), ("b", 7), ("c", 7)], 0.2)
    assert sum(quotas.values()) == math.ceil(21 * 0.2) and max(quotas.values()) - min(quotas.values()) <= 1
    for bad in ([("a", 1), ("b", 9)], [("a", 2), ("b", 2)]):
        with pytest.raises(ValueError):
            ops.split_quotas(bad, 0.2)


def test_split(spark, rows):
    df = labelled(spark, a=40, b=10)
    split = ops.stratified_split(df, 0.2, 1)
    assert rows(split.groupBy("label", "split").count()) == [
        ("a", "train", 32), ("a", "val", 8), ("b", "train", 8), ("b", "val", 2)]
    assert rows(split) == rows(ops.stratified_split(df.repartition(9), 0.2, 1))
    assert rows(split) != rows(ops.stratified_split(df, 0.2, 2))


def test_undersampling(spark, rows):
    df = labelled(spark, p=50, x=6, y=4)
    draw = lambda **k: ops.undersample_class(df, "p", **k)
    assert rows(ops.sampled_counts(draw())) == [("p", 10), ("x", 6), ("y", 4)]
    assert rows(ops.sampled_counts(draw(max_prop=0.9))) == [("p", 50), ("x", 6), ("y", 4)]
    assert draw(max_prop=1.0).count() == 60 and draw(max_prop=0.0).count() == 10
    picked = [{r[0] for r in draw(epoch=e).where("label = 'p'").select("accession").collect()} for e in (0, 0, 1)]
    assert picked[0] == picked[1] != picked[2]
    assert ops.undersample_class(df, "absent").count() == 60
    assert ops.undersample_quota(10, 99, 0.6) == int(10 * 0.6 / (1 - 0.6))


def test_training_sets(spark):
    seqs = spark.createDataFrame([(f"a{i}", "ACGT") for i in range(10)] + [(f"b{i}", "GG") for i in range(10)] + [("z", "T")],
                                 "accession string, seq string")
    labels = labelled(spark, a=10, b=10)
    features = spark.createDataFrame([(f"{g}{i}", float(i), 1.0) for g in "ab" for i in range(10)],
                                     "accession string, x double, y double")
    table = ops.load_training_set(seqs, labels, features)
    assert table.count() == 20 and table.where("split = 'val'").count() == 4
    assert table.where("accession = 'b3'").select("label_idx", "features").first() == (1, [3.0, 1.0])
    with pytest.raises(Exception, match="no features"):
        ops.load_training_set(seqs, labels, features.where("x < 5")).collect()
    with pytest.raises(Exception, match="no label for z"):
        ops.load_fold_training_set(seqs, labels, features).collect()
    fold = ops.load_fold_training_set(seqs.where("accession <> 'z'"), labels, features.where("x < 5").select("accession", "x"), features)
    row = fold.where("accession = 'a7'").first()
    assert row["features"] == [0.0] and row["raw_features"] == [7.0, 1.0] and row["label_idx"] == 0


def test_losses(spark):
    logits = [[2.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.5, 0.5, 3.0], [0.0, 0.0, 0.0]]
    labels = [0, 1, 0, 2]
    df = spark.createDataFrame(list(zip(logits, labels)), "logits array<double>, label int")
    counts = ops.samples_per_class(df, 3)
    assert counts == [2, 1, 1]
    weights = ops.class_balanced_weights(counts, 0.9)
    assert sum(weights) == pytest.approx(3.0) and weights[0] < weights[1]
    assert ops.class_balanced_weights([0, 5], 0.9)[0] > 1.9
    x = np.array(logits)
    nll = np.log(np.exp(x).sum(1)) - x[np.arange(4), labels]
    w = np.array(weights)[labels]
    p = np.exp(-nll)
    assert ops.class_balanced_loss(df, 3, 0.9, counts).first()[0] == pytest.approx((w * nll).sum() / w.sum())
    assert ops.class_balanced_loss(df, 3, 0.9, counts, "focal").first()[0] == pytest.approx((w * (1 - p) ** 2 * nll).mean())
    assert ops.focal_loss(df, 3, gamma=1.0).first()[0] == pytest.approx(((1 - p) * nll).mean())
    with pytest.raises(ValueError):
        ops.class_balanced_loss(df, 3, 0.9, counts, "other")


def test_computed_features(spark):
    seqs = spark.createDataFrame([(f"{g}{i}", "GCC" * (100 + i)) for g in "ab" for i in range(5)], "accession string, seq string")
    table = ops.load_training_set(seqs, labelled(spark, a=5, b=5), compute_features=True)
    row = table.where("accession = 'a0'").first()
    assert table.count() == 10 and len(row["features"]) == 12
    assert row["features"][1] == pytest.approx(6 * 299 / 300, abs=0.02)  # six open frames
