from __future__ import annotations

import math
import random

import numpy as np
import pytest

from seqharbor.operators import scoring as ops

NODES = (
    "fold string, tree int, class int, node int, feature string, threshold double, left int, right int, "
    "default_left boolean, leaf double"
)


def random_tree(rng, fold, tree, cls, depth, features):
    rows, counter = [], [0]

    def grow(level):
        node = counter[0]
        counter[0] += 1
        if level == 0:
            rows.append((fold, tree, cls, node, None, None, None, None, None, rng.uniform(-1, 1)))
            return node
        at = len(rows)
        rows.append(None)
        left, right = grow(level - 1), grow(level - 1)
        rows[at] = (fold, tree, cls, node, rng.choice(features), rng.uniform(-1, 1), left, right, rng.random() < 0.5, None)
        return node

    grow(depth)
    return rows


def walk(nodes, x):
    node = nodes[0]
    while node[6] is not None:
        value = x.get(node[4])
        left = node[8] if value is None or value != value else np.float32(value) < np.float32(node[5])
        node = nodes[node[6] if left else node[7]]
    return node[9]


@pytest.mark.parametrize("limit", [0, 10_000])
def test_models_are_checked_alike(spark, monkeypatch, limit):
    monkeypatch.setattr(ops, "EXPRESSION_NODES", limit)
    rng = random.Random(9)
    good = random_tree(rng, "fold_0", 0, 0, 2, ["f0"])
    rows = spark.createDataFrame([("fold_0", 0.5), ("fold_9", 0.5)], "fold string, f0 double")
    score = lambda nodes, df=rows, **k: ops.score_trees(df, spark.createDataFrame(nodes, NODES), ["f0"], 2, **k).collect()
    with pytest.raises(Exception, match="no trees for fold fold_9"):
        score(good)
    known = rows.where("fold = 'fold_0'")
    bad = {
        "default branch": [(*n[:8], None, *n[9:]) for n in good],
        "outside 0 to 0": [(n[0], n[1], 3, *n[3:]) for n in good],
        "no node 0": [n for n in good if n[3] != 0],
        "child is missing": [n for n in good if n[3] != max(m[3] for m in good)],
        "stands twice": [*good, good[-1]],
    }
    for words, nodes in bad.items():
        with pytest.raises(ValueError, match=words):
            score(nodes, known)
    with pytest.raises(ValueError, match="no base score"):
        score(good, known, base_score={"other": 1.0})
    both = [*good, *[("fold_1", *n[1:]) for n in good]]
    two = spark.createDataFrame([("fold_0", 0.5), ("fold_1", 0.5)], "fold string, f0 double")
    found = {r["fold"]: r["probs"][1] for r in score(both, two, base_score={"fold_0": 0.0, "fold_1": 1.0})}
    odds = {f: math.log(p / (1 - p)) for f, p in found.items()}
    assert odds["fold_1"] - odds["fold_0"] == pytest.approx(1.0)


def test_erf():
    x = np.r_[np.linspace(-7, 7, 4001), 0.0, 1e-300, 40.0, -40.0]
    assert np.abs(ops.erf(x) - [math.erf(v) for v in x]).max() < 1e-12


@pytest.mark.parametrize("limit", [0, 10_000])
@pytest.mark.parametrize("classes", [2, 3])
def test_trees_equal_a_walk(spark, monkeypatch, limit, classes):
    monkeypatch.setattr(ops, "EXPRESSION_NODES", limit)
    rng = random.Random(classes)
    features = ["f0", "f1", "f2"]
    outputs = 1 if classes == 2 else classes
    trees = [
        random_tree(rng, fold, t, c, 3, features)
        for fold in ("fold_0", "fold_1") for c in range(outputs) for t in range(2)
    ]
    data = [
        (rng.choice(["fold_0", "fold_1"]), f"r{i}", *[rng.choice([None, float("nan"), rng.uniform(-1, 1)]) for _ in features])
        for i in range(40)
    ]
    df = spark.createDataFrame(data, "fold string, accession string, f0 double, f1 double, f2 double")
    nodes = spark.createDataFrame([n for t in trees for n in t], NODES)
    found = {r["accession"]: r["probs"] for r in ops.score_trees(df, nodes, features, classes, 0.25).collect()}
    for fold, name, *x in data:
        margins = [0.25] * outputs
        for t in trees:
            if t[0][0] == fold:
                margins[t[0][2]] += walk({n[3]: n for n in t}, dict(zip(features, x)))
        if classes == 2:
            p = 1 / (1 + math.exp(-margins[0]))
            expected = [1 - p, p]
        else:
            e = np.exp(np.array(margins) - max(margins))
            expected = list(e / e.sum())
        assert found[name] == pytest.approx(expected, abs=1e-12)


def test_trees_need_their_features(spark):
    nodes = spark.createDataFrame([("fold_0", 0, 0, 0, "zz", 0.0, 1, 1, True, None), ("fold_0", 0, 0, 1, None, None, None, None, None, 1.0)], NODES)
    df = spark.createDataFrame([("fold_0", 1.0)], "fold string, f0 double")
    with pytest.raises(ValueError, match="zz"):
        ops.score_trees(df, nodes, ["f0"])


def test_probability_shapes(spark):
    df = spark.createDataFrame([([0.2, 0.8], [0.5, 0.25, 0.25])], "p1 array<double>, p2 array<double>")
    row = df.select(ops.hierarchical_probs("p1", "p2", 5, 3, [0, 1, 4]).alias("p")).first()["p"]
    assert row == pytest.approx([0.4, 0.2, 0.0, 0.2, 0.2])
    wide = spark.createDataFrame([([0.2, 0.8],), ([0.1, 0.2, 0.7],)], "probs array<double>")
    got = [r["probs"] for r in ops.expand_binary_probs(wide, 3, 1).collect()]
    assert got[0] == pytest.approx([0.4, 0.2, 0.4]) and got[1] == [0.1, 0.2, 0.7]
    with pytest.raises(Exception, match="must have"):
        ops.expand_binary_probs(spark.createDataFrame([([1.0],)], "probs array<double>"), 3, 1).collect()


def test_gate_and_mixture(spark):
    rng = np.random.default_rng(3)
    gates = {
        f"fold_{i}": ops.GateWeights(rng.normal(size=(4, 6)).tolist(), rng.normal(size=4).tolist(),
                                     rng.normal(size=4).tolist(), 0.1 * i)
        for i in range(2)
    }
    data = [("fold_0", [1.0, -2.0, None], [0.5, 2.0], [3.0]), ("fold_1", [0.0, 1.0, 4.0], [1.0, -1.0], [0.0]),
            ("fold_1", [0.0, 1.0, 4.0], [1.0, -1.0], [1.0])]
    df = spark.createDataFrame(data, "fold string, raw array<double>, logits array<double>, marker array<double>")
    found = [r["alpha"] for r in ops.gate_alpha(df, gates, 2, 3, 1).collect()]
    for alpha, (fold, raw, logits, marker) in zip(found, data):
        if marker[0] == 0:
            assert alpha == 1.0
            continue
        g = gates[fold]
        e = np.exp(np.array(logits) - max(logits))
        x = [math.log1p(max(v or 0.0, 0.0)) for v in raw] + list(e / e.sum()) + [math.log1p(marker[0])]
        z = np.array(g.hidden_weight) @ x + g.hidden_bias
        h = np.array([v * 0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z])
        assert alpha == pytest.approx(1 / (1 + math.exp(-(h @ g.out_weight + g.out_bias))), abs=1e-12)
    with pytest.raises(ValueError, match="raw"):
        ops.gate_alpha(df.drop("raw"), gates, 2, 3, 1)
    one = spark.createDataFrame([([0.0, 0.0], [0.0, 1.0], 0.5)], "logits array<double>, probs array<double>, alpha double")
    mixed = ops.mix_probs(one, 2).first()["log_probs"]
    assert mixed == pytest.approx([math.log(0.25), math.log(0.75)])


def test_single_streams(spark):
    df = spark.createDataFrame([([1.0, 1.0], [0.0, 1.0]), (None, [0.0, 1.0])], "logits array<double>, probs array<double>")
    both = [r["log_probs"] for r in ops.stream_fallback(df, 2).collect()]
    assert both[0] == pytest.approx([math.log(0.5)] * 2) and both[1] == pytest.approx([math.log(1e-7), 0.0])
    assert df.select(ops.exp_log_probs("probs")).first()[0] == pytest.approx([1.0, math.e])
    bad = spark.createDataFrame([([float("nan"), 1.0],)], "probs array<double>")
    with pytest.raises(Exception, match="NaN"):
        ops.stream_fallback(bad, 2, None).collect()
    with pytest.raises(ValueError):
        ops.stream_fallback(df, 2, None, None)


def test_linear_head(spark):
    x = [1.0, 2.0, 4.0]
    df = spark.createDataFrame([(x,)], "vec array<double>")
    got = ops.linear_head(df, [1.0, 2.0, 1.0], [0.0, 0.1, 0.0], [[1.0, 0.0, 1.0], [0.5, 1.0, 0.0]], [0.0, 1.0]).first()["logits"]
    n = (np.array(x) - np.mean(x)) / np.sqrt(np.var(x) + 1e-5) * [1, 2, 1] + [0, 0.1, 0]
    assert got == pytest.approx([n[0] + n[2], 0.5 * n[0] + n[1] + 1.0])


def pool_frame(spark):
    data = [("a", 0, False, [9.0, 9.0]), ("a", 1, True, [1.0, -2.0]), ("a", 2, True, [3.0, 0.0]), ("b", 5, False, [4.0, 4.0])]
    return spark.createDataFrame(data, "grp string, pos int, mask boolean, vec array<double>")


def test_pooling(spark):
    df = pool_frame(spark)
    pool = lambda how: {r["grp"]: r["pooled"] for r in ops.masked_pooling(df, 2, how).collect()}
    assert pool("mean") == {"a": [2.0, -1.0], "b": [0.0, 0.0]}
    assert pool("max") == {"a": [3.0, 0.0], "b": [-1e9, -1e9]}
    assert pool("cls") == {"a": [9.0, 9.0], "b": [4.0, 4.0]}
    with pytest.raises(ValueError, match="median"):
        ops.masked_pooling(df, 2, "median")


def test_attention_pooling(spark):
    df = pool_frame(spark)
    queries, temps = [[1.0, 0.0], [0.0, 2.0]], [0.01, 2.0]
    heads = []
    for q, t in zip(queries, (0.1, 2.0)):
        v = np.array([[1.0, -2.0], [3.0, 0.0]])
        s = v @ np.array(q) / t
        w = np.exp(s - s.max())
        heads.append((w[:, None] * v).sum(0) / w.sum())
    got = {r["grp"]: r["pooled"] for r in ops.attention_pooling(df, queries, temps, "weighted_sum", [0.25, 0.75]).collect()}
    assert got["a"] == pytest.approx(list(0.25 * heads[0] + 0.75 * heads[1]))
    assert got["b"] == pytest.approx([4.0, 4.0])  # all masked: every row counts alike
    cat = np.concatenate(heads)
    w, b = [[1.0, 2.0, 3.0, 4.0]], [0.5]
    linear = {r["grp"]: r["pooled"] for r in ops.attention_pooling(df, queries, temps, "linear", projection=(w, b)).collect()}
    assert linear["a"] == pytest.approx(list(np.array(w) @ cat + b))
    neck = ops.attention_pooling(df, queries, temps, "bottleneck", projection=(w, b, [[2.0], [3.0]], [0.0, 1.0]))
    z = float((np.array(w) @ cat + b)[0])
    h = 0.5 * z * (1 + math.erf(z / math.sqrt(2)))
    assert {r["grp"]: r["pooled"] for r in neck.collect()}["a"] == pytest.approx([2 * h, 3 * h + 1])
    with pytest.raises(ValueError):
        ops.attention_pooling(df, queries, temps, "other")


def test_attention_heads_of_a_group_over_many_batches(spark):
    rng = np.random.default_rng(3)
    queries, temps = rng.normal(size=(3, 4)), [0.5, 1.0, 20.0]
    groups = [None if i % 50 == 0 else 1 if i % 3 else i % 17 for i in range(4000)]
    data = [(g, bool(rng.random() < 0.8), (rng.normal(size=4) * 30).tolist(), "x") for g in groups]
    df = spark.createDataFrame(data, "grp int, mask boolean, vec array<double>, heads string").repartition(7)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "16")  # a group's states reach its task in more than one batch
    try:
        pooled = ops.attention_heads(df, queries.tolist(), temps)
        plan = pooled._jdf.queryExecution().executedPlan().toString()  # before it runs, so it is printed once
        got = {r["grp"]: r["heads"] for r in pooled.collect()}
    finally:
        spark.conf.set(key, before)
    assert plan.count("Exchange hashpartitioning") == 1
    assert set(got) == set(groups)
    for group in set(groups):
        v = np.array([d[2] for d in data if d[0] == group])
        on = np.array([d[1] for d in data if d[0] == group])
        expected = []
        for q, t in zip(queries, np.clip(temps, 0.1, 10.0)):
            s = np.where(on, v @ q / t, -1e9)
            w = np.exp(s - s.max())
            expected.extend((w[:, None] * v).sum(0) / w.sum())
        assert got[group] == pytest.approx(expected)
    assert ops.attention_heads(df.limit(0), queries.tolist(), temps).count() == 0
    with_null = df.selectExpr("grp", "mask", "if(grp = 1, null, vec) AS vec")
    with pytest.raises(Exception, match="none of them null"):
        ops.attention_heads(with_null, queries.tolist(), temps).collect()


def test_user_model_keeps_the_key(spark):
    def make_predict():
        return lambda vectors: np.asarray(vectors) * 2.0

    df = spark.createDataFrame([(f"r{i}", [float(i), 1.0]) for i in range(50)], "accession string, vec array<double>")
    got = ops.batch_model_score(df.repartition(3), make_predict, ["vec"], input_shapes=[[2]], batch_size=7)
    assert {r["accession"]: r["logits"] for r in got.collect()} == {f"r{i}": [2.0 * i, 2.0] for i in range(50)}


def test_stream_weight(spark):
    df = spark.createDataFrame([(0.25,), (0.75,)], "alpha double")
    assert ops.stream_weight_mean(df).first()[0] == 0.5


def test_user_model_with_weights_per_stream(spark):
    from pyspark.sql import types as T

    def make_predict():
        def predict(vectors):
            x = np.asarray(vectors)
            return {"logits": x * 2.0, "glm": x[:, 0], "arch": x[:, 1], "marker": x.sum(axis=1)}

        return predict

    fields = [T.StructField("logits", T.ArrayType(T.DoubleType()))]
    fields += [T.StructField(n, T.DoubleType()) for n in ("glm", "arch", "marker")]
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "accession string, vec array<double>")
    got = ops.batch_model_score(df, make_predict, ["vec"], T.StructType(fields), input_shapes=[[2]])
    flat = {r["accession"]: (r["logits"]["logits"], r["logits"]["glm"], r["logits"]["marker"]) for r in got.collect()}
    assert flat == {"a": ([2.0, 4.0], 1.0, 3.0), "b": ([6.0, 8.0], 3.0, 7.0)}


def test_models_see_the_batches_as_laid_out(spark, rows):
    from seqharbor.operators.sequences import length_bucket_batches

    data = [(f"c{i}", 100 + 37 * (i % 9), [float(j) for j in range(1 + i % 5)], i) for i in range(140)]
    df = spark.createDataFrame(data, "accession string, chunk_len int, vec array<double>, n int")
    laid = length_bucket_batches(df, 8, 60).cache()

    def recording(shift):
        def make():
            def predict(vec, n):
                # what the model is given: rows, width, members
                return [[len(n), vec.shape[1], float(n.sum()) + shift, float(vec[k].sum())] for k in range(len(n))]

            return predict

        return make

    got = ops.score_batches(laid.repartition(5), {"a": recording(0), "b": recording(1)}, ["vec", "n"])
    batches = {}
    for r in laid.collect():
        batches.setdefault(r["batch_id"], []).append(r)
    want = [
        (fold, r["accession"], [len(b), max(len(x["vec"]) for x in b), sum(x["n"] for x in b) + shift, sum(r["vec"])])
        for b in batches.values() for r in b for fold, shift in (("a", 0), ("b", 1))
    ]
    assert rows(got) == sorted([(f, a, [float(x) for x in v]) for f, a, v in want], key=repr)
    assert max(len(b) for b in batches.values()) <= 8 and got.count() == 280
    with pytest.raises(Exception, match="gave 1 rows"):
        ops.score_batches(laid, {"a": lambda: lambda vec, n: [[0.0]]}, ["vec", "n"]).collect()
    assert ops.score_batches(laid.limit(0), {"a": recording(0)}, ["vec", "n"]).count() == 0
