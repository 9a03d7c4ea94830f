"""Scoring: tree ensembles, linear heads, the gate, mixtures, pooling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import clamp, largest, sigmoid, total, zero_if_missing
from ..functions.vectors import entries, names, pack, with_entries, with_softmax

MIN_PROB = 1e-7
EXPRESSION_NODES = 300
POOL_CELLS = 1 << 20  # heads x entries x rows that pooling holds at once

TREE_COLUMNS = [
    "fold", "tree", "node", "feature", "threshold", "left", "right", "default_left", "leaf", "class",
]


# --- tree ensembles ---------------------------------------------------------------------------


def _checked_model(model: pd.DataFrame, features: list[str], outputs: int) -> pd.DataFrame:
    """The node table in one order, or an error that names everything wrong with it."""
    inner = model["left"].notna()
    problems = []
    unknown = sorted(set(model["feature"].dropna()) - set(features))
    if unknown:
        problems.append(f"the trees use features that are not given: {unknown}")
    if inner.any() and model.loc[inner, ["feature", "threshold", "right", "default_left"]].isna().any(axis=None):
        problems.append("an inner node lacks its feature, threshold, right child or default branch")
    if model.loc[~inner, "leaf"].isna().any():
        problems.append("a leaf has no value")
    if not model["class"].between(0, outputs - 1).all():
        problems.append(f"a tree is of a class outside 0 to {outputs - 1}")
    tree = ["fold", "class", "tree"]
    if model.duplicated([*tree, "node"]).any():
        problems.append("a node stands twice in a tree")
    if not model.groupby(tree)["node"].agg(lambda n: 0 in set(n)).all():
        problems.append("a tree has no node 0")
    here = set(model[[*tree, "node"]].itertuples(index=False, name=None))
    for side in ("left", "right"):
        asked = model.loc[inner, [*tree, side]].dropna().itertuples(index=False, name=None)
        if not {(*a[:3], int(a[3])) for a in asked} <= here:
            problems.append(f"a {side} child is missing")
    if problems:
        raise ValueError("; ".join(problems))
    return model.sort_values([*tree, "node"], ignore_index=True)


def _bases(base: float | dict[str, float], folds: list[str]) -> dict[str, float]:
    if not isinstance(base, dict):
        return dict.fromkeys(folds, float(base))
    lacking = sorted(set(folds) - set(base))
    if lacking:
        raise ValueError(f"no base score for folds {lacking}")
    return {fold: float(base[fold]) for fold in folds}


def _tree_expression(nodes: dict[int, dict], at: int) -> Column:
    node = nodes[at]
    if node["left"] is None:
        return F.lit(float(node["leaf"]))
    value = F.col(node["feature"]).cast("float")
    missing = value.isNull() | F.isnan(value)
    below = value < F.lit(float(node["threshold"])).cast("float")
    goes_left = (missing | below) if node["default_left"] else (~missing & below)
    return F.when(
        F.coalesce(goes_left, F.lit(bool(node["default_left"]))),
        _tree_expression(nodes, node["left"]),
    ).otherwise(_tree_expression(nodes, node["right"]))


def _margins_as_expressions(df: DataFrame, rows: list[dict], outputs: int, base: dict[str, float]) -> DataFrame:
    """Small ensembles as CASE expressions: no Python, no exchange of rows."""
    trees: dict[tuple[str, int, int], dict[int, dict]] = {}
    for row in rows:
        trees.setdefault((row["fold"], row["class"], row["tree"]), {})[row["node"]] = row
    unknown = F.raise_error(F.concat(F.lit("no trees for fold "), F.coalesce("fold", F.lit("null")))).cast("double")
    margins = []
    for k in range(outputs):
        chain = F
        for fold, start in base.items():
            parts = [_tree_expression(t, 0) for (f, c, _), t in trees.items() if (f, c) == (fold, k)]
            chain = chain.when(F.col("fold") == fold, total([F.lit(start), *parts]))
        margins.append(unknown if chain is F else chain.otherwise(unknown))
    return with_entries(df, "m", margins)


def _margin_udf(nodes: pd.DataFrame, features: list[str], outputs: int, base: dict[str, float]):
    """Level-by-level traversal of all trees of a fold over an Arrow batch."""
    position = {name: i for i, name in enumerate(features)}
    models = {}
    for fold, part in nodes.groupby("fold", sort=False):
        trees = []
        for (cls, _), tree in part.groupby(["class", "tree"], sort=True):
            tree = tree.sort_values("node").reset_index(drop=True)
            index = {n: i for i, n in enumerate(tree["node"])}
            leaf = tree["left"].isna().to_numpy()
            here = np.arange(len(tree))
            follow = lambda column: np.where(
                leaf, here, tree[column].map(index).fillna(0).astype(int)
            )
            trees.append(
                (
                    int(cls),
                    np.where(leaf, 0, tree["feature"].map(position).fillna(0).astype(int)),
                    tree["threshold"].to_numpy(np.float32),
                    follow("left"),
                    follow("right"),
                    tree["default_left"].eq(True).to_numpy(bool),
                    leaf,
                    tree["leaf"].fillna(0.0).to_numpy(float),
                )
            )
        models[fold] = trees

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            x = pdf[features].to_numpy(np.float32)
            out = np.zeros((len(pdf), outputs))
            for fold, rows in pdf.groupby("fold", dropna=False).indices.items():
                if fold not in models:
                    raise ValueError(f"no trees for fold {fold}")
                out[rows] = base[fold]
                part = x[rows]
                each = np.arange(len(rows))
                for cls, feat, threshold, left, right, default, leaf, weight in models[fold]:
                    at = np.zeros(len(rows), dtype=int)
                    while not leaf[at].all():
                        value = part[each, feat[at]]
                        goes_left = np.where(np.isnan(value), default[at], value < threshold[at])
                        at = np.where(goes_left, left[at], right[at])
                    out[rows, cls] += weight[at]
            yield pd.Series(list(out), dtype=object)

    return margins


def score_trees(
    df: DataFrame,
    nodes: DataFrame,
    features: list[str],
    num_classes: int = 2,
    base_score: float | dict[str, float] = 0.0,
    out: str = "probs",
) -> DataFrame:
    """Class probabilities of a gradient-boosted tree ensemble per (fold, row).

    ``nodes`` is the model as a table: ``fold, tree, node, feature, threshold, left, right,
    default_left, leaf, class``; the root is node 0, leaves have no ``left``. Features compare as
    float32; a missing value takes the default branch. Two classes use one margin and a sigmoid,
    more use one margin per class and a softmax. ``base_score`` is one intercept or one per fold.
    The model is checked before it is used, a row of a fold without trees fails the job, and small
    and large models add their trees in the same order.
    """
    outputs = 1 if num_classes == 2 else num_classes
    model = _checked_model(nodes.select(*TREE_COLUMNS).toPandas(), features, outputs)
    base_score = _bases(base_score, sorted(model["fold"].unique()))
    if len(model) <= EXPRESSION_NODES:
        rows = model.astype(object).where(model.notna(), None).to_dict("records")
        scored = _margins_as_expressions(df, rows, outputs, base_score)
    else:
        udf = _margin_udf(model, features, outputs, base_score)
        packed = F.struct("fold", *[F.col(c).cast("float").alias(c) for c in features])
        scored = df.withColumn("_margins", udf(packed))
        scored = with_entries(scored, "m", entries("_margins", outputs)).drop("_margins")
    if num_classes == 2:
        positive = sigmoid(F.col("_m0"))
        return scored.withColumn(out, F.array(1.0 - positive, positive)).drop("_m0")
    margins = names("m", outputs)
    scored = with_softmax(scored, [F.col(c) for c in margins], "p")
    return pack(scored, "p", outputs, out).drop(*margins)


def hierarchical_probs(
    domain: str | Column, host: str | Column, size: int, prokaryote: int, host_classes: list[int]
) -> Column:
    """Domain probabilities and eukaryote subclass probabilities as one class vector."""
    p1 = F.col(domain) if isinstance(domain, str) else domain
    p2 = F.col(host) if isinstance(host, str) else host
    values = [F.lit(0.0)] * size
    values[prokaryote] = p1[0]
    for k, fine in enumerate(host_classes):
        values[fine] = p1[1] * p2[k]
    return F.array(*values)


def expand_binary_probs(
    df: DataFrame, num_classes: int, prokaryote: int, probs: str = "probs"
) -> DataFrame:
    """Two-column probabilities to one per class; a vector of another width fails the job."""
    p = F.col(probs)
    spread = [
        p[0] if i == prokaryote else p[1] / F.lit(float(num_classes - 1)) for i in range(num_classes)
    ]
    wrong = F.raise_error(F.lit(f"class probabilities must have 2 or {num_classes} columns"))
    return df.withColumn(
        probs,
        F.when(F.size(p) == num_classes, p)
        .when(F.size(p) == 2, F.array(*spread))
        .otherwise(wrong.cast("array<double>")),
    )


# --- linear head and gate ---------------------------------------------------------------------


def linear_head(
    df: DataFrame,
    gamma: list[float],
    beta: list[float],
    weight: list[list[float]],
    bias: list[float],
    vector: str = "vec",
    out: str = "logits",
    eps: float = 1e-5,
) -> DataFrame:
    """Layer norm, then a linear map: one vectorised product per Arrow batch."""
    scale, shift = np.asarray(gamma, float), np.asarray(beta, float)
    matrix, offset = np.asarray(weight, float), np.asarray(bias, float)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def head(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if not len(vectors):
                yield pd.Series([], dtype=object)
                continue
            x = np.stack(vectors.to_numpy()).astype(float)
            centred = x - x.mean(axis=1, keepdims=True)
            normed = centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + eps)
            yield pd.Series(list((normed * scale + shift) @ matrix.T + offset), dtype=object)

    return df.withColumn(out, head(F.col(vector).cast("array<double>")))


def erf(x: np.ndarray) -> np.ndarray:
    """The error function by its series of positive terms, to double precision; 1 from 6 on."""
    z = np.minimum(np.abs(x), 6.0)
    term = z.copy()
    sum_ = z.copy()
    for n in range(1, 120):
        term *= 2.0 * z * z / (2 * n + 1)
        sum_ += term
    return np.sign(x) * np.minimum(2.0 / np.sqrt(np.pi) * np.exp(-z * z) * sum_, 1.0)


def gate_features(raw: Column, raw_dim: int, class_probs: list[Column], marker: Column | None, marker_dim: int) -> Column:
    """The gate's input row: scaled raw features, class probabilities, scaled marker scalars."""
    squash = lambda c: F.log1p(F.greatest(zero_if_missing(c), F.lit(0.0)))
    parts = [squash(raw[i]) for i in range(raw_dim)] + class_probs
    if marker is not None:
        parts += [squash(marker[i]) for i in range(marker_dim)]
    return F.array(*parts)


@dataclass(frozen=True)
class GateWeights:
    """One fold's gate: hidden layer, then one output."""

    hidden_weight: list[list[float]]
    hidden_bias: list[float]
    out_weight: list[float]
    out_bias: float


def gate_alpha(
    df: DataFrame,
    gates: dict[str, GateWeights],
    num_classes: int,
    raw_dim: int = 13,
    marker_dim: int = 0,
    raw: str = "raw",
    logits: str = "logits",
    marker: str = "marker",
    out: str = "alpha",
) -> DataFrame:
    """Weight of the sequence model in the mixture, in (0, 1); 1 where the chunk has no genes.

    Linear, GELU (exact, by erf), linear, sigmoid, with the weights of the row's ``fold``. Spark
    SQL has no erf, so the two small products run per Arrow batch.
    """
    if raw not in df.columns:
        raise ValueError("the gate needs the raw features")
    weights = {
        fold: (
            np.asarray(g.hidden_weight, float),
            np.asarray(g.hidden_bias, float),
            np.asarray(g.out_weight, float),
            float(g.out_bias),
        )
        for fold, g in gates.items()
    }

    @F.pandas_udf("double")
    def gate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            out = np.zeros(len(pdf))
            for fold, rows in pdf.groupby("fold", dropna=False).indices.items():
                if fold not in weights:
                    raise ValueError(f"no gate for fold {fold}")
                w1, b1, w2, b2 = weights[fold]
                z = np.stack(pdf["x"].to_numpy()[rows]).astype(float) @ w1.T + b1
                gelu = 0.5 * z * (1.0 + erf(z / np.sqrt(2.0)))
                out[rows] = 1.0 / (1.0 + np.exp(-(gelu @ w2 + b2)))
            yield pd.Series(out)

    soft = with_softmax(df, entries(logits, num_classes), "g")
    probs = [F.col(c) for c in names("g", num_classes)]
    scalars = F.col(marker) if marker_dim else None
    row = gate_features(F.col(raw), raw_dim, probs, scalars, marker_dim)
    alpha = gate(F.struct("fold", row.alias("x")))
    if marker_dim:
        alpha = F.when(zero_if_missing(F.col(marker)[0]) == 0.0, F.lit(1.0)).otherwise(alpha)
    return soft.withColumn(out, alpha).drop(*names("g", num_classes))


def _log_floor(value: Column) -> Column:
    return F.log(clamp(value, low=MIN_PROB))


def mix_probs(
    df: DataFrame,
    num_classes: int,
    alpha: str = "alpha",
    logits: str = "logits",
    probs: str = "probs",
    out: str = "log_probs",
) -> DataFrame:
    """Log of the gated mixture of softmax(logits) and the tree probabilities."""
    soft = with_softmax(df, entries(logits, num_classes), "x")
    mixed = [
        _log_floor(F.col(alpha) * F.col(x) + (1.0 - F.col(alpha)) * p)
        for x, p in zip(names("x", num_classes), entries(probs, num_classes))
    ]
    return soft.withColumn(out, F.array(*mixed)).drop(*names("x", num_classes))


def stream_fallback(
    df: DataFrame,
    num_classes: int,
    logits: str | None = "logits",
    probs: str | None = "probs",
    out: str = "log_probs",
) -> DataFrame:
    """Log-probabilities from one stream: log-softmax of the sequence model where its logits are
    present, else the log of the tree probabilities. A NaN tree probability fails the job.
    """
    if logits is None and probs is None:
        raise ValueError("no stream to score")
    from_trees = None
    if probs is not None:
        broken = F.raise_error(F.lit("NaN in the tree probabilities")).cast("double")
        from_trees = F.array(
            *[F.when(F.isnan(p), broken).otherwise(_log_floor(p)) for p in entries(probs, num_classes)]
        )
    if logits is None:
        return df.withColumn(out, from_trees)
    scores = entries(logits, num_classes)
    soft = df.withColumn("_top", largest(scores))
    soft = soft.withColumn("_lse", F.log(total([F.exp(s - F.col("_top")) for s in scores])))
    from_model = F.array(*[s - F.col("_top") - F.col("_lse") for s in scores])
    if from_trees is not None:
        from_model = F.when(F.col(logits).isNotNull(), from_model).otherwise(from_trees)
    return soft.withColumn(out, from_model).drop("_top", "_lse")


def exp_log_probs(vector: str | Column) -> Column:
    return F.transform(vector, F.exp)


def batch_model_score(
    df: DataFrame,
    make_predict: Callable,
    inputs: list[str],
    output: T.DataType = T.ArrayType(T.DoubleType()),
    batch_size: int = 16,
    input_shapes: list | None = None,
    out: str = "logits",
) -> DataFrame:
    """Score rows with a user model: ``make_predict()`` loads it once per worker and returns a
    function over a batch. The key stays in the row, so nothing has to be put back in order.
    """
    predict = predict_batch_udf(
        make_predict, return_type=output, batch_size=batch_size, input_tensor_shapes=input_shapes
    )
    return df.withColumn(out, predict(*[F.col(c) for c in inputs]))


def _model_input(column: pa.Array, shape: list | None) -> np.ndarray:
    """One input of a batch; lists are padded with zeros to the longest of the batch."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    values, sizes = column.to_pylist(), np.array(pa.compute.list_value_length(column).fill_null(0))
    out = np.zeros((len(values), int(sizes.max(initial=0))))
    for i, row in enumerate(values):
        out[i, : sizes[i]] = row or []
    return out.reshape((len(values), *shape)) if shape else out


def score_batches(
    df: DataFrame,
    models: dict[str, Callable],
    inputs: list[str],
    key: str = "accession",
    length: str = "chunk_len",
    input_shapes: list | None = None,
) -> DataFrame:
    """``(fold, key, logits)``: every row scored by every fold's model, in the batches that ``batch_id`` names.

    A batch lies in one partition and is handed to the models whole, ordered by length and key: they see
    exactly the batches of ``length_bucket_batches``, with list columns padded to the batch's longest.
    ``models`` has a ``make_predict`` per fold, called once per task; rows are read once for all folds.
    """
    kind = df.schema[key].dataType
    schema = T.StructType().add("fold", T.StringType()).add(key, kind).add("logits", T.ArrayType(T.DoubleType()))
    placed = df.select(key, "batch_id", length, *inputs).repartitionByRange("batch_id")
    shapes = input_shapes or [None] * len(inputs)

    def scored(predictors: dict[str, Callable], parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        arrays = [_model_input(table.column(i).combine_chunks(), s) for i, s in enumerate(shapes, 3)]
        for fold, predict in predictors.items():
            logits = np.asarray(predict(*arrays), dtype=np.float64)
            if len(logits) != table.num_rows:
                raise ValueError(f"the model of {fold} gave {len(logits)} rows for a batch of {table.num_rows}")
            yield pa.RecordBatch.from_arrays(
                [pa.array([fold] * len(logits)), table.column(0).combine_chunks(), pa.array(logits.tolist(), pa.list_(pa.float64()))],
                names=schema.names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictors = {fold: make() for fold, make in models.items()}
        held, now = [], None
        for batch in batches:
            ids = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if held and ids[a] != now:
                    yield from scored(predictors, held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
                    now = ids[a]
        if held:
            yield from scored(predictors, held)

    return placed.sortWithinPartitions("batch_id", length, key).mapInArrow(run, schema)


# --- pooling ----------------------------------------------------------------------------------


def masked_pooling(
    df: DataFrame,
    dim: int,
    how: str = "mean",
    key: str = "grp",
    position: str = "pos",
    mask: str = "mask",
    vector: str = "vec",
    out: str = "pooled",
) -> DataFrame:
    """Pool the vectors of a group: first, masked mean, or masked maximum.

    Partial aggregates run before the shuffle, so a very large group costs no more than others.
    """
    v = F.col(vector)
    on = F.col(mask)
    if how == "cls":
        return df.groupBy(key).agg(F.min_by(v.cast("array<double>"), position).alias(out))
    if how not in ("mean", "max"):
        raise ValueError(f"unknown pooling: {how}")
    dense = v.cast("array<double>")
    if how == "max":
        shown = array_to_vector(F.when(on, dense).otherwise(F.array_repeat(F.lit(-1e9), dim)))
        grouped = df.select(key, shown.alias("_v")).groupBy(key)
        return grouped.agg(vector_to_array(Summarizer.max(F.col("_v"))).alias(out))
    shown = array_to_vector(F.when(on, dense).otherwise(F.array_repeat(F.lit(0.0), dim)))
    grouped = df.select(key, shown.alias("_v"), on.cast("double").alias("_on")).groupBy(key)
    sums = grouped.agg(
        vector_to_array(Summarizer.sum(F.col("_v"))).alias("_s"), F.sum("_on").alias("_n")
    )
    count = F.greatest(F.col("_n"), F.lit(1e-9))
    return sums.select(key, F.transform("_s", lambda s: s / count).alias(out))


def attention_heads(
    df: DataFrame,
    queries: list[list[float]],
    temperatures: list[float],
    key: str = "grp",
    mask: str = "mask",
    vector: str = "vec",
    out: str = "heads",
) -> DataFrame:
    """Per group and head the softmax-weighted sum of the vectors, the heads one after the other in ``out``.

    A head scores a vector by ``v.q / T``; hidden rows count with a score of -1e9. A vector is
    scored once: a task folds each slice of bounded size to one state per group (per head the greatest
    score, the sum of ``exp(score - greatest)`` and the vectors' sum so weighted), states of a
    group meet in one shuffle and are merged as they arrive in the order of their group. A group that
    holds most rows sends one state per slice and is never gathered. A null vector or mask is an
    error; rows with a null key are a group. A table without rows has no groups.
    """
    heads, dim = len(queries), len(queries[0])
    scaled = np.asarray(queries, float) / np.clip(np.asarray(temperatures, float), 0.1, 10.0)[:, None]
    group = df.select(key).schema[0]
    state = T.StructType([group, T.StructField("_state", T.ArrayType(T.DoubleType()))])
    done = T.StructType([group, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def folded(tops: np.ndarray, sums: np.ndarray, vectors: np.ndarray, codes: np.ndarray, groups: int) -> np.ndarray:
        """States of rows, or of states, by group: a row is a state with sum 1 and its own vector."""
        best = np.full((groups, heads), -np.inf)
        np.maximum.at(best, codes, tops)
        scale = np.exp(tops - best[codes])
        total_weight = np.zeros((groups, heads))
        np.add.at(total_weight, codes, sums * scale)
        weighted = np.zeros((groups, heads, dim))
        np.add.at(weighted, codes, vectors * scale[:, :, None])
        return np.concatenate([best, total_weight, weighted.reshape(groups, -1)], axis=1)

    def parts(states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return states[:, :heads], states[:, heads : 2 * heads], states[:, 2 * heads :].reshape(-1, heads, dim)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, POOL_CELLS // (heads * dim))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                yield batch.slice(start, step)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keys, codes = _groups(batch.column(0))
            dense = _dense(batch.column(2), dim)
            on = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            tops = np.where(on[:, None], dense @ scaled.T, -1e9)
            rows = np.broadcast_to(dense[:, None, :], (len(dense), heads, dim))
            yield _state_batch(keys, folded(tops, np.ones_like(tops), rows, codes, len(keys)), [key, "_state"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_state = None, None  # of the group that the next batch may continue
        for batch in pieces(batches):
            column, states = batch.column(0), _dense(batch.column(1), heads * (2 + dim))
            if open_state is not None:
                column = pa.concat_arrays([open_key, column])
                states = np.concatenate([open_state, states])
            keys, codes = _groups(column)
            states = folded(*parts(states), codes, len(keys))
            open_key, open_state = keys.slice(len(keys) - 1), states[-1:]
            if len(keys) > 1:
                yield _pooled_batch(keys.slice(0, len(keys) - 1), states[:-1])
        if open_state is not None:
            yield _pooled_batch(open_key, open_state)

    def _pooled_batch(keys: pa.Array, states: np.ndarray) -> pa.RecordBatch:
        _, sums, vectors = parts(states)
        return _state_batch(keys, (vectors / sums[:, :, None]).reshape(len(keys), -1), [key, out])

    rows = df.select(key, F.col(mask).alias("_on"), F.col(vector).cast("array<double>").alias("_v"))
    states = rows.mapInArrow(fold, state)
    return states.repartition(key).sortWithinPartitions(key).mapInArrow(merge, done)


def _groups(keys: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct keys in the order of their first row, and each row's place among them."""
    coded = keys.dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _dense(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten()
    if column.null_count or values.null_count or len(values) != size * len(column):
        raise ValueError(f"vectors must have {size} entries, none of them null")
    return values.to_numpy(zero_copy_only=False).reshape(len(column), size)


def _state_batch(keys: pa.Array, values: np.ndarray, columns: list[str]) -> pa.RecordBatch:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).reshape(-1)))
    return pa.RecordBatch.from_arrays([keys, lists], columns)


def combine_heads(
    stacked: str | Column,
    heads: int,
    dim: int,
    combine: str = "weighted_sum",
    head_weights: list[float] | None = None,
    projection: tuple | None = None,
) -> Column:
    """One vector from the heads of a group: ``weighted_sum`` (weights), ``linear`` (W, b) or
    ``bottleneck`` (W1, b1, W2, b2)."""
    column = F.col(stacked) if isinstance(stacked, str) else stacked
    if combine == "weighted_sum":
        weights = head_weights or [1.0 / heads] * heads
        return F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: total([F.lit(float(weights[h])) * F.get(column, i + h * dim) for h in range(heads)]),
        )
    if combine not in ("linear", "bottleneck"):
        raise ValueError(f"unknown head combination: {combine}")
    return _projection(projection, combine)(column)


def attention_pooling(
    df: DataFrame,
    queries: list[list[float]],
    temperatures: list[float],
    combine: str = "weighted_sum",
    head_weights: list[float] | None = None,
    projection: tuple | None = None,
    key: str = "grp",
    mask: str = "mask",
    vector: str = "vec",
    out: str = "pooled",
) -> DataFrame:
    """``attention_heads`` and ``combine_heads`` in one: a pooled vector per group."""
    pooled = attention_heads(df, queries, temperatures, key, mask, vector, "_heads")
    mixed = combine_heads("_heads", len(queries), len(queries[0]), combine, head_weights, projection)
    return pooled.select(key, mixed.alias(out))


def _projection(projection: tuple, combine: str):
    parts = [np.asarray(p, float) for p in projection]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            if not len(rows):
                yield pd.Series([], dtype=object)
                continue
            x = np.stack(rows.to_numpy()).astype(float) @ parts[0].T + parts[1]
            if combine == "bottleneck":
                x = 0.5 * x * (1.0 + erf(x / np.sqrt(2.0)))
                x = x @ parts[2].T + parts[3]
            yield pd.Series(list(x), dtype=object)

    return project


def stream_weight_mean(df: DataFrame, alpha: str = "alpha", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg(alpha).alias("stream_weight"))
