"""Labels, splits, sampling and loss evaluation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..constants import ARCH_MODEL_FEATURES
from ..functions.ranking import hash_rank
from ..functions.scalars import largest, total
from ..functions.spread import broadcast_if_small
from ..functions.vectors import entries
from ..session import materialize
from .features import align_features
from .genes import arch_features, gene_context, gene_table, orf_scan

FOCAL_GAMMA = 2.0
CLASS_ROWS = 10_000  # class names that are broadcast


def label_index(labels: DataFrame) -> DataFrame:
    """``(label, label_idx)``: distinct labels in sorted order, from 0."""
    by_name = Window.orderBy("label")  # over the distinct class names only
    return (
        labels.select("label")
        .distinct()
        .withColumn("label_idx", (F.row_number().over(by_name) - 1).cast("int"))
    )


def join_labels(sequences: DataFrame, labels: DataFrame, strict: bool = False) -> DataFrame:
    """Labelled sequences. A repeated accession among the labels fails the job, as does, if
    ``strict``, a sequence without a label."""
    others = [c for c in labels.columns if c != "accession"]
    twice = F.raise_error(F.concat(F.lit("two labels for "), F.col("accession"))).cast("string")
    single = labels.groupBy("accession").agg(
        *[F.first(c).alias(c) for c in others], F.count(F.lit(1)).alias("_times")
    )
    single = single.withColumn("label", F.when(F.col("_times") > 1, twice).otherwise(F.col("label"))).drop("_times")
    if not strict:
        return sequences.join(single, "accession")
    missing = F.raise_error(F.concat(F.lit("no label for "), F.col("accession")))
    return sequences.join(single, "accession", "left").withColumn(
        "label", F.coalesce("label", missing.cast("string"))
    )


def skipped_sequences(sequences: DataFrame, labels: DataFrame) -> DataFrame:
    return sequences.select("accession").join(labels.select("accession"), "accession", "left_anti")


def class_counts(labelled: DataFrame) -> list[tuple[str, int]]:
    """(label, rows) by name: one small row per class on the driver."""
    rows = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()
    if not rows:
        raise ValueError("no sequence has a label")
    return [(r["label"], r["n"]) for r in rows]


def class_distribution(labelled: DataFrame) -> DataFrame:
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # one row per class
    return counts.withColumn("percent", F.lit(100.0) * F.col("n") / F.sum("n").over(everything))


def class_weights(labelled: DataFrame, num_classes: int | None = None) -> DataFrame:
    """``total / (classes * rows of the class)``; by default over the classes that have rows."""
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    rows = F.sum("n").over(everything)
    classes = F.count(F.lit(1)).over(everything) if num_classes is None else F.lit(num_classes)
    return counts.withColumn("weight", rows / (classes * F.col("n"))).drop("n")


def split_quotas(counts: list[tuple[str, int]], test_size: float) -> dict[str, int]:
    """Validation rows per class, by largest remainder of the training share."""
    total_rows = sum(n for _, n in counts)
    n_test = math.ceil(test_size * total_rows - 1e-9)
    n_train = total_rows - n_test
    if min(n for _, n in counts) < 2:
        raise ValueError("every class needs at least 2 sequences")
    if n_test < len(counts) or n_train < len(counts):
        raise ValueError("a side of the split is smaller than the number of classes")
    exact = {label: n * n_train / total_rows for label, n in counts}
    train = {label: math.floor(x) for label, x in exact.items()}
    by_remainder = sorted(exact, key=lambda label: (train[label] - exact[label], label))
    for label in by_remainder[: n_train - sum(train.values())]:
        train[label] += 1
    return {label: n - train[label] for label, n in counts}


def stratified_split(
    labelled: DataFrame, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split`` = train / val, stratified by label; membership is a seeded hash order.

    The quotas are a table with a row per class, joined by label.
    """
    quotas = split_quotas(class_counts(labelled), test_size)
    table = labelled.sparkSession.createDataFrame(list(quotas.items()), "_label string, _quota bigint")
    ranked = hash_rank(labelled, ["label"], "accession", seed, "_rank")
    return (
        ranked.join(F.broadcast(table), F.col("label") == F.col("_label"))
        .withColumn("split", F.when(F.col("_rank") <= F.col("_quota"), "val").otherwise("train"))
        .drop("_rank", "_label", "_quota")
    )


def undersample_quota(n_other: int, n_target: int, max_prop: float) -> int:
    if max_prop >= 1.0:
        return n_target
    return min(n_target, int(n_other * max_prop / (1.0 - max_prop)))


def undersample_class(
    labelled: DataFrame, target: str, max_prop: float = 0.5, seed: int = 42, epoch: int = 0
) -> DataFrame:
    """All rows of the other classes and a random subset of ``target``, re-drawn per epoch.

    ``position`` is a seeded random order for the epoch.
    """
    counts = dict(class_counts(labelled))
    n_target = counts.get(target, 0)
    quota = undersample_quota(sum(counts.values()) - n_target, n_target, max_prop)
    draw = seed + epoch
    rest = labelled.where(F.col("label") != target)
    picked = labelled.where(F.col("label") == target)
    if quota < n_target:
        picked = (
            hash_rank(picked, ["label"], "accession", draw, "_rank")
            .where(F.col("_rank") <= quota)
            .drop("_rank")
        )
    order = F.md5(F.concat_ws("|", F.col("accession"), F.lit(str(draw)), F.lit("order")))
    return rest.unionByName(picked.select(*rest.columns)).withColumn("position", order)


def sampled_counts(sample: DataFrame) -> DataFrame:
    return sample.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def load_fold_training_set(
    sequences: DataFrame,
    labels: DataFrame,
    tree_probs: DataFrame | None = None,
    gate_features: DataFrame | None = None,
) -> DataFrame:
    """One row per sequence: label index, tree probabilities and raw gate features as arrays.

    Every sequence must have a label; missing features are 0.0.
    """
    table = join_labels(sequences, labels, strict=True)
    # The class names are few: sequences are never placed by label, of which one may hold a third of them.
    index = label_index(labels.join(sequences.select("accession"), "accession", "left_semi"))
    table = table.join(broadcast_if_small(index, CLASS_ROWS), "label")
    for features, out in ((tree_probs, "features"), (gate_features, "raw_features")):
        if features is None:
            continue
        aligned = align_features(sequences, features)
        columns = [c for c in aligned.columns if c != "accession"]
        packed = aligned.select("accession", F.array(*columns).alias(out))
        table = table.join(packed, "accession")
    return table


def sequence_features(sequences: DataFrame, chunk_size: int = 10000) -> DataFrame:
    """Architecture features of whole sequences, from scanned genes (written once)."""
    orfs = materialize(orf_scan(sequences), "orfs")
    sized = sequences.select("accession", F.length("seq").alias("chunk_len"))
    features = arch_features(sized, gene_context(gene_table(orfs)), chunk_size)
    return features.select("accession", *ARCH_MODEL_FEATURES)


def load_training_set(
    sequences: DataFrame,
    labels: DataFrame,
    features: DataFrame | None = None,
    test_size: float = 0.2,
    seed: int = 42,
    compute_features: bool = False,
) -> DataFrame:
    """Labelled sequences with label index, features (strict) and the train / val split.

    Features come from a table or, on request, from the sequences: the architecture features of
    their genes.
    """
    table = join_labels(sequences, labels)
    if features is None and compute_features:
        features = sequence_features(table.select("accession", "seq"))
    # Names and labels feed the counts and the ranks: the sequence files are not read for each.
    named = materialize(table.select("accession", "label"), "labelled")
    split = stratified_split(named, test_size, seed)
    result = split.join(broadcast_if_small(label_index(labels), CLASS_ROWS), "label").join(sequences, "accession")
    if features is not None:
        aligned = align_features(named, features, strict=True)
        columns = [c for c in aligned.columns if c != "accession"]
        result = result.join(
            aligned.select("accession", F.array(*columns).alias("features")), "accession"
        )
    return result


# --- losses -----------------------------------------------------------------------------------


def class_balanced_weights(counts: list[int], beta: float) -> list[float]:
    """Inverse effective numbers, summing to the number of classes."""
    effective = [1.0 - beta**n for n in counts]
    raw = [(1.0 - beta) / (e if e != 0 else 1e-8) for e in effective]
    scale = len(counts) / sum(raw)
    return [w * scale for w in raw]


def samples_per_class(scored: DataFrame, num_classes: int, label: str = "label") -> list[int]:
    found = {r[0]: r[1] for r in scored.groupBy(label).count().collect()}
    return [found.get(i, 0) for i in range(num_classes)]


def _with_nll(
    scored: DataFrame, num_classes: int, logits: str, label: str, weights: list[float] | None
) -> DataFrame:
    scores = entries(logits, num_classes)
    df = scored.withColumn("_top", largest(scores))
    df = df.withColumn(
        "_nll",
        F.log(total([F.exp(s - F.col("_top")) for s in scores]))
        + F.col("_top")
        - F.col(logits)[F.col(label).cast("int")],
    )
    weight = (
        F.lit(1.0)
        if weights is None
        else F.array(*[F.lit(float(w)) for w in weights])[F.col(label).cast("int")]
    )
    return df.select(weight.alias("_w"), "_nll")


def weighted_cross_entropy(
    scored: DataFrame,
    num_classes: int,
    weights: list[float] | None = None,
    logits: str = "logits",
    label: str = "label",
) -> DataFrame:
    """Weighted mean of the negative log-likelihood."""
    rows = _with_nll(scored, num_classes, logits, label, weights)
    return rows.agg((F.sum(F.col("_w") * F.col("_nll")) / F.sum("_w")).alias("loss"))


def focal_loss(
    scored: DataFrame,
    num_classes: int,
    weights: list[float] | None = None,
    gamma: float = FOCAL_GAMMA,
    logits: str = "logits",
    label: str = "label",
) -> DataFrame:
    rows = _with_nll(scored, num_classes, logits, label, weights)
    focus = F.pow(1.0 - F.exp(-F.col("_nll")), F.lit(float(gamma)))
    return rows.agg(F.avg(F.col("_w") * focus * F.col("_nll")).alias("loss"))


def class_balanced_loss(
    scored: DataFrame,
    num_classes: int,
    beta: float,
    counts: list[int],
    loss_type: str = "softmax",
    gamma: float = FOCAL_GAMMA,
    logits: str = "logits",
    label: str = "label",
) -> DataFrame:
    weights = class_balanced_weights(counts, beta)
    if loss_type == "softmax":
        return weighted_cross_entropy(scored, num_classes, weights, logits, label)
    if loss_type == "focal":
        return focal_loss(scored, num_classes, weights, gamma, logits, label)
    raise ValueError(f"unknown loss type: {loss_type}")
