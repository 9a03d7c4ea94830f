"""Marker hits: filters, best hits, annotation, per-chunk marker features, seed search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import (
    ANNOTATION_COLUMNS,
    DOMAIN_FAMILIES,
    DOMAIN_MARKER_FEATURES,
    GATE_CODES,
    HOST_FAMILIES,
    HOST_MARKER_FEATURES,
)
from ..functions.scalars import nan_to_null
from ..functions.spread import broadcast_if_small
from ..session import materialize
from .seeds import seed_table, shared_kmers

VIRAL_CLASS = "VV"
BROADCAST_ROWS = 2_000_000  # marker rows of some 100 bytes
BROADCAST_WIDE_ROWS = 200_000  # marker rows with all their metadata


def viral_markers(metadata: DataFrame) -> DataFrame:
    return metadata.where(F.upper("specificity_class") == VIRAL_CLASS)


def hit_coverage(hits: DataFrame) -> DataFrame:
    """Add ``query_cov`` and ``target_cov``: aligned length over length, 0.0 for length 0."""

    def share(length: str) -> Column:
        return F.when(F.col(length) != 0, F.col("alnlen") / F.col(length)).otherwise(F.lit(0.0))

    return hits.withColumns({"query_cov": share("qlen"), "target_cov": share("tlen")})


def filter_hits(
    hits: DataFrame,
    evalue: float = 1e-3,
    min_coverage: float = 0.0,
    min_identity: float = 0.0,
) -> DataFrame:
    """The search thresholds. Coverage is the aligned span over the length, of both sides.

    Identity is not part of a hit row, so it is checked only when a ``pident`` column is there.
    """

    def span(start: str, end: str, length: str) -> Column:
        return (F.col(end) - F.col(start) + F.lit(1)) / F.nullif(F.col(length), F.lit(0))

    keep = F.col("evalue").try_cast("double") <= evalue
    if min_coverage > 0:
        keep = (
            keep
            & (span("qstart", "qend", "qlen") >= min_coverage)
            & (span("tstart", "tend", "tlen") >= min_coverage)
        )
    if min_identity > 0:
        if "pident" not in hits.columns:
            raise ValueError("min_identity needs a pident column")
        keep = keep & (F.col("pident") >= min_identity)
    return hits.where(keep)


def whitelist_hits(hits: DataFrame, markers: DataFrame) -> DataFrame:
    """Hits on a viral marker."""
    names = markers.select(F.col("marker").alias("target")).distinct()
    return hits.join(broadcast_if_small(names, BROADCAST_ROWS), "target", "left_semi")


def parent_id(query: str | Column = "query") -> Column:
    """Protein id to the id of the sequence it lies on (unchanged without ``_``)."""
    name = F.col(query) if isinstance(query, str) else query
    tail = F.length(F.substring_index(name, "_", -1)) + F.lit(1)
    return F.when(F.contains(name, F.lit("_")), F.left(name, F.length(name) - tail)).otherwise(name)


def best_hits(hits: DataFrame) -> DataFrame:
    """Highest score per (sequence, marker). A NaN score never wins."""
    return hits.groupBy(parent_id("query").alias("accession"), F.col("target").alias("marker")).agg(
        F.max(nan_to_null(F.col("bits").cast("double"))).alias("bitscore")
    )


def annotate_hits(
    hits: DataFrame, proteins: DataFrame, metadata: DataFrame, as_text: bool = True
) -> DataFrame:
    """One row per retained hit: protein fields, hit fields, ``marker_<column>`` metadata."""
    covered = hit_coverage(hits)
    extra = [c for c in metadata.columns]
    tagged = metadata.select(
        F.col("marker").alias("target"), *[F.col(c).alias(f"marker_{c}") for c in extra]
    )
    joined = covered.join(
        proteins.withColumnRenamed("protein_id", "query"), "query", "left"
    ).join(broadcast_if_small(tagged, BROADCAST_WIDE_ROWS), "target", "left")
    renamed = {
        "parent_seq_id": parent_id("query"),
        "protein_id": F.col("query"),
        "marker_id": F.col("target"),
        "bitscore": F.col("bits"),
        "query_length": F.col("qlen"),
        "target_length": F.col("tlen"),
        "query_start": F.col("qstart"),
        "query_end": F.col("qend"),
        "target_start": F.col("tstart"),
        "target_end": F.col("tend"),
        "alignment_length": F.col("alnlen"),
        "query_coverage": F.col("query_cov"),
        "target_coverage": F.col("target_cov"),
    }
    names = [*ANNOTATION_COLUMNS, *[f"marker_{c}" for c in extra]]
    flags = ("partial_begin", "partial_end")

    def shown(name: str) -> Column:
        value = renamed.get(name, F.col(name))
        if as_text:
            text = value.cast("string")
            value = F.coalesce(F.initcap(text) if name in flags else text, F.lit(""))
        return value.alias(name)

    return joined.select(*[shown(name) for name in names])


def marker_ratios(hits: DataFrame, marker_ref: DataFrame) -> DataFrame:
    """Classified best hits as ``(fold, accession, class_code, ratio, uncut)``, ratio = score / cutoff.

    A marker without a positive cutoff has no ratio and is named in ``uncut``; the features of the
    families that it belongs to fail.
    """
    classified = marker_ref.where(F.col("class_code").isNotNull())
    bad = F.col("cutoff").isNull() | F.isnan("cutoff") | (F.col("cutoff") <= 0)
    return hits.join(classified, "marker").select(
        "fold",
        "accession",
        "class_code",
        F.when(~bad, F.col("bitscore") / F.col("cutoff")).alias("ratio"),
        F.when(bad, F.col("marker")).alias("uncut"),
    )


def _cut(family: str, value: Column) -> Column:
    """``value``, or an error if a marker of the family has no positive cutoff."""
    uncut = F.col(f"{family}_uncut")
    complaint = F.raise_error(F.concat(F.lit("no positive cutoff for marker "), uncut)).cast("double")
    return F.when(uncut.isNotNull(), complaint).otherwise(value)


def _families() -> dict[str, list[str]]:
    return {**DOMAIN_FAMILIES, **HOST_FAMILIES, "specific": GATE_CODES}


def _grouped_ratios(ratios: DataFrame) -> DataFrame:
    """Counts, medians and maxima of every class family in one pass.

    A median is the mean of the family's middle values in one sort by ratio: running against
    total family counts mark them. Sorting spills, a percentile's value table would not.
    """
    families = _families()
    group = Window.partitionBy("fold", "accession")
    running = group.orderBy("ratio").rowsBetween(Window.unboundedPreceding, 0)
    marked = (
        ratios.withColumns(
            {
                f"_in_{n}": (F.col("class_code").isin(c) & F.col("ratio").isNotNull()).cast("int")
                for n, c in families.items()
            }
        )
        .withColumns({f"_at_{n}": F.sum(f"_in_{n}").over(running) for n in families})
        .withColumns({f"_of_{n}": F.sum(f"_in_{n}").over(group) for n in families})
    )
    parts = [F.count(F.lit(1)).alias("n_classified")]
    for name in families:
        member, at, of = F.col(f"_in_{name}") == 1, F.col(f"_at_{name}"), F.col(f"_of_{name}")
        middle = member & ((at == F.floor((of + 1) / 2)) | (at == F.floor((of + 2) / 2)))
        parts += [
            F.sum(f"_in_{name}").alias(f"{name}_n"),
            F.avg(F.when(middle, F.col("ratio"))).alias(f"{name}_median"),
            F.max(F.when(member, F.col("ratio"))).alias(f"{name}_max"),
            F.max(F.when(F.col("class_code").isin(families[name]), F.col("uncut"))).alias(f"{name}_uncut"),
        ]
    return marked.groupBy("fold", "accession").agg(*parts)


def chunk_folds(chunks: DataFrame, folds: list[str]) -> DataFrame:
    """Every chunk once per fold (a handful of names known to the driver)."""
    return chunks.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in folds])))


def marker_summary(
    chunks: DataFrame, hits: DataFrame, marker_ref: DataFrame, folds: list[str]
) -> DataFrame:
    """One row per (fold, chunk) with all family counts, medians and maxima.

    Best hits and chunks are placed by chunk once, before the folds multiply them: the per-fold
    groups need no further exchange, nor does the join to the chunks where the session lets a
    join use a partitioning by some of its keys (``session.DEFAULT_CONF``).

    Best hits are unique per (chunk, marker), so a chunk's rows are at most the marker list. The
    list is counted: up to the limit it is broadcast, beyond it Spark joins by marker.
    """
    listed = marker_ref.where(F.col("class_code").isNotNull() & F.col("fold").isin(folds))
    sizes = [r["count"] for r in listed.groupBy("fold").count().collect()]
    if sum(sizes) <= BROADCAST_ROWS:
        ratios = marker_ratios(hits.repartition("accession"), F.broadcast(listed))
    else:
        ratios = marker_ratios(hits, listed)
    grouped = _grouped_ratios(ratios)
    every = chunk_folds(chunks.select("accession").repartition("accession"), folds)
    return every.join(grouped, ["fold", "accession"], "left")


def _family_features(names: list[str]) -> list[Column]:
    denominator = F.greatest(F.coalesce("n_classified", F.lit(0)), F.lit(1))
    features = []
    for name in names:
        family, kind = name.split("_", 1)
        source = {
            "marker_freq": F.coalesce(f"{family}_n", F.lit(0)) / denominator,
            "median_bitscore": F.col(f"{family}_median"),
            "max_bitscore": F.col(f"{family}_max"),
        }[kind]
        features.append(_cut(family, source.cast("double")).alias(name))
    return features


def domain_marker_features(summary: DataFrame) -> DataFrame:
    """Prokaryote / eukaryote marker features of a ``marker_summary``."""
    return summary.select("fold", "accession", *_family_features(DOMAIN_MARKER_FEATURES))


def host_marker_features(summary: DataFrame) -> DataFrame:
    """Protist / fungi / animal / plant marker features of a ``marker_summary``."""
    return summary.select("fold", "accession", *_family_features(HOST_MARKER_FEATURES))


def marker_features(summary: DataFrame) -> DataFrame:
    return summary.select(
        "fold", "accession", *_family_features(DOMAIN_MARKER_FEATURES + HOST_MARKER_FEATURES)
    )


def gate_context(summary: DataFrame) -> DataFrame:
    """Count, median and maximum over the specific class codes."""
    return summary.select(
        "fold",
        "accession",
        _cut("specific", F.coalesce("specific_n", F.lit(0)).cast("double")).alias("specific_count"),
        _cut("specific", F.col("specific_median")).alias("specific_median_bitscore"),
        _cut("specific", F.col("specific_max")).alias("specific_max_bitscore"),
    )


def _kmers(df: DataFrame, key: str, seq: str, k: int, out: str) -> DataFrame:
    """Every k-mer of each sequence at its place, cut from bytes; no row holds those of a sequence."""
    data = df.select(F.col(key).alias(out), F.col(seq).cast("binary").alias("_s"))
    last = F.octet_length("_s") - F.lit(k - 1)
    # no filter on the length: it would be pushed below and derive the sequence once more
    placed = data.select(out, "_s", F.explode(F.when(last >= 1, F.sequence(F.lit(1), last))).alias("_i"))
    return placed.select(out, F.expr(f"cast(substring(_s, _i, {k}) as string)").alias("kmer"))


def kmer_seed_hits(
    queries: DataFrame,
    targets: DataFrame,
    k: int = 5,
    min_containment: float = 0.5,
    top_k: int | None = None,
) -> DataFrame:
    """Targets whose distinct k-mers are found to a share of at least ``min_containment`` in a query.

    ``queries(query, seq)`` with one row for a name, ``targets(target, seq)``. Exact. Up to ``BROADCAST_ROWS`` k-mers of targets
    travel to the tasks as one table, and what a query holds of them is counted where the query lies: no k-mer is shuffled,
    and a task's memory is that of a slice of queries. Beyond it both sides meet by k-mer.
    """
    if not 0 < min_containment <= 1:
        raise ValueError("min_containment must be in (0, 1]")
    table = seed_table(targets, "target", k, BROADCAST_ROWS)
    if table is None:
        hits = _joined_seed_hits(queries, targets, k, min_containment)
    else:
        shared = shared_kmers(queries, table.distinct(), min_containment)
        hits = shared.withColumn("containment", F.col("shared") / F.col("target_kmers"))
    if top_k is None:
        return hits
    best = Window.partitionBy("query").orderBy(F.desc("containment"), F.desc("shared"), "target")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def _joined_seed_hits(queries: DataFrame, targets: DataFrame, k: int, min_containment: float) -> DataFrame:
    """``kmer_seed_hits`` for any number of targets. The targets' k-mers select the queries' and are then met by k-mer once:
    every match is one row."""
    seeds = materialize(_kmers(targets, "target", "seq", k, "target").distinct(), "target-kmers")
    sizes = seeds.groupBy("target").agg(
        F.count(F.lit(1)).alias("target_kmers"),
        F.ceil(F.count(F.lit(1)) * F.lit(float(min_containment)) - F.lit(1e-9)).alias("needed"),
    )
    known = broadcast_if_small(seeds.select("kmer").distinct(), BROADCAST_ROWS)
    present = _kmers(queries, "query", "seq", k, "query").join(known, "kmer", "left_semi").distinct()
    return (
        present.join(broadcast_if_small(seeds, BROADCAST_ROWS), "kmer")
        .groupBy("query", "target")
        .agg(F.count(F.lit(1)).alias("shared"))
        .join(broadcast_if_small(sizes, BROADCAST_ROWS), "target")
        .where(F.col("shared") >= F.col("needed"))
        .select(
            "query",
            "target",
            "shared",
            "target_kmers",
            (F.col("shared") / F.col("target_kmers")).alias("containment"),
        )
    )


def hit_summary(best: DataFrame, proteins: DataFrame | None = None) -> DataFrame:
    """One row: (sequence, marker) pairs, sequences with a hit, proteins predicted."""
    counts = best.agg(
        F.count(F.lit(1)).alias("marker_hits"),
        F.countDistinct("accession").alias("sequences_with_hits"),
    )
    if proteins is None:
        return counts
    predicted = proteins.agg(F.count(F.lit(1)).alias("proteins"))
    return counts.withColumn("proteins", predicted.scalar())


def extract_markers(
    hits: DataFrame,
    metadata: DataFrame,
    evalue: float = 1e-3,
    min_coverage: float = 0.0,
    min_identity: float = 0.0,
) -> tuple[DataFrame, DataFrame]:
    """Raw alignment hits to ``(retained hits, best hits)`` over the viral markers."""
    kept = whitelist_hits(
        filter_hits(hits, evalue, min_coverage, min_identity), viral_markers(metadata)
    )
    return kept, best_hits(kept)
