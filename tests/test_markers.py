from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from catalog import genes, markers, views
from seqharbor.functions.ranking import hash_rank
from seqharbor.operators import genes as gene_ops, markers as ops

HITS = (
    "query string, target string, evalue string, bits double, qlen bigint, tlen bigint, "
    "qstart bigint, qend bigint, tstart bigint, tend bigint, alnlen bigint"
)


def hit(query, target, bits=10.0, evalue="1e-5", qlen=100, tlen=100, span=50, alnlen=50):
    return (query, target, evalue, bits, qlen, tlen, 1, span, 1, span, alnlen)


def test_filters_and_coverage(spark, rows):
    df = spark.createDataFrame(
        [hit("a_1", "m1"), hit("a_2", "m1", evalue="0.01"), hit("a_3", "m1", span=49), hit("a_4", "m1", qlen=0, tlen=0),
         hit("a_5", "m1", evalue="oops")],
        HITS,
    )
    assert rows(ops.filter_hits(df), "query") == [("a_1",), ("a_3",), ("a_4",)]
    assert rows(ops.filter_hits(df, min_coverage=0.5), "query") == [("a_1",)]
    covered = {r["query"]: (r["query_cov"], r["target_cov"]) for r in ops.hit_coverage(df).collect()}
    assert covered["a_1"] == (0.5, 0.5) and covered["a_4"] == (0.0, 0.0)
    with pytest.raises(ValueError, match="pident"):
        ops.filter_hits(df, min_identity=0.5)
    scored = df.withColumn("pident", F.lit(0.4))
    assert ops.filter_hits(scored, min_identity=0.5).count() == 0


def test_parent_id(spark):
    df = spark.createDataFrame([("a_1",), ("a_b_12",), ("plain",), ("_x",), ("x_",)], "query string")
    assert [r[0] for r in df.select(ops.parent_id()).collect()] == ["a", "a_b", "plain", "", "x"]


def test_best_hits(spark, rows):
    df = spark.createDataFrame(
        [hit("a_1", "m1", 5.0), hit("a_2", "m1", 7.0), hit("a_2", "m2", 1.0), hit("b_1", "m1", float("nan")),
         hit("a_3", "m2", float("nan"))],
        HITS,
    )
    assert rows(ops.best_hits(df)) == [("a", "m1", 7.0), ("a", "m2", 1.0), ("b", "m1", None)]


def metadata(spark):
    return spark.createDataFrame(
        [("m1", "vv", "x"), ("m2", "CC", "y"), ("m3", "VV", None), ("m4", None, "z")],
        "marker string, specificity_class string, note string",
    )


def test_extract_and_annotate(spark, rows):
    hits = spark.createDataFrame(
        [hit("a_1", "m1", 5.0), hit("a_1", "m3", 6.0), hit("a_2", "m1", 9.0), hit("a_2", "m2", 9.0), hit("a_9", "m4")],
        HITS,
    )
    kept, best = ops.extract_markers(hits, metadata(spark))
    assert rows(best) == [("a", "m1", 9.0), ("a", "m3", 6.0)]
    proteins = spark.createDataFrame(
        [("a_1", "MK", 1, 9, -1, True, False, "ATG", "", "", 11)],
        "protein_id string, amino_acid_sequence string, protein_start int, protein_end int, protein_strand int, "
        "partial_begin boolean, partial_end boolean, start_type string, rbs_motif string, rbs_spacer string, "
        "translation_table int",
    )
    text = ops.annotate_hits(kept, proteins, ops.viral_markers(metadata(spark)))
    assert len(text.columns) == 24 + 3
    found = {(r["protein_id"], r["marker_id"]): r for r in text.collect()}
    assert len(found) == 3
    full, blank = found[("a_1", "m3")], found[("a_2", "m1")]
    assert (full["protein_start"], full["partial_begin"], full["partial_end"]) == ("1", "True", "False")
    assert (full["marker_marker"], full["marker_note"], full["query_coverage"]) == ("m3", "", "0.5")
    assert (blank["amino_acid_sequence"], blank["translation_table"], blank["bitscore"]) == ("", "", "9.0")
    summary = ops.hit_summary(best, proteins).first()
    assert tuple(summary) == (2, 1, 1)


REF = [
    ("fold_0", "k", "K", 10.0), ("fold_0", "kt", "KT", 10.0), ("fold_0", "a", "A", 10.0), ("fold_0", "f", "F", 5.0),
    ("fold_0", "u", "U", 10.0), ("fold_0", "none", None, None), ("fold_0", "bad", "A", 0.0), ("fold_0", "gone", "P", None),
    ("fold_1", "k", "A", 10.0),
]


def summary_of(spark, hits, folds=("fold_0", "fold_1")):
    chunks = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "accession string")
    best = spark.createDataFrame(hits, "accession string, marker string, bitscore double")
    ref = spark.createDataFrame(REF, "fold string, marker string, class_code string, cutoff double")
    return ops.marker_summary(chunks, best, ref, list(folds))


def test_marker_features(spark):
    hits = [("c1", "k", 20.0), ("c1", "kt", 5.0), ("c1", "a", 10.0), ("c1", "f", 10.0), ("c1", "u", 1.0),
            ("c1", "none", 99.0), ("c1", "unlisted", 9.0), ("c2", "kt", 30.0), ("c2", "u", 1.0)]
    summary = summary_of(spark, hits)
    domain = {(r["fold"], r["accession"]): r for r in ops.domain_marker_features(summary).collect()}
    host = {(r["fold"], r["accession"]): r for r in ops.host_marker_features(summary).collect()}
    gate = {(r["fold"], r["accession"]): r for r in ops.gate_context(summary).collect()}
    assert len(domain) == len(host) == len(gate) == 6
    one = domain["fold_0", "c1"]
    assert one["prok_marker_freq"] == 0.2 and one["euk_marker_freq"] == 0.4
    assert one["prok_median_bitscore"] == 2.0 and one["euk_median_bitscore"] == 1.5 and one["euk_max_bitscore"] == 2.0
    assert host["fold_0", "c1"]["protist_max_bitscore"] == 0.5 and host["fold_0", "c1"]["plant_max_bitscore"] is None
    two = domain["fold_0", "c2"]
    assert (two["prok_marker_freq"], two["euk_marker_freq"], two["prok_median_bitscore"]) == (0.0, 0.0, None)
    assert host["fold_0", "c2"]["protist_marker_freq"] == 0.5
    assert gate["fold_0", "c1"]["specific_count"] == 4.0 and gate["fold_0", "c1"]["specific_median_bitscore"] == 1.5
    assert gate["fold_0", "c3"]["specific_count"] == 0.0 and gate["fold_0", "c3"]["specific_max_bitscore"] is None
    assert domain["fold_1", "c1"]["euk_marker_freq"] == 1.0


def test_missing_cutoff_fails_only_when_hit(spark):
    assert ops.domain_marker_features(summary_of(spark, [("c1", "k", 1.0)])).count() == 6
    for marker in ("bad", "gone"):
        with pytest.raises(Exception, match="no positive cutoff"):
            ops.domain_marker_features(summary_of(spark, [("c1", marker, 1.0)])).collect()


def test_odd_ratios_and_no_hits(spark):
    assert ops.domain_marker_features(summary_of(spark, [])).count() == 6
    hits = [("c1", "k", float("nan")), ("c1", "a", float("inf")), ("c1", "f", 5.0), ("c2", "k", 7.0), ("c2", "kt", 7.0)]
    host = {(r["fold"], r["accession"]): r for r in ops.host_marker_features(summary_of(spark, hits)).collect()}
    assert host["fold_0", "c1"]["animal_max_bitscore"] == float("inf") and host["fold_0", "c2"]["fungi_max_bitscore"] is None


def test_cutoffs_fail_the_families_that_use_them(spark):
    ref = [("fold_0", "e", "E", 0.0), ("fold_0", "a", "A", 2.0)]
    chunks = spark.createDataFrame([("c1", 100)], "accession string, chunk_len int")
    best = spark.createDataFrame([("c1", "e", 3.0), ("c1", "a", 4.0)], "accession string, marker string, bitscore double")
    frame = spark.createDataFrame(ref, "fold string, marker string, class_code string, cutoff double")
    summary = ops.marker_summary(chunks, best, frame, ["fold_0"])
    assert ops.gate_context(summary).first()["specific_max_bitscore"] == 2.0
    with pytest.raises(Exception, match="no positive cutoff for marker e"):
        ops.domain_marker_features(summary).collect()


def test_hash_rank_is_a_permutation(spark):
    df = spark.createDataFrame([(f"r{i}", "hot" if i % 3 else "cold") for i in range(500)], "id string, g string")
    first = {r["id"]: (r["g"], r["rank"]) for r in hash_rank(df, ["g"], "id", 1).collect()}
    again = {r["id"]: (r["g"], r["rank"]) for r in hash_rank(df.repartition(7), ["g"], "id", 1).collect()}
    assert first == again
    for g in ("hot", "cold"):
        ranks = sorted(rank for group, rank in first.values() if group == g)
        assert ranks == list(range(1, len(ranks) + 1))


def brute_seed_hits(queries, targets, k, share):
    kmers = lambda s: {s[i : i + k] for i in range(len(s) - k + 1)}
    out = []
    for q, qs in queries:
        for t, ts in targets:
            have, need = kmers(qs) & kmers(ts), kmers(ts)
            if have and len(have) >= share * len(need) - 1e-9:
                out.append((q, t, len(have), len(need)))
    return sorted(out)


def test_seed_search_equals_brute_force(spark, rows):
    rng = random.Random(9)
    core = "".join(rng.choice("ACDEFGHIKL") for _ in range(40))
    targets = [(f"t{i}", core[i * 5 : i * 5 + 15]) for i in range(5)] + [("low", "AAAAAAAAAA"), ("short", "AC")]
    queries = [(f"q{i}", "".join(rng.choice("ACDEFGHIKL") for _ in range(30)) + core[: i * 4]) for i in range(10)]
    # A repeat that a third of the queries hold.
    queries += [(f"hot{i}", "A" * 20 + core[i : i + 9]) for i in range(6)]
    q = spark.createDataFrame(queries, "query string, seq string")
    t = spark.createDataFrame(targets, "target string, seq string")
    for share in (0.1, 0.5, 1.0):
        got = ops.kmer_seed_hits(q, t, 3, share)
        assert rows(got, "query", "target", "shared", "target_kmers") == brute_seed_hits(queries, targets, 3, share)
    top = ops.kmer_seed_hits(q, t, 3, 0.1, top_k=2)
    assert top.groupBy("query").count().agg(F.max("count")).first()[0] <= 2
    with pytest.raises(ValueError):
        ops.kmer_seed_hits(q, t, 3, 0.0)


def test_seed_search_counts_where_the_query_lies(spark, rows, monkeypatch):
    rng = random.Random(10)
    core = "".join(rng.choice("ACDE") for _ in range(60))
    targets = [(f"t{i}", core[i * 5 : i * 5 + 25]) for i in range(5)] + [("rep", "A" * 30), ("short", "AC")]
    queries = [(f"q{i}", "".join(rng.choice("ACDE") for _ in range(50)) + core[: i * 9] + "A" * 25) for i in range(9)]
    q = spark.createDataFrame([*queries, ("none", None)], "query string, seq string")
    t = spark.createDataFrame([*targets, ("none", None)], "target string, seq string")
    found = ops.kmer_seed_hits(q, t, 3, 0.2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    counted = rows(found)
    assert [r[:4] for r in counted] == brute_seed_hits(queries, targets, 3, 0.2)
    monkeypatch.setattr(ops, "BROADCAST_ROWS", 1)  # both sides meet by k-mer
    assert rows(ops.kmer_seed_hits(q, t, 3, 0.2)) == counted


def test_sequence_search_writes_no_proteins(spark, rows, tmp_path, monkeypatch):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("bc") for _ in range(n))  # noqa: E731  C and G: no stop codon, open in all frames
    items = [text(90) for _ in range(4)]
    texts = [text(60 + i % 3) + items[i % 4][: 20 * i] + text(30) for i in range(12)] + [items[0] * 30, "short", "", None]
    sf, shared = str(tmp_path), spark.conf.get("spark.checkpoint.dir")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    best: dict[tuple[str, str], int] = {}
    proteins = [tuple(r) for r in genes.orfs(spark, sf).select("protein_id", "amino_acid_sequence").collect()]
    targets = views.references(spark, sf).select("target", gene_ops.translate_codons("seq"))
    for query, target, found, _ in brute_seed_hits(proteins, [tuple(r) for r in targets.collect()], 6, markers.SHARE):
        key = (query.rsplit("_", 1)[0], target)
        best[key] = max(found, best.get(key, 0))
    assert len(best) > 4
    before = set(os.listdir(shared))
    for most in (ops.BROADCAST_ROWS, 1):  # by a table of seeds; by a join, which writes its seeds
        monkeypatch.setattr(ops, "BROADCAST_ROWS", most)
        got = markers.sequence_marker_hits(spark, sf)
        assert rows(got, "accession", "marker", "shared") == sorted([(*k, n) for k, n in best.items()], key=repr)
        assert not [name for name in set(os.listdir(shared)) - before if "-orfs-" in name]
        plan = got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
        assert plan.count("find(") == 1  # sequences are scanned once
