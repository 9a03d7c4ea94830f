from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from seqharbor.constants import BACTEROIDETES_MOTIFS, BINDING_SITES, CANONICAL_SD_MOTIFS, TATATA_MOTIFS
from seqharbor.operators import genes as ops
from seqharbor.operators import sequences

GENES = "accession string, idx int, begin_pos int, end_pos int, strand int, aa_len int, motif string, score double"


def test_translate(spark):
    df = spark.createDataFrame([("ATGGCNTAAGG",), ("AT",)], "s string")
    assert [r[0] for r in df.select(ops.translate_codons("s")).collect()] == ["MX*", ""]
    assert df.select(ops.reverse_complement("s")).first()[0] == "CCTTANGCCAT"


def scan_loop(seq, min_bases=90):
    """Codon by codon over six frames."""
    table, found = ops.codon_table(), set()
    pair = dict(zip("ACGTN", "TGCAN"))
    for strand in (1, -1):
        s = seq if strand == 1 else "".join(pair[c] for c in reversed(seq))
        for f in range(3):
            codons = [s[i : i + 3] for i in range(f, len(s) - 2, 3)]
            begin, edge = 0, True
            for i in range(len(codons) + 1):
                at_end = i == len(codons)
                if not at_end and table.get(codons[i]) != "*":
                    continue
                stretch = range(begin, i)
                first = begin if edge else next((j for j in stretch if codons[j] in ("ATG", "GTG", "TTG")), None)
                stop = i if at_end else i + 1
                if first is not None and first < i and (stop - first) * 3 >= min_bases:
                    aa = "".join(table.get(c, "X") for c in codons[first:stop])
                    if not edge:
                        aa = "M" + aa[1:]
                    low, high = f + 3 * first + 1, f + 3 * stop
                    left, right = edge, at_end
                    start = "Edge" if edge else codons[first]
                    if strand == -1:
                        low, high, left, right = len(s) - high + 1, len(s) - low + 1, right, left
                    found.add((low, high, strand, left, right, start, aa))
                begin, edge = i + 1, False
    return found


def test_scan_equals_the_loop(spark):
    rng = random.Random(4)
    seqs = {f"s{n}": "".join(rng.choice("ACGTACGTACGTACGTN") for _ in range(n)) for n in (99, 100, 101, 350, 1207)}
    seqs["open"] = "GCC" * 60
    df = spark.createDataFrame(list(seqs.items()), "accession string, seq string")
    found: dict[str, set] = {name: set() for name in seqs}
    for r in ops.orf_scan(df).collect():
        assert r["aa_len"] == len(r["amino_acid_sequence"])
        found[r["accession"]].add(
            (r["begin_pos"], r["end_pos"], r["strand"], r["partial_begin"], r["partial_end"], r["start_type"],
             r["amino_acid_sequence"])
        )
    for name, seq in seqs.items():
        assert found[name] == (scan_loop(seq) if len(seq) >= 100 else set())


def test_scan_translation_agrees_with_the_expression(spark):
    rng = random.Random(5)
    seq = "".join(rng.choice("ACGT") for _ in range(3000))
    df = spark.createDataFrame([("a", seq)], "accession string, seq string")
    orfs = ops.orf_scan(df).join(df, "accession")
    part = F.expr("substring(seq, begin_pos, end_pos - begin_pos + 1)")
    coding = F.when(F.col("strand") == 1, part).otherwise(ops.reverse_complement(part))
    pairs = orfs.select("amino_acid_sequence", ops.translate_codons(coding).alias("t")).collect()
    assert pairs and all(r[0][1:] == r[1][1:] for r in pairs)


def test_numbering_counts_every_gene(spark, rows):
    df = spark.createDataFrame(
        [("a", 50, 90, 1), ("a", 10, 90, -1), ("a", 10, 90, 1), ("b", 1, 5, 1), ("a", 10, 30, 1)],
        "accession string, begin_pos int, end_pos int, strand int",
    )
    found = rows(ops.number_proteins(df), "protein_id", "begin_pos", "end_pos", "strand")
    assert found == [("a_1", 10, 30, 1), ("a_2", 10, 90, -1), ("a_3", 10, 90, 1), ("a_4", 50, 90, 1), ("b_1", 1, 5, 1)]


def test_rbs_groups(spark):
    motifs = ["taaa", "AGGAG", "AGxAG", "tata", "3Base/5BMM", "", None, "CCC"]
    df = spark.createDataFrame([(m,) for m in motifs], "motif string")
    flags = ops.classify_rbs("motif")
    found = [tuple(r) for r in df.select(*[flags[k] for k in flags]).collect()]
    nothing = (False, False, False)
    # Patterns holding lower case never equal an upper-cased motif.
    assert found == [(True, False, False), (False, True, False), nothing, (False, False, True), nothing,
                     nothing, nothing, nothing]


def random_genes(rng, name, n):
    out, at = [], 1
    for i in range(1, n + 1):
        at += rng.randint(0, 6)
        aa = rng.choice([30, 89, 90, 150])
        out.append((name, i, at, at + rng.randint(1, 8), rng.choice([1, -1]), aa,
                    rng.choice([None, "", "AGGAG", "tata", "TAAA"]), rng.random() * 10))
    return out


def context_loop(genes):
    out, last_stop, last_strand = [], {1: -3, -1: -3}, None
    for _, idx, begin, end, strand, aa, _, _ in genes:
        if aa >= 90:
            out.append((idx, begin - 1 <= 2, begin - 1 - last_stop[strand] <= 3,
                        last_strand is not None and strand != last_strand))
            last_strand = strand
        last_stop[strand] = end
    return out


def test_context_equals_the_loop_also_across_blocks(spark, monkeypatch):
    rng = random.Random(6)
    groups = {f"g{n}": random_genes(rng, f"g{n}", n) for n in (1, 2, 7, 40)}
    df = spark.createDataFrame([g for part in groups.values() for g in part], GENES)
    for block, most in ((4096, None), (3, None), (1, None), (4096, 40), (3, 40)):
        monkeypatch.setattr(ops, "GENE_BLOCK", block)
        found: dict[str, list] = {}
        for r in ops.gene_context(df, most_genes=most).orderBy("accession", "idx").collect():
            found.setdefault(r["accession"], []).append((r["idx"], r["leaderless"], r["short_utr"], r["strand_switch"]))
        for name, part in groups.items():
            assert found.get(name, []) == context_loop(part)


def test_arch_features_by_gene_count(spark):
    genes = [
        ("one", 1, 1, 300, 1, 99, None, 3.0),
        ("dropped", 1, 1, 30, 1, 20, "TAAA", 3.0),
        ("two", 1, 101, 400, 1, 99, "TAAA", 50.0),
        ("two", 2, 500, 799, -1, 99, None, 70.0),
    ]
    chunks = spark.createDataFrame(
        [("none", 1000), ("one", 1000), ("dropped", 1000), ("two", 2000), ("empty", 0)], "accession string, chunk_len int"
    )
    context = ops.gene_context(spark.createDataFrame(genes, GENES))
    table = {r["accession"]: r for r in ops.arch_features(chunks, context, 10000, True).collect()}
    for name in ("none", "dropped", "empty"):
        r = table[name]
        assert (r["n_genes"], r["coding_density"]) == (0, 0.0)
        assert r["no_rbs_freq"] is None and r["gene_density"] is None and r["max_orf_length"] is None
    one = table["one"]
    assert one["n_genes"] == 1 and one["coding_density"] == 0.3 and one["no_rbs_freq"] == 1.0
    assert one["mean_rbs_score"] == 0.0 and one["median_orf_length"] == 99.0
    assert [one[c] for c in ("strand_switch_rate", "short_utr_freq", "leaderless_freq", "gene_density")] == [None] * 4
    two = table["two"]
    assert two["strand_switch_rate"] == 0.5 and two["mean_rbs_score"] == 0.5
    assert two["sd_bacteroidetes_rbs_freq"] == 0.5 and two["fragment_size"] == 0.2
    assert (two["gene_density"], two["gene_density_fwd"], two["gene_density_rev"]) == (1.0, 0.5, 0.5)
    vector = ops.feature_vector(ops.arch_features(chunks, context)).where("accession = 'none'").first()["vector"]
    assert len(vector) == 14 and vector[1] != vector[1] and vector[2] == 0.0


def test_partitioning_does_not_matter(spark, rows):
    rng = random.Random(8)
    seqs = [(f"s{i}", "".join(rng.choice("ACGT") for _ in range(900))) for i in range(12)]
    df = spark.createDataFrame(seqs, "accession string, seq string")
    def run(frame):
        chunks = sequences.chunk_overlap(frame, 300, 50)
        return rows(ops.orf_scan(chunks), "protein_id", "begin_pos", "end_pos", "strand")
    assert run(df.coalesce(1)) == run(df.repartition(13)) == run(df.orderBy(F.desc("accession")))


def brute_site(before):
    for place, (motif, pattern, least, most) in enumerate(BINDING_SITES):
        if re.search(pattern + ".{%d,%d}$" % (least, most), before):
            return motif, f"{least}-{most}bp", float(len(BINDING_SITES) - place)
    return None


def test_binding_sites_equal_brute_force(spark):
    rng = random.Random(12)
    cases = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(21))) for _ in range(400)]
    cases += ["", "A" * 20, "AGGAGG" + "C" * 5, "AGGAGG" + "C" * 2, "AGGAGG" + "C" * 16, "TATATACCCCCC", "NNAGNAGGCCCC"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, upstream string")
    got = df.select("i", ops.binding_site("upstream").alias("s")).collect()
    assert {r["i"]: r["s"] and tuple(r["s"]) for r in got} == {i: brute_site(c) for i, c in enumerate(cases)}
    assert set(m for m, *_ in BINDING_SITES) <= set(CANONICAL_SD_MOTIFS + BACTEROIDETES_MOTIFS + TATATA_MOTIFS)


def test_sites_are_read_before_the_start_on_both_strands(spark):
    gene = "AGGAGGCCCCCC" + "ATG" + "GCA" * 40 + "TAA"
    edge = "AGGAGGCCCCCC"
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([("f", "TAA" + gene), ("r", flip("TAA" + gene)), ("e", edge + "GCA" * 60)], "accession string, seq string")
    orfs = ops.orf_scan(df).where("start_type = 'ATG'").collect()
    found = {r["accession"]: (r["rbs_motif"], r["rbs_spacer"], r["rbs_score"], r["strand"]) for r in orfs if r["aa_len"] == 42}
    top = float(len(BINDING_SITES))
    assert found == {"f": ("AGGAGG", "5-10bp", top, 1), "r": ("AGGAGG", "5-10bp", top, -1)}
    edges = ops.orf_scan(df).where("start_type = 'Edge'")
    assert edges.where("rbs_motif <> '' or rbs_score is not null").count() == 0 < edges.count()
    context = ops.gene_context(ops.gene_table(ops.orf_scan(df)), 30)
    assert {r["rbs_score"] for r in context.where("has_rbs and is_canonical_rbs").collect()} >= {top}
