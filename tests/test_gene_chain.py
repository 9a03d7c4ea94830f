from __future__ import annotations

import random
from collections import Counter
from itertools import combinations
from math import floor, log

import pytest

from seqharbor.operators import gene_chain as chains, genes as ops

PAIR = dict(zip("ACGTN", "TGCAN"))


def fits(x, y, same, opposite):
    """Two frames (begin, end, strand, score), in order of their ends, as neighbours or not."""
    shared = x[1] - y[0] + 1
    return x[0] < y[0] and x[1] < y[1] and shared <= (same if x[2] == y[2] else opposite)


def brute_total(frames, same, opposite):
    """The highest total of any set of frames in which all pairs fit."""
    best = 0
    for size in range(1, len(frames) + 1):
        for picked in combinations(frames, size):
            if all(fits(x, y, same, opposite) for x, y in combinations(picked, 2)):
                best = max(best, sum(f[3] for f in picked))
    return best


def test_chain_equals_all_subsets():
    rng = random.Random(3)
    for _ in range(300):
        frames = set()
        while len(frames) < 9:
            begin = rng.randrange(1, 60)
            frames.add((begin, begin + rng.randrange(3, 30), rng.choice((1, -1))))
        frames = [(*f, rng.randrange(-3, 9)) for f in sorted(frames, key=lambda f: (f[1], f[0], f[2]))]
        same = rng.randrange(0, 9)
        opposite = rng.randrange(0, same + 1)
        kept = chains.best_chain(*[list(c) for c in zip(*frames)], same, opposite)
        picked = [frames[i] for i in kept]
        assert all(f[3] > 0 for f in picked)
        assert all(fits(x, y, same, opposite) for x, y in combinations(picked, 2))
        assert sum(f[3] for f in picked) == brute_total([f for f in frames if f[3] > 0], same, opposite)


def test_ties_and_nothing_to_choose():
    assert chains.best_chain([], [], [], []) == []
    assert chains.best_chain([1, 1], [90, 93], [1, 1], [0, -5]) == []
    # equal totals: the first of the ordered frames
    assert chains.best_chain([1, 1], [90, 90], [-1, 1], [7, 7]) == [0]
    assert chains.best_chain([1, 40], [90, 120], [1, -1], [7, 7]) == [0]
    assert chains.best_chain([1, 40], [90, 120], [1, 1], [7, 7]) == [0, 1]
    with pytest.raises(ValueError):
        chains.best_chain([1], [90], [1], [7], 10, 20)


def in_frame(seq, gene):
    begin, end, strand = gene
    part = seq[begin - 1 : end]
    if strand == -1:
        part = "".join(PAIR[c] for c in reversed(part))
    return [part[i : i + 6] for i in range(0, len(part) - 5, 3)]


def test_model_and_scores_equal_a_plain_count(spark):
    rng = random.Random(8)
    seqs = {f"s{n}": "".join(rng.choice("AACCGGT") for _ in range(n)) for n in (99, 100, 400, 2500)}
    seqs["n"] = "ATG" + "GCNGCA" * 30
    seqs["empty"] = ""
    df = spark.createDataFrame([*seqs.items(), (None, "ACGT" * 40), ("null", None)], "accession string, seq string")
    coding, background = Counter(), Counter()
    orfs = [(r.accession, r.begin_pos, r.end_pos, r.strand) for r in ops.orf_scan(df).collect()]
    for name, *gene in orfs:
        if gene[1] - gene[0] + 1 >= 120:
            coding.update(in_frame(seqs[name] if name else "ACGT" * 40, gene))
    for seq in [s for s in seqs.values() if len(s) >= 100] + ["ACGT" * 40]:
        for read in (seq, "".join(PAIR[c] for c in reversed(seq))):
            background.update(read[i : i + 6] for i in range(len(read) - 5))
    known = {h: (coding[h], background[h]) for h in background if set(h) <= set("ACGT")}
    model = chains.coding_model(df, 120)
    found = {r.hexamer: (r.coding, r.background, r.weight) for r in model.collect()}
    assert len(found) == 4096 and {h: v[:2] for h, v in found.items() if v[1]} == known
    tops = [sum(v[i] for v in known.values()) + 4096 for i in (0, 1)]
    for c, b, weight in found.values():
        assert weight == floor(1000 * log(((c + 1) / tops[0]) / ((b + 1) / tops[1])) + 0.5)

    chosen = chains.gene_chain(df, model).collect()
    assert chosen
    for r in chosen:
        seq = seqs[r.accession] if r.accession else "ACGT" * 40
        assert (r.accession, r.begin_pos, r.end_pos, r.strand) in orfs
        assert r.coding_score == sum(found.get(h, (0, 0, 0))[2] for h in in_frame(seq, (r.begin_pos, r.end_pos, r.strand)))
    for name in {r.accession for r in chosen}:
        own = sorted((r.idx, r.begin_pos, r.end_pos, r.strand) for r in chosen if r.accession == name)
        assert [g[0] for g in own] == list(range(1, len(own) + 1))
        for x, y in combinations([g[1:] for g in own], 2):
            assert fits(x, y, chains.SAME_STRAND_OVERLAP, chains.OPPOSITE_STRAND_OVERLAP)


def test_a_planted_gene_beats_its_shadows(spark):
    rng = random.Random(5)
    usual = ["GCT", "GAA", "CTG", "AAA", "GGT", "ATC"]  # a biased codon use on both strands' genes
    gene = lambda n: "ATG" + "".join(rng.choice(usual) for _ in range(n)) + "TAA"
    noise = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rows, planted = [], set()
    for i in range(12):
        first, second = gene(150), gene(200)
        turned = "".join(PAIR[c] for c in reversed(second))
        seq = noise(57) + first + noise(80) + turned + noise(40)
        rows.append((f"c{i}", seq))
        end1 = 57 + len(first)
        end2 = end1 + 80 + len(turned)
        planted |= {(f"c{i}", end1, 1), (f"c{i}", end2 - len(turned) + 1, -1)}
    df = spark.createDataFrame(rows, "accession string, seq string")
    found = {(r.accession, r.end_pos if r.strand == 1 else r.begin_pos, r.strand) for r in chains.gene_chain(df).collect()}
    assert planted <= found
    assert chains.gene_chain(df).count() < ops.orf_scan(df).count()


def test_empty_table(spark):
    none = spark.createDataFrame([], "accession string, seq string")
    assert chains.coding_model(none).count() == 4096
    assert chains.gene_chain(none).count() == 0
