from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqharbor.operators import alignment as ops
from seqharbor.operators import markers, seeds

RESIDUES = "ARNDCQEGHILKMFPSTWYV"


def brute_align(q, t, diagonal, scoring, band):
    """(score, qstart, qend, tstart, tend, columns, equal), cell by cell in a table."""
    matrix = scoring.matrix()
    at = {r: i for i, r in enumerate(RESIDUES)}
    never = (-(10**9), ())
    best, plain, down, over = (0, ()), {}, {}, {}
    take = lambda *options: max(options, key=lambda o: o[0])  # noqa: E731 (the first of equals)
    longer = lambda cell, cost: (cell[0] - cost, (*cell[1][:2], cell[1][2] + 1, cell[1][3]) if cell[1] else ())
    for j in range(len(t)):
        for i in range(max(0, diagonal + j - band), min(len(q), diagonal + j + band + 1)):
            a, b = at.get(q[i], 20), at.get(t[j], 20)
            before = plain.get((i - 1, j - 1), (0, ()))
            start = before[1] if before[0] > 0 else (i, j, 0, 0)
            step = (max(before[0], 0) + int(matrix[a, b]), (start[0], start[1], start[2] + 1, start[3] + (a == b < 20)))
            inside = i - 1 >= diagonal + j - band
            over[i, j] = take(
                longer(plain.get((i - 1, j), never), scoring.gap_open), longer(over.get((i - 1, j), never), scoring.gap_extend)
            ) if inside else never
            inside = i <= diagonal + j - 1 + band
            down[i, j] = take(
                longer(plain.get((i, j - 1), never), scoring.gap_open), longer(down.get((i, j - 1), never), scoring.gap_extend)
            ) if inside else never
            cell = take(step, over[i, j], down[i, j])
            plain[i, j] = cell if cell[0] > 0 else (0, ())
            if plain[i, j][0] > best[0] or (plain[i, j][0] == best[0] > 0 and (i, j) < best[1][4:]):
                best = (cell[0], (*cell[1], i, j))
    if not best[0]:
        return None
    qs, ts, columns, equal, qe, te = best[1]
    return best[0], qs + 1, qe + 1, ts + 1, te + 1, columns, equal


def mutated(rng, seq, subs, indels):
    out = []
    for c in seq:
        if rng.random() < indels:
            out += [] if rng.random() < 0.5 else [c, *rng.choices(RESIDUES, k=rng.randrange(1, 4))]
        else:
            out.append(rng.choice(RESIDUES) if rng.random() < subs else c)
    return "".join(out)


@pytest.mark.parametrize("band", [0, 1, 4, 12])
def test_alignment_equals_brute_force(band):
    rng = random.Random(band)
    scoring = ops.Scoring(gap_open=6)
    pairs = []
    for _ in range(60):
        core = "".join(rng.choices(RESIDUES[: rng.choice([3, 20])], k=rng.randrange(1, 50)))
        q = "".join(rng.choices(RESIDUES, k=rng.randrange(15))) + mutated(rng, core, 0.2, 0.06) + "X*"
        t = mutated(rng, core, 0.1, 0.03) + "".join(rng.choices(RESIDUES, k=rng.randrange(9)))
        pairs.append((q, t, rng.randrange(-5, 16)))
    pairs += [("A", "", 0), ("", "A", 0), ("WWW", "WWW", 50), ("XXX", "XXX", 0), ("W", "W", 0)]
    query, qlen = ops._codes(pa.array([p[0] for p in pairs]))
    target, tlen = ops._codes(pa.array([p[1] for p in pairs]))
    score, found = ops.align_band(query, qlen, target, tlen, np.array([p[2] for p in pairs]), scoring, band)
    for (q, t, d), s, (qs, ts, columns, equal, qe, te) in zip(pairs, score.tolist(), found.tolist(), strict=True):
        got = (s, qs + 1, qe + 1, ts + 1, te + 1, columns, equal) if s > 0 else None
        assert got == brute_align(q, t, d, scoring, band), (q, t, d)


def test_wide_band_is_the_best_alignment_of_all():
    rng = random.Random(3)
    for _ in range(20):
        core = "".join(rng.choices(RESIDUES, k=30))
        q, t = mutated(rng, core, 0.2, 0.1), mutated(rng, core, 0.2, 0.1)
        query, qlen = ops._codes(pa.array([q]))
        target, tlen = ops._codes(pa.array([t]))
        narrow = ops.align_band(query, qlen, target, tlen, np.array([0]), ops.Scoring(), 3)[0][0]
        wide = ops.align_band(query, qlen, target, tlen, np.array([0]), ops.Scoring(), 60)[0][0]
        assert wide >= narrow and wide == brute_align(q, t, 0, ops.Scoring(), 100)[0]


def test_statistics_follow_from_the_scores():
    lam, k_value = ops.Scoring().statistics()
    p = np.array(list(ops.RESIDUE_FREQUENCIES.values()))
    p /= p.sum()
    assert (np.outer(p, p) * np.exp(lam * ops.Scoring().matrix()[:-1, :-1])).sum() == pytest.approx(1)
    assert 0.01 < k_value < 1
    with pytest.raises(ValueError, match="negative"):
        ops.Scoring(other=5).statistics()
    # scores of random pairs: the chance of the best score follows 1 - exp(-K m n exp(-lambda S))
    rng = np.random.default_rng(4)
    m, n, scores = 60, 60, []
    for _ in range(300):
        q, t = rng.choice(20, size=m, p=p), rng.choice(20, size=n, p=p)
        steps = ops.Scoring().matrix()[q[:, None], t[None, :]]
        best = 0
        for d in range(-m + 1, n):
            run = 0
            for s in np.diagonal(steps, d).tolist():
                run = max(0, run + s)
                best = max(best, run)
        scores.append(best)
    expected = sum(k_value * m * n * math.exp(-lam * s) for s in sorted(scores)[150:151])
    assert 0.25 < expected < 2  # the median has an expectation of ln 2, less edge effects


def proteins(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} string, seq string")


def test_diagonals_equal_brute_force(spark, rows, monkeypatch):
    rng = random.Random(7)
    targets = [(f"t{i}", "".join(rng.choices("ACDE", k=20))) for i in range(6)] + [("short", "AC"), ("rep", "AAAAAAAA")]
    queries = [(f"q{i}", "".join(rng.choices("ACDE", k=40))) for i in range(20)] + [("hot", "A" * 60), ("none", None), ("", "ACD")]
    want = []
    for q, qs in queries:
        for t, ts in targets:
            found = Counter(i - j for i in range(len(qs or "") - 2) for j in range(len(ts) - 2) if qs[i : i + 3] == ts[j : j + 3])
            best = max(((n, -d) for d, n in found.items() if n >= 2), default=None)
            if best:
                want.append((q, t, -best[1], best[0]))
    for most in (1_000_000, 3):
        monkeypatch.setattr(ops, "BROADCAST_SEEDS", most)
        got = ops.seed_diagonals(proteins(spark, queries, "query"), proteins(spark, targets, "target"), 3, 2)
        assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("band", [0, 8])
def test_search_gives_spans_and_thresholds_act_on_them(spark, band):
    rng = random.Random(11)
    cores = ["".join(rng.choices(RESIDUES, k=60)) for _ in range(5)]
    targets = [(f"m{i}", c) for i, c in enumerate(cores)]
    queries = [(f"p{i}_1", "".join(rng.choices(RESIDUES, k=30)) + c[10:50]) for i, c in enumerate(cores)]
    queries += [("gap_1", cores[0][:30] + "GGG" + cores[0][30:]), ("none_1", "".join(rng.choices(RESIDUES, k=80)))]
    hits = ops.search_alignments(proteins(spark, queries, "query"), proteins(spark, targets, "target"), band=band)
    found = {(r["query"], r["target"]): r for r in hits.where("evalue < 1e-3").collect()}
    for i in range(5):
        r = found[f"p{i}_1", f"m{i}"]
        assert (r["qstart"], r["qend"], r["tstart"], r["tend"], r["alnlen"], r["pident"]) == (31, 70, 11, 50, 40, 1.0) or r["alnlen"] > 40
        lam, k_value = ops.Scoring().statistics()
        assert r["evalue"] == pytest.approx(k_value * r["qlen"] * 300 * math.exp(-lam * r["score"]))
        assert r["bits"] == pytest.approx((lam * r["score"] - math.log(k_value)) / math.log(2))
    gap = found["gap_1", "m0"]
    assert gap["alnlen"] == (63 if band else 30) and gap["pident"] == pytest.approx(60 / 63 if band else 1.0)
    assert not [k for k in found if k[0] == "none_1"]
    kept = markers.filter_hits(hits, 1e-3, 0.0, 0.97).select("query").collect()
    assert ("gap_1",) not in {tuple(r) for r in kept} or not band
    wide = {r["query"] for r in markers.filter_hits(hits, 1e-3, 0.6).collect()}
    assert ("gap_1" in wide) == bool(band)


def test_empty_tables(spark):
    none, some = proteins(spark, [], "query"), proteins(spark, [("t", "ACDEF")], "target")
    assert ops.search_alignments(none, some).count() == 0
    assert ops.search_alignments(proteins(spark, [("q", "ACDEF")], "query"), some.limit(0)).count() == 0


def test_search_shuffles_no_match(spark):
    rng = random.Random(13)
    targets = proteins(spark, [(f"m{i}", "".join(rng.choices(RESIDUES, k=60))) for i in range(5)], "target")
    queries = proteins(spark, [(f"q{i}", "".join(rng.choices(RESIDUES, k=80))) for i in range(50)], "query")
    plan = ops.seed_diagonals(queries, targets)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_long_queries_and_kmers(spark, rows, monkeypatch):
    """Parts of a query meet at every place, matches are counted over pieces, and numbers of long k-mers are ranked."""
    rng = random.Random(17)
    monkeypatch.setattr(seeds, "MATCHES", 5)
    monkeypatch.setattr(seeds, "SLICE_LETTERS", 7)
    core = "".join(rng.choices("ACDE", k=60))
    targets = [("t", core), ("u", core[20:50] + "é" + core[:9])]
    queries = [("q", "".join(rng.choices("ACDE", k=40)) + core + core), ("r", core[:33] + "W" + core[33:]), ("s", core[5:22])]
    for k in (3, 16, 32):
        want = []
        for q, qs in queries:
            for t, ts in targets:
                qb, tb = qs.encode(), ts.encode()
                found = Counter(i - j for i in range(len(qb) - k + 1) for j in range(len(tb) - k + 1) if qb[i : i + k] == tb[j : j + k])
                top = max(((n, -d) for d, n in found.items() if n >= 2), default=None)
                want += [(q, t, -top[1], top[0])] if top else []
        tables = proteins(spark, queries, "query"), proteins(spark, targets, "target")
        for most in (1_000_000, 1):
            monkeypatch.setattr(ops, "BROADCAST_SEEDS", most)
            assert rows(ops.seed_diagonals(*tables, k, 2)) == sorted(want, key=repr), (k, most)
