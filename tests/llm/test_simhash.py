from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqharbor.llm import simhash
from seqharbor.llm.components import components

SCHEMA = "doc_id bigint, text string, fp string, mask int"


def brute_print(text, words=3):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, budget):
    roots = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if (prints[i] ^ prints[j]).bit_count() <= budget and roots[j] < roots[i]:
                    roots[i], changed = roots[j], True
    return roots


def random_prints(n, seed, flips):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    out = {int(x) for x in rng.integers(0, 1 << 63, n // 2, dtype=np.uint64)}
    while len(out) < n:
        x = int(base[rng.integers(8)])
        for b in rng.integers(0, 64, rng.integers(1, flips + 1)):
            x ^= 1 << int(b)
        out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


@pytest.mark.parametrize("budget", [0, 1, 2, 5])
def test_trie_roots_match_all_pairs(budget, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 37)
    prints = random_prints(120, budget, 4)
    got = simhash.trie_roots(prints, np.zeros(len(prints), dtype=int), budget)
    assert got.tolist() == brute_components([int(p) for p in prints], budget)


def test_trie_roots_stay_in_their_group_and_heed_the_guard():
    prints = np.array([1, 3, 1, 3], dtype=np.uint64)
    groups = np.array([0, 0, 1, 1])
    assert simhash.trie_roots(prints, groups, 1).tolist() == [0, 0, 2, 2]
    guards = np.array([0, 0, 0, 7], dtype=np.uint64)
    assert simhash.trie_roots(prints, groups, 1, guards, 2).tolist() == [0, 0, 2, 3]
    assert simhash.trie_roots(prints[:0], groups[:0], 1).tolist() == []


@pytest.mark.parametrize("group_rows,blocks", [(2048, None), (4, None), (4, 5)])
def test_links_connect_what_all_pairs_connect(spark, group_rows, blocks):
    prints = random_prints(150, 3, 4)
    signed = prints.view(np.int64).tolist()
    nodes = spark.createDataFrame([(f, 0) for f in signed], "fp bigint, guard bigint")
    links = simhash.trie_links(nodes, 2, blocks, group_rows=group_rows)
    got = {r.node: r.root for r in components(links).collect()}
    want = brute_components([int(p) for p in prints], 2)
    named = {}
    for f, root in zip(signed, want, strict=True):
        named.setdefault(root, set()).add(got.get(f, f))
    assert all(len(x) == 1 for x in named.values()) and len({min(x) for x in named.values()}) == len(named)


def test_components_of_paths_hubs_and_loops(spark):
    edges = [(i + 1, i) for i in range(60)] + [(1000, i) for i in range(200, 260)] + [(7000, 7000), (None, 3), (9, 9)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(61)} | {i: 200 for i in [*range(200, 260), 1000]}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_fingerprints_and_components_match_brute_force(spark):
    long = " ".join(f"w{i % 700}" for i in range(9000))
    texts = ["a b c d", "A  B\tc d", "a b c d e", None, "", " \n", "one", "ONE", "zwölf Boxkämpfer", long, long + " x", "É é", "é é"]
    rows = [(i * 3, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a b c d", "x", 1), (0, "a b c d", "x", 1)]
    got = simhash.simhash_components(spark.createDataFrame(rows, SCHEMA))
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    found = got.collect()
    assert len(found) == len(rows)
    prints = [brute_print(t) for t in texts]
    roots = brute_components(prints, 2)
    want = {i * 3: (format(p, "016x"), r * 3) for i, (p, r) in enumerate(zip(prints, roots, strict=True))}
    for r in found:
        if r.doc_id is None:
            assert (r.fingerprint, r.component_id) == want[0]
        else:
            assert (r.fingerprint, r.component_id) == want[r.doc_id]


def test_only_null_ids_have_no_component(spark):
    rows = [(None, "some words here now", "", 0), (None, "some words here now", "", 0)]
    found = simhash.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.component_id for r in found] == [None, None]


def test_empty_table(spark):
    got = simhash.simhash_components(spark.createDataFrame([], SCHEMA).withColumn("fingerprint", F.lit("x")))
    assert got.count() == 0
