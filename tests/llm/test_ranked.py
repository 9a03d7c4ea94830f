from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from seqharbor.llm import ranked

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def brute(docs, queries, top):
    """Every score of every document, sorted."""
    bags = [(k, Counter(words(t))) for k, t in docs]
    full = [(k, b) for k, b in bags if b]
    n_docs, total = len(full), sum(sum(b.values()) for _, b in full)
    df = Counter(t for _, b in full for t in b)
    out = []
    for item, text in queries:
        scored = []
        for k, bag in full:
            m = 50 + 50 * sum(bag.values()) * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
                for t in set(words(text)) & set(bag)
            )
            if score > 0:
                scored.append((-score, k is None, k or 0, k))
        out += [(item, i, k, -s) for i, (s, _, _, k) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def made(seed, docs=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "x1"]
    text = lambda most: " ".join(vocabulary[min(int(rng.expovariate(0.08)), 61)].upper() if rng.random() < 0.1 else vocabulary[min(int(rng.expovariate(0.08)), 61)] for _ in range(rng.randrange(most)))
    rows = [(i, text(80)) for i in range(docs)]
    rows += [(None, "w1 w2"), (None, None), (5, "w50 w51"), (7, ""), (8, " .. "), (900, "w3 " * 5000), (901, rows[3][1]), (901, rows[3][1])]
    return rows, [(i, text(30)) for i in range(20)] + [(98, None), (99, "nowhere"), (None, "w3")]


@pytest.mark.parametrize("top", [1, 5, 50, 1000])
def test_ranks_match_brute_force(spark, monkeypatch, top):
    docs, queries = made(top)
    # small shards everywhere, several blocks of queries once
    monkeypatch.setattr(ranked, "SHARD_POSTINGS", 200)
    if top == 5:
        monkeypatch.setattr(ranked, "QUERY_BYTES", 1500)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(*q, "a", 1) for q in queries], "item_id long, text string, key string, block int")
    got = ranked.search(frame, asked, top=top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(docs, queries, top)


def test_accumulators_stop_being_created():
    lists = {0: (np.array([0, 1, 2]), np.array([90, 80, 70]), 90), 1: (np.arange(100), np.full(100, 5), 5)}
    best = ranked.Best(2)
    at, score = ranked.search_shard(lists, [0, 1], 100, best)
    # the frequent term can lift no other document to the second best partial score, but it still counts
    assert dict(zip(at.tolist(), score.tolist(), strict=True)) == {0: 95, 1: 85}
    best.offer(score, at.tolist())
    assert best.least == 85
    # a tie may still come in by its key: a document of 85 is offered, one of 84 is not
    again = {0: (np.array([4, 6]), np.array([85, 84]), 85)}
    assert ranked.search_shard(again, [0], 10, best)[0].tolist() == [4]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w")], "item_id long, text string")
    assert ranked.search(docs, asked).count() == 0
    some = spark.createDataFrame([(1, "w")], "doc_id long, text string")
    assert ranked.search(some, asked.limit(0)).count() == 0
    assert ranked.search(some, asked).collect()[0][:3] == (1, 1, 1)


def test_string_keys(spark):
    docs = spark.createDataFrame([("b", "w"), ("a", "w"), (None, "w"), ("c", "v")], "doc_id string, text string")
    got = ranked.search(docs, spark.createDataFrame([("q", "w")], "item_id string, text string"))
    assert [r.doc_id for r in got.orderBy("rank").collect()] == ["a", "b", None]
