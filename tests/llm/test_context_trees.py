from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from seqharbor.llm import context_trees as trees


def stream(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


class Brute:
    """The tree of every (context, node), weighted by recursion."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, {}, {}
        for data in texts:
            self.walk(data, self.learn)

    def walk(self, data, visit):
        data = b"\n" * self.depth + data
        for i in range(self.depth, len(data)):
            for k in range(8):
                node = (1 << k) | (data[i] >> (8 - k))
                visit(data[i - self.depth : i], node, data[i] >> (7 - k) & 1)

    def learn(self, context, node, bit):
        for d in range(self.depth + 1):
            key = (context[self.depth - d :], node)
            self.counts.setdefault(key, [0, 0])[bit] += 1
            if d < self.depth:
                self.children.setdefault(key, set()).add((context[self.depth - d - 1 :], node))

    def own(self, key):
        a, b = self.counts.get(key, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, key):
        if not hasattr(self, "memo"):
            self.memo = {}
        if key not in self.memo:
            value = self.own(key)
            if len(key[0]) < self.depth:
                value = np.logaddexp(value, self.below(key)) - math.log(2)
            self.memo[key] = value
        return self.memo[key]

    def below(self, key):
        return sum(self.weighted(c) for c in self.children.get(key, ()))

    def chance(self, context, node, d=0):
        key = (context[self.depth - d :], node)
        a, b = self.counts.get(key, (0, 0))
        guess = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return guess
        share = 1 / (1 + math.exp(self.below(key) - self.own(key)))
        return share * guess + (1 - share) * self.chance(context, node, d + 1)

    def score(self, data):
        total = 0.0

        def add(context, node, bit):
            nonlocal total
            p = self.chance(context, node)
            total += math.log10(p if bit else 1 - p)

        self.walk(data, add)
        return total


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_scores_match_a_plain_tree(spark):
    rng = random.Random(1)
    words = ["the", "cat", "sat", "Mat", "on", "é", "日本", "a", "zzz"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(24)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, " \n\t"), (None, "the cat"), (103, "unseenword only"), (3, texts[3])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, block int")
    got = trees.score_texts(frame, depth=4).collect()
    learned = [t for i, t in rows if not held(i)]
    brute = Brute([stream(t) for t in learned], 4)
    counts: dict = {}
    for t in learned:
        for w in [*(t or "").encode().lower().split(), "end"]:
            counts[w] = counts.get(w, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), "end"]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        want[i] = (held(i), len(tokens), sum(w in counts for w in tokens), total, base, brute.score(stream(t)))
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert tuple(r)[5:] == pytest.approx(want[r.doc_id][4:], rel=1e-5)


def test_probabilities_of_a_context_add_up_to_one():
    rng = np.random.default_rng(0)
    data = [bytes(rng.choice(list(b"abc "), 400).astype(np.uint8)).split() for _ in range(3)]
    grams, _ = trees.gram_stream(data, 4)
    seen, counts = np.unique(grams, return_counts=True)
    context = seen[0] >> np.uint64(8) << np.uint64(8)
    every = np.unique(np.r_[seen, context | np.arange(256, dtype=np.uint64)])
    many = np.zeros(len(every), dtype=np.int64)
    many[np.searchsorted(every, seen)] = counts
    tree = trees.Subtrees(every, many, 4)
    c3, node, *_ = tree.roots()
    name = np.sort(c3 * 256 + node)
    logs = tree.log_probabilities(name, np.full(len(name), 0.1), np.full(len(name), 0.8))
    assert np.exp(logs[np.isin(every, context | np.arange(256, dtype=np.uint64))]).sum() == pytest.approx(1)


def test_lgamma_and_packing():
    x = np.array([0.5, 1, 1.5, 7, 100.5, 1e6])
    assert trees.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-8, rel=1e-12)
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64))
    assert (trees.unpack(trees.pack(values)) == values).all() and len(trees.unpack(trees.pack(values[:0]))) == 0


def test_long_texts_empty_tables_and_no_training_rows(spark):
    schema = "doc_id bigint, text string"
    assert trees.score_texts(spark.createDataFrame([], schema)).count() == 0
    out = [i for i in range(200) if held(i)][:2]
    rows = trees.score_texts(spark.createDataFrame([(i, "some text") for i in out], schema)).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 for r in rows)
    # 80 bits of which nothing is known
    assert rows[0].score == pytest.approx(80 * math.log10(0.5))
    long = spark.createDataFrame([(2, "word " * 600_000), (out[0], "word word")], schema)
    found = {r.doc_id: r for r in trees.score_texts(long).collect()}
    assert found[2].n_tokens == 600_001 and -100 < found[2].score < 0 and -10 < found[out[0]].score < 0
