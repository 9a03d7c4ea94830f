from __future__ import annotations

import math
import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from seqharbor.llm import toxicity


def brute_segments(scores):
    """All maximal segments by their definition: the best one, then those left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 0 and (best is None or s > best[2] or s == best[2] and j - i < best[1] - best[0]):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return [*brute_segments(scores[:i]), best, *[(a + j, b + j, x) for a, b, x in brute_segments(scores[j:])]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-40, 40).map(lambda v: v * 1.0), max_size=24, unique=True))
def test_segments_by_definition(scores):
    got = toxicity.maximal_segments(np.array(scores))
    assert [x for *_, x in got] == [x for *_, x in brute_segments(scores)]


def documents(n, seed):
    rng = random.Random(seed)
    calm = [f"w{i}" for i in range(300)]
    foul = [f"foul{i}" for i in range(12)]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.25
        words = [rng.choice(calm) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(2, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(foul))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = documents(900, 1)
    rows += [(9000, None), (9001, ""), (9002, "foul1 " * 20000), (9003, "?!"), (None, "w1 w2"), (0, rows[0][1]), (9004, "FOUL1 foul2, foul3! " * 3)]
    given_ = [*labels, (1, None), (None, 1), (2, labels[2][1]), (70000, 1)]
    docs = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id bigint, text string, lang string, toxic int")
    got = toxicity.toxicity(docs, spark.createDataFrame(given_, "doc_id bigint, toxic int"))
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    truth = dict(labels)
    held = [r for r in found if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right >= 0.95 * len(held) and sum(truth[r.doc_id] for r in held) > 10
    by_id = {r.doc_id: r for r in found}
    assert by_id[9002].predicted == by_id[9004].predicted == 1
    assert by_id[9000].score == by_id[9001].score == by_id[9003].score < 0.5


def test_scores_do_not_see_other_columns_or_held_out_labels(spark):
    rows, labels = documents(300, 2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    one, two = (
        {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id bigint, toxic int")).collect()}
        for x in (labels, flipped)
    )
    assert one == two


def test_passages_and_empty_tables(spark):
    rows, labels = documents(400, 3)
    truth = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    odds = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), truth)
    text = "w1 w2 w3 w4 w5 w6 w7 w8 foul1 foul2 foul3 w9 w10 w11 w12"
    docs = spark.createDataFrame([(1, text, 5)], "doc_id bigint, text string, tox_score int")
    row = toxicity.score_documents(docs, odds, passages=True).first()
    assert (row.tox_words, row.tox_starts, row.tox_ends) == (15, [8], [11])
    none = docs.limit(0)
    assert toxicity.score_documents(none, odds).count() == 0
    assert toxicity.toxicity(none, truth).count() == 0
    # nothing to learn from
    blank = toxicity.toxicity(docs, truth.limit(0)).first()
    assert 0 <= blank.score <= 1


def plain_fit(rows, labels, buckets=1 << 12):
    """``fit`` by loops over words and documents, one document at a time."""
    truth: dict = {}
    for i, y in [x for x in labels if x[0] is not None]:
        truth[i] = max(truth.get(i, 0), y)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    seen = [(truth[i], fold(i), toxicity.words((t or "").lower().encode())) for i, t in rows if i in truth and fold(i)]

    def learn(folds):
        word, stem, of = np.zeros((buckets, 2)), np.zeros((buckets, 2)), {}
        totals = [0, 0]
        for y, f, found in seen:
            for w in found:  # a word's stem is known from all folds
                k, s = toxicity.bucket(w, buckets), toxicity.bucket(toxicity.stem(w), buckets)
                of[k] = min(of.get(k, buckets), s)
            if f in folds:
                totals[y] += 1
                for k in {toxicity.bucket(w, buckets) for w in found}:
                    word[k, y] += 1
                for k in {toxicity.bucket(toxicity.stem(w), buckets) for w in found}:
                    stem[k, y] += 1
        rate = (totals[1] + 1) / (sum(totals) + 20)
        base = math.log(rate / (1 - rate))
        stem_odds, word_odds = {}, {}
        for k in range(buckets):
            p = (stem[k, 1] + toxicity.PRIOR * rate) / (stem[k].sum() + toxicity.PRIOR)
            stem_odds[k] = math.log(p / (1 - p)) - base
        for k, s in of.items():
            if word[k].sum():
                up = (stem[s, 1] + toxicity.PRIOR * rate) / (stem[s].sum() + toxicity.PRIOR)
                p = (word[k, 1] + toxicity.PRIOR * up) / (word[k].sum() + toxicity.PRIOR)
                word_odds[k] = math.log(p / (1 - p)) - base
        weigh = lambda o: (o if abs(o) > toxicity.QUIET else 0.0) - toxicity.DRIFT
        calm = [(weigh(o), word[k, 0]) for k, o in word_odds.items() if word[k, 0]]
        decay = toxicity.decay_rate(np.array([c[0] for c in calm]), np.array([c[1] for c in calm]))
        score = lambda w: weigh(word_odds.get(toxicity.bucket(w, buckets), stem_odds[toxicity.bucket(toxicity.stem(w), buckets)]))
        return word_odds, decay, score

    _, decay, score = learn({1, 2, 3})
    measured = []
    for y, f, found in seen:
        if f == 4:
            segments = [s for *_, s in toxicity.maximal_segments(np.array([score(w) for w in found]))]
            measured.append((y, len(found), segments))
    calm = [(n, max(s, default=0.0)) for y, n, s in measured if y == 0 and n]
    scale = len(calm) / sum(n * math.exp(-decay * b) for n, b in calm)
    x, y = [], []
    for label, n, segments in measured:
        chance = 1 - math.exp(-scale * max(n, 1) * math.exp(-decay * max(segments, default=0.0)))
        mass = sum(s for s in segments if scale * max(n, 1) * math.exp(-decay * s) < toxicity.SIGNIFICANT)
        x.append((1.0, min(-math.log(max(chance, 1e-300)), 60.0), math.log1p(mass)))
        y.append(label)
    x, y = np.array(x), np.array(y, dtype=float)
    w = np.zeros(3)
    for _ in range(20000):  # plain descent on the same objective
        p = 1 / (1 + np.exp(-x @ w))
        curve = (x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(3)
        w -= 0.5 * np.linalg.solve(curve, x.T @ (p - y) + 1e-2 * w)
    return learn({1, 2, 3, 4})[0], decay, scale, w


def test_fit_equals_a_plain_version(spark):
    rows, labels = documents(240, 7)
    rows += [(rows[5][0], rows[5][1]), (rows[9][0], "foul1 foul2 foul1 w3"), (5000, None), (5001, "foul3 foul4 w9"), (None, "w1")]
    labels += [(5000, 0), (5001, 1), (5001, 0), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), buckets=1 << 12)
    word, decay, scale, weights = plain_fit(rows, labels)
    assert {int(k) for k in np.flatnonzero(~np.isnan(got.word))} == set(word)
    assert all(abs(got.word[k] - o) < 1e-5 for k, o in word.items())
    assert abs(got.decay - decay) < 1e-6 and abs(got.scale / scale - 1) < 1e-5
    assert np.abs(np.array(got.weights) - weights).max() < 1e-4
