from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from seqharbor.llm import near_copies

SCHEMA = "doc_id bigint, text string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_components(texts):
    roots = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((roots[i], roots[j]))
                roots = [low if r == high else r for r in roots]
    return roots


def pair(rng, low, high):
    """A text and a copy with the end exchanged, of a similarity between the two."""
    n = rng.randint(80, 250)
    words = [f"w{rng.randrange(50000)}" for _ in range(n + 4)]
    want = rng.uniform(low, high)
    cut = round((n + 4) - (n - 2 * n * want / (1 + want)) / 2 * 2)
    other = words[:cut] + [f"x{rng.randrange(50000)}" for _ in range(n + 4 - cut)]
    return " ".join(words), " ".join(other)


def test_recall_between_08_and_095(spark):
    rng, rows, bins = random.Random(5), [], {}
    for i in range(1200):
        a, b = pair(rng, 0.78, 0.95)
        rows += [(2 * i, a), (2 * i + 1, b)]
        bins.setdefault(int(likeness(a, b) * 20 + 1e-9), []).append(i)
    got = {r.doc_id: r.component.id for r in near_copies.near_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    found = {k: np.mean([got[2 * i + 1] == 2 * i for i in v]) for k, v in bins.items()}
    assert len(bins[16]) > 100 and found[15] == 0
    assert found[16] >= 0.97 and found[17] >= 0.99 and found[18] >= 0.995, found
    assert all(got[2 * i] == 2 * i for i in range(1200))


def grouped(rng, n, shared, own, start=0):
    """Texts with one block of words in common and words of their own."""
    block = " ".join(f"t{rng.randrange(10**6)}" for _ in range(shared))
    return [(start + i, block + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(own))) for i in range(n)]


def test_texts_of_one_template_stay(spark):
    rng = random.Random(6)
    rows = grouped(rng, 400, 165, 36) + grouped(rng, 400, 150, 50, 1000)
    assert 0.59 < likeness(rows[-1][1], rows[-2][1]) < 0.61 < 0.69 < likeness(rows[0][1], rows[1][1]) < 0.71
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert left.count() == len(rows)


def test_large_groups_are_compared_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 12)
    rng = random.Random(7)
    rows = grouped(rng, 90, 165, 36)
    for i in range(90):  # some copies of members, of the copies, and a dense group beside them
        if i % 3 == 0:
            rows.append((200 + i, rows[i][1] + " one more"))
            rows.append((300 + i, rows[i][1] + " one more and " + " ".join(f"p{k}" for k in range(20))))
    rows += grouped(rng, 70, 170, 8, 600) + [(700, None), (701, ""), (702, "short text"), (703, "Short  text")]
    rows.sort()
    roots = brute_components([t for _, t in rows])
    want = {i: rows[r][0] for (i, _), r in zip(rows, roots, strict=True)}
    got = {r.doc_id: r.component.id for r in near_copies.near_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_sides_and_thresholds():
    base = np.arange(100, dtype=np.uint64)
    sets = [base[:80], base, base[:79], np.arange(500, 580, dtype=np.uint64), np.array([], dtype=np.uint64)]
    both = np.full(5, 2)
    assert near_copies.similar(sets, both).tolist() == [0, 0, 0, 3, 4]
    assert near_copies.similar([sets[1], sets[2]], both[:2]).tolist() == [0, 1]
    assert near_copies.similar(sets[:3], np.array([0, 1, 0])).tolist() == [0, 0, 2]


def test_rows_are_known_by_id_and_text(spark):
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"w{rng.randrange(50000)}" for _ in range(100)) for _ in range(4))
    rows = [(None, a), (None, a + " more"), (None, b), (5, b + " more"), (6, c), (7, c + " more"), (7, d), (8, d)]
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    kept = sorted([tuple(r) for r in left], key=repr)
    lone = [r for r in kept if r[0] is None]
    assert len(lone) == 1 and lone[0][1] in (a, a + " more")
    assert [r for r in kept if r[0] is not None] == [(5, b + " more"), (6, c), (7, d)]


def test_one_of_equal_rows_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    for rows, ids in (([(None, text)] * 3, [None]), ([(5, text), (5, text), (6, text)], [5]), ([(None, text), (6, text)], [6])):
        left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
        assert [tuple(r) for r in left.collect()] == [(i, text) for i in ids]
    extra = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, text + " z", "b")], SCHEMA + ", row_number string")
    assert [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, extra, "").collect()] == [(1, text, "a")]
