from __future__ import annotations

import math

import numpy as np
import pytest

from seqharbor.llm import embeddings


def brute(rows, least=0.9):
    usable = {
        i: np.array(v, dtype=np.float64)
        for i, (_, v) in enumerate(rows)
        if v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)
    }
    usable = {i: v / math.sqrt(v @ v) for i, v in usable.items() if rows[i][0] is not None}
    links = {i: [j for j in usable if j != i and len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= least] for i in usable}
    out = []
    for i, (key, _) in enumerate(rows):
        seen, open_ = {i}, [i]
        while open_:
            for j in links.get(open_.pop(), []):
                if j not in seen:
                    seen.add(j)
                    open_.append(j)
        component = min((rows[j][0] for j in seen), key=lambda k: (k is None, k))
        out.append((key, len(links.get(i, [])), component, key == component))
    return out


def test_links_components_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(260):
        x = base[i % 12] * (1 if i % 3 else 2.5) + rng.normal(size=8) * [0.02, 0.2, 0.5][i % 3]
        rows.append((i * 2, [float(np.float32(v)) for v in x]))
    rows += [(600 + i, rows[5][1]) for i in range(40)]  # copies
    rows += [(700, [2 * v for v in rows[5][1]])]  # the same direction
    rows += [(800, None), (801, []), (802, [0.0] * 8), (803, [float("nan")] * 8), (804, [float("inf"), *[1.0] * 7]), (805, [None, *[1.0] * 7]), (806, [1.0, 2.0])]
    rows += [(None, rows[5][1]), (10, rows[5][1]), (10, rows[6][1]), (10, None), (10, [3.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, node int, unit int")
    got = embeddings.near_vectors(frame)
    assert got.columns[:4] == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted(brute(rows), key=repr)


def test_every_length_is_compared(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.9, 0.1]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0])]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == {
        1: (0, 1), 2: (1, 2), 3: (1, 2), 7: (1, 7), 8: (1, 7), 9: (0, 9),
    }


def test_rows_that_repeat_a_key_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.99, 0.1, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [0.0, 0.05, 1.0]), (3, [0.0, 1.0, 0.0])]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 1, 1, True), (1, 1, 1, True), (2, 1, 2, True), (3, 0, 3, True), (3, 1, 2, False),
    ]
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows))


@pytest.mark.parametrize("list_rows", [128, 12])
def test_recall_near_the_threshold(spark, monkeypatch, list_rows):
    # with 12 rows a list there are 333 lists, of which the 16 visited are under a twentieth
    monkeypatch.setattr(embeddings, "LIST_ROWS", list_rows)
    rng = np.random.default_rng(3)
    first = rng.normal(size=(2000, 64))
    first /= np.linalg.norm(first, axis=1)[:, None]
    other = rng.normal(size=(2000, 64))
    other -= (other * first).sum(1)[:, None] * first
    other /= np.linalg.norm(other, axis=1)[:, None]
    cosine = rng.uniform(0.9, 0.97, 2000)[:, None]
    both = np.concatenate([first, cosine * first + np.sqrt(1 - cosine**2) * other])
    rows = [(i, v.tolist()) for i, v in enumerate(both)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), sample_rows=1500)
    found = {r.vec_id: r.n_links for r in got.collect()}
    close = both @ both.T
    np.fill_diagonal(close, 0)
    want = (close >= 0.9 - 1e-12).sum(1)
    assert all(found[i] <= want[i] for i in range(len(want)))
    recall = sum(found.values()) / want.sum()
    print(f"recall with {len(both) // list_rows} lists: {recall:.4f}")
    assert recall >= 0.9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.0, 0.0])]])
def test_nothing_to_compare(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in embeddings.near_vectors(frame).collect()] == [(i, 0, i, True) for i, _ in rows]


def test_large_lists_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    rows = [(i, (np.ones(4) + rng.normal(size=4) * 0.3).tolist()) for i in range(150)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert sorted([tuple(r) for r in got.collect()]) == sorted(brute(rows))
