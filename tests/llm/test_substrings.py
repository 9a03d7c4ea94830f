from __future__ import annotations

import hashlib
import random

import pytest

from seqharbor.llm import substrings


def brute(rows, window):
    first, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            if first.setdefault(tuple(words[i : i + window]), (doc, i)) != (doc, i):
                gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, docs=60):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(5, 60))] for _ in range(6)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randint(0, 400)}" for _ in range(rng.randint(1, 30))]
        rows.append((i * 2 - 10, " ".join(words)))
    rows += [(900, "same " * 300), (901, "same " * 45), (902, None), (903, " \n"), (904, "É é\tx " * 30), (905, "a b " * 400)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window,hot_runs", [(20, 20_000), (20, 3), (7, 20_000), (4, 2)])
def test_removed_words_match_brute_force(spark, window, hot_runs):
    rows = corpus(window + hot_runs)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, block string").repartition(3)
    got = substrings.removed_words(frame, window, hot_runs=hot_runs).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute(rows, window) and len(got) == len(rows)


def test_long_text_null_ids_and_repeated_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"l{i}" for i in range(60000))
    rows = [(None, passage), (5, passage), (5, passage), (7, long), (8, long + " end")]
    got = substrings.removed_words(spark.createDataFrame(rows, "doc_id int, text string"), keep_text=True)
    found = sorted([(r.doc_id is not None, r.doc_id or 0, r.n_removed, len(r.kept_text.split())) for r in got.collect()])
    # a null id comes first, of rows that repeat an id one is earlier, and here all have an earlier one
    assert found == [(False, 0, 0, 60), (True, 5, 60, 0), (True, 5, 60, 0), (True, 7, 0, 60000), (True, 8, 60000, 1)]


def test_empty_table_and_bad_window(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert substrings.removed_words(none).count() == 0
    with pytest.raises(ValueError):
        substrings.removed_words(none, 40)
