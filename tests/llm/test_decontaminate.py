from __future__ import annotations

import hashlib
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from seqharbor.llm import decontaminate
from seqharbor.llm.fmindex import FMIndex, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    words, hit, found = lowered(text), set(), set()
    for item, body in items:
        parts = lowered(body)
        size = min(window, len(parts))
        for i in range(len(parts) - size + 1 if size else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == parts[i : i + size]:
                    hit |= set(range(j, j + size))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=5))
def test_index_finds_every_occurrence(text, patterns):
    symbols = np.array(text, dtype=np.int64)
    order = suffix_order(np.r_[symbols, 0], 5)
    closed = [*text, 0]
    assert order.tolist() == sorted(range(len(closed)), key=lambda i: closed[i:])
    index = FMIndex(symbols, 5, sample=4)
    for pattern in patterns:
        which, low, high = index.search(np.array([pattern]))
        got = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(which) else []
        size = len(pattern)
        assert got == [i for i in range(len(text) - size + 1) if text[i : i + size] == pattern]


def test_contamination_matches_brute_force(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(7, item), (10, "short item"), (9, "Short, ITEM"), (3, None), (4, ""), (5, "..."), (None, "null named words"), (2, "ünï 1")]
    texts = [
        "x " + item.upper() + " y", item[:40], "short-item short item; null named words", None, "", "...", "ünï 1 ÜNÏ 1",
        " ".join(["alpha beta gamma delta epsilon zeta eta theta iota kappa"] * 3), "short " * 5 + "item",
        " ".join(f"w{i}" for i in range(30000)) + " " + item,
    ]
    docs = [(i, t, "clash", [1]) for i, t in enumerate(texts)] + [(0, texts[0], "", None), (None, item, "", None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, bm_words string, bm_starts array<int>")
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("item_id", "text", "1 as doc_id")
    got = decontaminate.contamination(frame, bench).collect()
    want = {i: brute(t, items) for i, t in enumerate(texts)} | {None: brute(item, items)}
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id]


def test_parts_of_the_benchmark_add_up(spark):
    items = [(i, f"item number {i} has words") for i in range(5)] + [(9, "has words item")]
    docs = spark.createDataFrame([(1, "item number 2 has words item number 4 has words x")], "doc_id int, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    whole = decontaminate.mark_passages(docs, bench).first()
    parts = decontaminate.mark_passages(docs, bench, part_bytes=10).first()
    assert whole == parts and whole.bm_items == ["2", "4", "9"] and (whole.bm_starts, whole.bm_ends) == ([0], [10])


def test_passages_are_cut_and_clean_texts_stay(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"Keep, {item.title()}! and é {item}", "k"), (2, "nothing here", "k"), (3, None, "k"), (4, "", None), (5, item, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bm_items string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.remove_passages(docs, bench)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "Keep, ! and é ", 2: "nothing here", 3: None, 4: "", 5: ""}
    assert [r.bm_items for r in got.orderBy("doc_id").collect()] == ["k", "k", "k", None, ""]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, items).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert tuple(decontaminate.contamination(one, items).first())[1:4] == (2, 0, 0)
