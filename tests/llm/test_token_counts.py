from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from seqharbor.llm import token_counts

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [
    "", None, "one line", "two\nlines", "a\n\n\nb", "\n\n\n", "x\n \n  y \n", "é日\n本😀\n\n😀", "tail\n", "  lead\n\t\n\ttab", "w" * 5000 + "\n" + " " * 5000 + "\nz",
    "word and more\n" * 4000,
]


def brute(text, rule):
    """Every token's characters, one by one."""
    if not text:
        return [(0, 0, 0, 0, 0, 0)]
    encoding = token_counts.load_ranks(RANKS, PATTERN)
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    lines = text.split("\n")
    line_of, bounds, at = [], [], 0
    for i, line in enumerate(lines):
        size = len(line) + (i < len(lines) - 1)
        if size:
            bounds.append((at, at + size))
            line_of += [len(bounds) - 1] * size
            at += size
    counts, crossing, byte = [0] * len(bounds), [0] * len(bounds), 0
    ids = encoding.encode_ordinary(text)
    for i in ids:
        size = len(encoding.decode_single_token_bytes(i))
        chars = sorted(set(owner[byte : byte + size]))
        byte += size
        touched = [line_of[c] for c in chars]
        most = max(sorted(set(touched)), key=touched.count) if rule == "most" else touched[0]
        counts[most] += 1
        crossing[most] += len(set(touched)) > 1
    return [(i, a, b, counts[i], crossing[i], len(ids)) for i, (a, b) in enumerate(bounds)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_match_brute_force(spark, rule):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "a\nb", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, section int")
    got: dict = {}
    for r in token_counts.section_tokens(docs, RANKS, PATTERN, rule).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == {i: brute(t, rule) for i, t, _ in rows}


def test_crossing_tokens_go_by_the_rule():
    starts, ends, bounds = np.array([0, 2, 6]), np.array([2, 6, 9]), np.array([0, 3, 5, 8])
    assert token_counts.attribute(starts, ends, bounds, "first")[0].tolist() == [0, 0, 2]
    # 1, 2 and 1 characters; 2 and 1 characters
    assert token_counts.attribute(starts, ends, bounds, "most")[0].tolist() == [0, 1, 2]
    # two and two: the earlier section
    assert token_counts.attribute(np.array([1]), np.array([5]), np.array([0, 3]), "most")[0].tolist() == [0]


def test_empty_table_and_unknown_rule(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts.section_tokens(none, RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(none, RANKS, PATTERN, "last")
