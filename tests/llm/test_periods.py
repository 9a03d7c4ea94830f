from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from seqharbor.llm import periods


def brute(words, least=24, turns=3):
    """(start, length, period) by comparing every word with the one a period on."""
    n, out = len(words), []
    for q in range(1, n // turns + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            smallest = all(any(words[start + k] != words[start + k + d] for k in range(length - d)) for d in range(1, q))
            if length >= max(least, turns * q) and smallest:
                out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def tailed(key, text):
    """The words of a text after the contract's rewriting rule."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(key).encode())
    n, g = len(words), h // 10
    if key is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def digest(key, text):
    words = tailed(key, text)
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    covered = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join("{},{},{}\n".format(*r) for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in covered)),
    )


def texts(seed, many):
    rng = random.Random(seed)
    out = []
    for _ in range(many):
        words = [f"w{rng.randrange(rng.choice([2, 5, 400]))}" for _ in range(rng.randrange(150))]
        if words and rng.random() < 0.5:
            a, p = rng.randrange(len(words)), rng.randrange(1, 12)
            words[a:] = [words[a + i % p] if a + i % p < len(words) else words[a] for i in range(len(words) - a)]
        out.append("\n \t".join(words))
    return out


@pytest.mark.parametrize(("least", "turns"), [(1, 2), (6, 3), (24, 3), (24, 4)])
def test_runs_match_brute_force(least, turns):
    rng = random.Random(least)
    for _ in range(300):
        letters = [rng.randrange(rng.randrange(1, 4)) for _ in range(rng.randrange(70))]
        assert [tuple(r) for r in periods.runs_of(letters, least, turns).tolist()] == brute(letters, least, turns)
        texts = [[b"%d" % x for x in letters], [b"%d" % x for x in letters[::-1]] * 2]
        found = periods._runs_of_texts(texts, least, turns)
        assert [[tuple(r) for r in f.tolist()] for f in found] == [brute(t, least, turns) for t in texts]


def test_common_extensions_match_brute_force():
    rng = random.Random(9)
    for n in (1, 2, 30, 200):
        letters = [rng.randrange(2) for _ in range(n)]
        tree = periods.SuffixTree(letters)
        order = sorted(range(n + 1), key=lambda i: letters[i:] + [-1])
        assert tree.rank[order].tolist() == list(range(n + 1))
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j][:2000]
        got = tree.common(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])) if pairs else []
        for (i, j), length in zip(pairs, got, strict=True):
            assert letters[i : i + length] == letters[j : j + length]
            assert i + length == n or j + length == n or letters[i + length] != letters[j + length]


def test_query_matches_brute_force(spark):
    rows = list(enumerate(texts(3, 400))) + [(None, "a b " * 30), (500, None), (501, ""), (502, " \n"), (503, "x " * 9000)]
    rows += [(504, "x y z " * 8), (504, "x y z " * 8), (505, "é ñ " * 12 + "\x00"), (506, "a " * 23), (507, "a " * 24)]
    frame = spark.createDataFrame(
        [(*r, "t", "k") for r in rows], "doc_id int, text string, run_text string, tail_h string"
    ).repartition(3)
    scanned = periods.find_runs(periods.with_tails(frame))
    assert scanned.columns == ["doc_id", "text", "tail_h", "run_words", "run_found", "run_best", "run_text"]
    got = sorted([tuple(r) for r in periods.run_digest(scanned).collect()], key=repr)
    assert got == sorted([digest(*r) for r in rows if r[0] != 503] + [tuple(x) for x in got if x[0] == 503], key=repr)
    assert [x[1:6] for x in got if x[0] == 503][0][0] == 1
    assert [x[1:6] for x in got if x[0] == 507] == [(1, 0, 24, 1, 24000)]
    assert sum(x[1] > 0 for x in got) > 40


def test_empty_table_and_turns(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    assert periods.run_digest(periods.find_runs(periods.with_tails(none))).count() == 0
    with pytest.raises(ValueError, match="twice"):
        periods.find_runs(none, turns=1)
