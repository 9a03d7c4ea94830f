"""Periodic runs of words: longest common extensions from suffix trees, candidates from Lyndon roots.

A run is a stretch of words with a period that repeats three times or more and that no neighbouring word
extends. Every run has, for the order of the words or for its reverse, a root that is the longest Lyndon
word at its start: the suffix order alone names 2n candidates, and two longest common extensions, to
the right and to the left, decide each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded, slices_by_bytes

LEAST_WORDS = 24
LEAST_TURNS = 3
GRAM = 8  # words; see ``repeated_stretches``
SLICE_BYTES = 2 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of small integers, closed by a letter below all others.

    ``rank[i]`` orders the suffixes, ``common(i, j)`` is the length of the longest common prefix of two of them:
    the smallest depth on the Euler tour between their leaves, by a sparse table in constant time.
    Memory is linear in the sequence (some 500 bytes a word while the tree is built).
    """

    def __init__(self, letters: list[int]):
        self.size = len(letters)
        starts, ends, kids = self._build([*letters, -1])
        self._tour(starts, ends, kids)

    @staticmethod
    def _build(text: list[int]) -> tuple[list[int], list[int], list[dict | None]]:
        """Edges into the nodes as (start, end) of the text, and the children of inner nodes by first letter."""
        n = len(text)
        starts, ends, kids, link = [0], [0], [{}], [0]
        node, edge, length, open_suffixes = 0, 0, 0, 0
        for i, letter in enumerate(text):
            open_suffixes += 1
            waiting = 0  # an inner node without its suffix link
            while open_suffixes:
                if not length:
                    edge = i
                below = kids[node]
                child = below.get(text[edge])
                if child is None:
                    below[text[edge]] = len(starts)
                    starts.append(i)
                    ends.append(n)
                    kids.append(None)
                    link.append(0)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    start = starts[child]
                    span = min(ends[child], i + 1) - start
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if text[start + length] == letter:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    inner = len(starts)
                    starts.append(start)
                    ends.append(start + length)
                    kids.append({text[start + length]: child, letter: inner + 1})
                    link.append(0)
                    starts[child] = start + length
                    below[text[edge]] = inner
                    starts.append(i)
                    ends.append(n)
                    kids.append(None)
                    link.append(0)
                    if waiting:
                        link[waiting] = inner
                    waiting = inner
                open_suffixes -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - open_suffixes + 1
        return starts, ends, kids

    def _tour(self, starts: list[int], ends: list[int], kids: list[dict | None]) -> None:
        """Leaves in the order of their suffixes; between two of them the depth of the node they part at."""
        order, depths = [], []
        total = self.size + 1
        stack = [(0, 0, -1)]
        while stack:
            node, depth, parent = stack.pop()
            if parent >= 0:
                depths.append(parent)
            below = kids[node]
            if below is None:
                order.append(total - depth)
                continue
            # the first child follows its parent at once, the others after a return to this depth
            first, *rest = sorted(below)
            for letter in reversed(rest):
                child = below[letter]
                stack.append((child, depth + ends[child] - starts[child], depth))
            child = below[first]
            stack.append((child, depth + ends[child] - starts[child], -1))
        self.rank = np.empty(total, dtype=np.int64)
        self.rank[order] = np.arange(total)
        row = np.array(depths, dtype=np.int32)
        self.table = [row]
        step = 1
        while row.size > step:
            row = np.minimum(row[:-step], row[step:])
            self.table.append(row)
            step *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefixes of the suffixes at ``i`` and ``j``, pairwise different."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1] - 1
        out = np.empty(low.size, dtype=np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """For every place the next one with a smaller value, or the length."""
    out, stack = [len(rank)] * len(rank), []
    for i, value in enumerate(rank):
        while stack and rank[stack[-1]] > value:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(letters: list[int], least: int = LEAST_WORDS, turns: int = LEAST_TURNS) -> np.ndarray:
    """(start, length, period) of every run with ``length >= max(least, turns * period)``, by start, then period.

    The period is the smallest one, ``turns`` is 2 at least. Columns are int64.
    """
    n = len(letters)
    if n < max(least, turns):
        return np.zeros((0, 3), dtype=np.int64)
    tree = SuffixTree(letters)
    back = SuffixTree(letters[::-1])
    rank = tree.rank.tolist()
    # the longest Lyndon word at i ends where the next smaller suffix starts; for the reversed order, the next greater
    up, down = _next_smaller(rank), _next_smaller([-r for r in rank])
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([np.array(up[:n]), np.array(down[:n])])
    inside = j < n
    i, j = i[inside], j[inside]
    period = j - i
    right = tree.common(i, j)
    left = np.zeros(i.size, dtype=np.int64)
    some = i > 0
    left[some] = back.common(n - i[some], n - j[some])
    start, length = i - left, left + right + period
    good = (length >= least) & (length >= turns * period)
    return np.unique(np.stack([start[good], period[good], length[good]], axis=1), axis=0)[:, [0, 2, 1]]


def repeated_stretches(letters: np.ndarray, group: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of one group that no run leaves; most texts have none.

    Of a run's ``GRAM``-word windows each occurs twice in its text: with three turns and 24 words there are
    always more windows than two periods. So a run lies in a maximal stretch of windows that are not unique in
    their text. Windows are compared by a hash; a collision only makes a stretch longer.
    """
    n = letters.size
    windows = n - GRAM + 1
    if windows < 1:
        return []
    with np.errstate(over="ignore"):
        mixed = (letters.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        key = (group[:windows].astype(np.uint64) + np.uint64(7)) * np.uint64(0xBF58476D1CE4E5B9)
        for k in range(GRAM):
            key = key * np.uint64(0x100000001B3) + mixed[k : k + windows]
    whole = group[:windows] == group[GRAM - 1 :]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    often = np.zeros(windows, dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    often &= whole
    edges = np.flatnonzero(np.diff(np.concatenate([[0], often.view(np.int8), [0]])))
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a + GRAM - 1 >= least:
            out.append((a, b + GRAM - 1))
    return out


def _filter_holds(least: int, turns: int) -> bool:
    """Whether every run has a second occurrence of each of its windows, for any period."""
    return turns >= 3 and least >= 3 * GRAM


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def _runs_of_texts(texts: list[list[bytes]], least: int, turns: int) -> list[np.ndarray]:
    """The runs of each text of a slice, in one pass over all their words."""
    codes = _Codes()
    sizes = [len(t) for t in texts]
    letters = np.fromiter((codes[w] for t in texts for w in t), dtype=np.int64, count=sum(sizes))
    group = np.repeat(np.arange(len(texts)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    if _filter_holds(least, turns):
        stretches = repeated_stretches(letters, group, least)
    else:
        stretches = [(int(a), int(b)) for a, b in zip(first, first[1:], strict=False) if b > a]
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for a, b in stretches:
        runs = runs_of(letters[a:b].tolist(), least, turns)
        if len(runs):
            g = int(group[a])
            found[g].append(runs + np.array([a - int(first[g]), 0, 0]))
    none = np.zeros((0, 3), dtype=np.int64)
    return [np.concatenate(f) if f else none for f in found]


def best_run(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest length over period, the first of equals, the shortest period of those."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that stand in a run after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    covered = np.cumsum(change[:-1]) > 0
    return [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def find_runs(
    docs: DataFrame, text: str = "text", least: int = LEAST_WORDS, turns: int = LEAST_TURNS, names: str = "run_"
) -> DataFrame:
    """``docs`` with ``words`` (long), ``found`` (all runs by start, then period), ``best`` and ``text`` without repeats.

    Words are maximal stretches without the six ASCII blanks. The new columns stand behind ``names`` and
    replace columns of ``docs`` that start so. ``{names}text`` has the words that stay, joined by one blank.
    A null text has no words, no runs and an empty ``{names}text``; ``best`` is null without a run. Rows are judged one by
    one, so repeated rows and null or repeated ids change nothing, and nothing is shuffled.
    """
    if turns < 2:
        raise ValueError("a run repeats twice at least")
    bounded(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith(names)])
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([*kept.schema.fields])
    schema = schema.add(f"{names}words", T.LongType()).add(f"{names}found", T.ArrayType(run)).add(f"{names}best", run)
    schema = schema.add(f"{names}text", T.StringType())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.field(c, pa.int64()) for c in ("start", "length", "period")]
        for part, texts in slices_by_bytes(batches, text, SLICE_BYTES):
            words = [t.split() for t in texts]
            runs = _runs_of_texts(words, least, turns)
            every = np.concatenate(runs)
            at = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32())
            listed = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], fields=fields)
            best = [best_run(r) for r in runs]
            best = pa.array([b and dict(zip(("start", "length", "period"), b, strict=True)) for b in best], pa.struct(fields))
            stays = [b" ".join(collapse(w, r)) for w, r in zip(words, runs, strict=True)]
            columns = [
                *part.columns,
                pa.array([len(w) for w in words], pa.int64()),
                pa.ListArray.from_arrays(at, listed),
                best,
                pa.array(stays, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(scan, schema)


def run_digest(docs: DataFrame, names: str = "run_") -> DataFrame:
    """One row per document: number of runs, the best one, digests of all runs and of the words that stay."""
    found, best = F.col(f"{names}found"), F.col(f"{names}best")
    line = F.transform(found, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return docs.select(
        "doc_id",
        F.size(found).cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr(f"1000 * {names}best.length div {names}best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2(F.col(f"{names}text"), 256).alias("collapsed_sha256"),
    )


def with_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` in which the texts of a tenth of the ids, by crc32, end in a repeated stretch of their own words."""
    spare = "tail_h"
    while spare in docs.columns:
        spare = "_" + spare
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    many = F.size(words)
    a = F.pmod(g, many)
    p = F.floor((many - a) / (F.lit(3) + g % 8)) + 1
    plan = F.struct(words.alias("w"), a.cast("int").alias("a"), p.cast("int").alias("p"))
    out = docs.withColumn(spare, F.when((h % 10 == 0) & (many > 0), plan))
    x = F.col(spare)
    changed = F.transform(
        x["w"],
        lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["w"], x["a"] + (i - x["a"]) % x["p"])),
    )
    return out.withColumn(text, F.when(x.isNotNull(), F.array_join(changed, " ")).otherwise(F.col(text))).drop(spare)
