"""Protein search: seeds on one diagonal, then banded local alignment of the pairs that have them.

``search_alignments`` is the search of a run: it gives rows with the columns of alignment hits, whose
spans, identity, score and expectation come from an alignment of each candidate pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..constants import RESIDUE_FREQUENCIES
from ..functions.spread import broadcast_if_small
from ..session import materialize
from .seeds import seed_table, shared_diagonals

BROADCAST_SEEDS = 1_000_000  # target seeds of some 40 bytes
SLICE_CELLS = 1 << 20  # residues and cells of the padded pairs aligned at once
NEVER = -(1 << 28)

ALIGNED = (
    "query string, target string, score bigint, qlen bigint, tlen bigint, qstart bigint, qend bigint, "
    "tstart bigint, tend bigint, alnlen bigint, identical bigint"
)


@dataclass(frozen=True)
class Scoring:
    """What two residues score, and what gaps cost.

    Equal residues score ``same``, or ``rare`` if they are one of ``rare_residues``; residues of one of the
    ``groups`` score ``alike``, all others, and letters that are no residues, score ``other``. The first
    residue of a gap costs ``gap_open``, each further one ``gap_extend``.
    """

    same: int = 5
    rare: int = 9
    alike: int = 1
    other: int = -2
    gap_open: int = 11
    gap_extend: int = 1
    rare_residues: str = "CHW"
    groups: tuple[str, ...] = ("ILMV", "FWY", "HKR", "DENQ", "AGPST")

    def matrix(self) -> np.ndarray:
        """Scores by letter code: the residues in the order of their frequencies, then any other letter."""
        letters = "".join(RESIDUE_FREQUENCIES)
        size = len(letters)
        out = np.full((size + 1, size + 1), self.other, dtype=np.int32)
        for i, a in enumerate(letters):
            for j, b in enumerate(letters):
                if a == b:
                    out[i, j] = self.rare if a in self.rare_residues else self.same
                elif any(a in g and b in g for g in self.groups):
                    out[i, j] = self.alike
        return out

    def statistics(self) -> tuple[float, float]:
        """(lambda, K) of local scores without gaps, by the theory of Karlin and Altschul."""
        return _statistics(self)


@cache
def _statistics(scoring: Scoring) -> tuple[float, float]:
    matrix, p = scoring.matrix()[:-1, :-1], np.array(list(RESIDUE_FREQUENCIES.values()))
    p = p / p.sum()
    low, high = int(matrix.min()), int(matrix.max())
    step = np.bincount((matrix - low).ravel(), np.outer(p, p).ravel())  # chance of each score from ``low`` on
    scores = np.arange(low, high + 1)
    if step @ scores >= 0 or high <= 0:
        raise ValueError("the mean score must be negative and some score positive")
    below, above = 1e-9, 1.0
    while step @ np.exp(above * scores) < 1:
        above *= 2
    for _ in range(200):
        middle = (below + above) / 2
        below, above = (middle, above) if step @ np.exp(middle * scores) < 1 else (below, middle)
    lam = (below + above) / 2
    entropy = lam * float(step @ (scores * np.exp(lam * scores)))
    unit = int(np.gcd.reduce(scores[step > 0]))
    # sums of k steps: their part at 0 and above, and the exponentially weighted part below
    sums, total = np.ones(1), 0.0
    for k in range(1, 400):
        sums = np.convolve(sums, step)
        at = np.arange(k * low, k * low + sums.size)
        part = float(sums[at >= 0].sum() + sums[at < 0] @ np.exp(lam * at[at < 0]))
        total += part / k
        if part / k < 1e-12:
            break
    k_value = lam * unit * np.exp(-2 * total) / ((entropy / lam) * (1 - np.exp(-lam * unit)))
    return lam, float(k_value)


def _seeds(df: DataFrame, name: str, k: int, at: str) -> DataFrame:
    """(name, at, kmer) of every place; k-mers are cut from bytes, no row holds those of a sequence."""
    data = df.select(F.col(name), F.col("seq").cast("binary").alias("_s"))
    last = F.octet_length("_s") - F.lit(k)
    placed = data.select(name, "_s", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias(at))
    return placed.select(name, at, F.expr(f"substring(_s, {at} + 1, {k})").alias("kmer"))


def seed_diagonals(queries: DataFrame, targets: DataFrame, k: int = 4, min_seeds: int = 2) -> DataFrame:
    """(query, target, diagonal, seeds): the diagonal with the most common k-mers of each pair.

    ``queries(query, seq)``, ``targets(target, seq)``, both with one row for a name. A diagonal is place in the query less
    place in the target; of equal ones the smallest is taken. Pairs with under ``min_seeds`` on every diagonal are left out.
    Up to ``BROADCAST_SEEDS`` k-mers of targets travel to the tasks as one table, and matches are counted where the query
    lies: no shuffle. Beyond it both sides meet by k-mer.
    """
    table = seed_table(targets, "target", k, BROADCAST_SEEDS)
    if table is not None:
        return shared_diagonals(queries, table, min_seeds).drop("qseq")
    return _joined_diagonals(queries, targets, k, min_seeds)


def _joined_diagonals(queries: DataFrame, targets: DataFrame, k: int, min_seeds: int) -> DataFrame:
    """``seed_diagonals`` for any number of targets: one row for each k-mer match."""
    known = materialize(_seeds(targets, "target", k, "_t"), "target-seeds")
    matches = _seeds(queries, "query", k, "_q").join(known, "kmer")
    counted = (
        matches.groupBy("query", "target", (F.col("_q") - F.col("_t")).alias("diagonal"))
        .agg(F.count(F.lit(1)).alias("seeds"))
        .where(F.col("seeds") >= min_seeds)
    )
    best = F.max(F.struct("seeds", (-F.col("diagonal")).alias("_d"))).alias("_best")
    return counted.groupBy("query", "target").agg(best).select(
        "query", "target", (-F.col("_best._d")).alias("diagonal"), F.col("_best.seeds").alias("seeds")
    )


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Padded letter codes of each sequence, and the lengths."""
    code = np.full(256, len(RESIDUE_FREQUENCIES), dtype=np.int16)
    for i, letter in enumerate(RESIDUE_FREQUENCIES):
        code[ord(letter)] = i
    texts = [s or "" for s in column.to_pylist()]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.full((len(texts), max(1, int(lengths.max(initial=0)))), len(RESIDUE_FREQUENCIES), dtype=np.int16)
    out[np.arange(out.shape[1]) < lengths[:, None]] = code[np.frombuffer("".join(texts).encode("ascii", "replace"), dtype=np.uint8)]
    return out, lengths


def band_rows(qlen: np.ndarray, tlen: np.ndarray, diagonal: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """First place in each target that the band meets in the query, and the number of places from there."""
    first = np.maximum(0, -diagonal - band)
    return first, np.maximum(0, np.minimum(tlen, qlen - diagonal + band) - first)


def align_band(
    query: np.ndarray, qlen: np.ndarray, target: np.ndarray, tlen: np.ndarray, diagonal: np.ndarray,
    scoring: Scoring, band: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each pair within ``band`` of its diagonal, all pairs at once.

    Gives the scores, and rows (first place in the query, in the target, columns, equal residues, last place in the
    query, in the target). Of equal alignments the one that ends first in the query, then in the target; going
    back from its end, a match before a gap in the target before a gap in the query, and the shortest.

    Scores go forward by places of the target, all cells of the band and all pairs at once; what they were made of is
    found going back from the best cells. A gap within a row is the largest score before it less its costs, which is one
    running maximum over the band.
    """
    pairs, cells, none = len(qlen), 2 * band + 1, len(RESIDUE_FREQUENCIES)
    outside, size = none + 1, none + 2
    every, diagonal = np.arange(pairs), diagonal.astype(np.int64)
    qlen, tlen = qlen.astype(np.int64), tlen.astype(np.int64)
    matrix = np.full((size, size), NEVER, dtype=np.int32)
    matrix[:outside, :outside] = scoring.matrix()
    matrix = matrix.ravel()
    first, rows = band_rows(qlen, tlen, diagonal, band)
    many = int(rows.max(initial=0))
    # the query's letters by their place in the band's first row and on, and the target's, by row
    i = np.arange(many + cells - 1)[:, None] + (diagonal + first - band)
    wide = np.where((i >= 0) & (i < qlen), query[every, np.clip(i, 0, query.shape[1] - 1)], outside).astype(np.int64) * size
    j = np.arange(many)[:, None] + first
    letters = np.where(j < tlen, target[every, np.minimum(j, target.shape[1] - 1)], outside).astype(np.int64)
    best = np.zeros((many + 1, cells, pairs), dtype=np.int32)  # best[r + 1]: alignments that end in row r
    over = np.full((many if band else 0, cells, pairs), NEVER, dtype=np.int32)  # those that end in a gap within the row
    along = np.full((cells, pairs), NEVER, dtype=np.int32)
    step = min(scoring.gap_open, scoring.gap_extend)
    ahead = (np.arange(cells, dtype=np.int32) * step)[:, None]
    behind = ahead[:-1] + np.int32(scoring.gap_open)
    top, end_row, end_cell = np.zeros(pairs, dtype=np.int32), np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    for r in range(many):
        before, now = best[r], best[r + 1]
        np.add(before, matrix[wide[r : r + cells] + letters[r]], out=now)
        if band:
            along[:-1] = np.maximum(before[1:] - scoring.gap_open, along[1:] - scoring.gap_extend)
            np.maximum(now, along, out=now)
            np.subtract(np.maximum.accumulate(now + ahead, axis=0)[:-1], behind, out=over[r, 1:])
            np.maximum(now, over[r], out=now)
        np.maximum(now, 0, out=now)
        most = now.max(axis=0)
        met = np.flatnonzero((most > 0) & (most >= top))
        cell = now[:, met].argmax(axis=0)
        # of equal scores the first in the query: rows only grow, so a later row must end at a smaller place
        new = (most[met] > top[met]) | (r + cell < end_row[met] + end_cell[met])
        met = met[new]
        top[met], end_row[met], end_cell[met] = most[met], r, cell[new]

    found = np.zeros((pairs, 6), dtype=np.int64)
    p = np.flatnonzero(top > 0)
    r, c, kind = end_row[p], end_cell[p], np.zeros(len(p), dtype=np.int8)  # kind: any, a gap within the row, a gap along the target
    score, columns, equal = top[p].astype(np.int64), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    found[p, 4], found[p, 5] = first[p] + r + diagonal[p] + c - band, first[p] + r
    while len(p):
        if band:
            code = wide[r + c, p] + letters[r, p]
            match = (kind == 0) & (best[r, c, p] + matrix[code] == score)
            kind = np.where((kind == 0) & ~match, np.where(over[r, c, p] == score, 1, 2), kind)
        else:
            code, match = wide[r + c, p] + letters[r, p], np.ones(len(p), dtype=bool)
        columns += 1
        equal += match & (code // size == code % size) & (code % size != none)
        done = match & (best[r, c, p] <= 0)
        if done.any():
            at, row = p[done], first[p[done]] + r[done]
            found[at, 0], found[at, 1] = row + diagonal[at] + c[done] - band, row
            found[at, 2], found[at, 3] = columns[done], equal[done]
        # a match goes to the row before, a gap to the cell it was opened from or made longer
        within = kind == 1
        r_next, c_next = r - ~within, c - within + (kind == 2)
        ends = best[r_next + 1, np.minimum(c_next, cells - 1), p]
        opened = ends - scoring.gap_open == score
        score = np.where(match | opened, ends, score + scoring.gap_extend)
        kind = np.where(match | opened, 0, kind)
        left = ~done
        p, r, c, kind = p[left], r_next[left], c_next[left], kind[left]
        score, columns, equal = score[left], columns[left], equal[left]
    return top, found


def align_pairs(pairs: DataFrame, scoring: Scoring | None = None, band: int = 8) -> DataFrame:
    """Rows (query, target, diagonal, qseq, tseq) to the best local alignment of each, none for a pair without one.

    Places count from 1, ends included; ``identical`` counts columns of equal residues. A task aligns slices of
    pairs of like size, at most ``SLICE_CELLS`` padded residues and cells of the band at once, or one pair.
    """
    used = scoring or Scoring()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in ALIGNED.split(", ")]
        for batch in batches:
            qsize, tsize = (pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
            rows = band_rows(qsize, tsize, batch.column(2).to_numpy(), band)[1]
            sizes = qsize + tsize + (rows + 1) * (2 * band + 1)
            order, start = np.argsort(sizes, kind="stable"), 0
            while start < len(order):
                stop = start + 1
                while stop < len(order) and (stop + 1 - start) * sizes[order[stop]] <= SLICE_CELLS:
                    stop += 1
                part = batch.take(pa.array(order[start:stop]))
                query, qlen = _codes(part.column(3))
                target, tlen = _codes(part.column(4))
                score, at = align_band(query, qlen, target, tlen, part.column(2).to_numpy(), used, band)
                good = np.flatnonzero(score > 0)
                at, keep = at[good].astype(np.int64), pa.array(good)
                numbers = [score[good], qlen[good], tlen[good], at[:, 0] + 1, at[:, 4] + 1, at[:, 1] + 1, at[:, 5] + 1, at[:, 2], at[:, 3]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(keep), part.column(1).take(keep), *[pa.array(x.astype(np.int64)) for x in numbers]],
                    names=names,
                )
                start = stop

    return pairs.select("query", "target", F.col("diagonal").cast("bigint"), "qseq", "tseq").mapInArrow(run, ALIGNED)


def search_alignments(
    queries: DataFrame, targets: DataFrame, k: int = 4, min_seeds: int = 2, band: int = 8, scoring: Scoring | None = None
) -> DataFrame:
    """Alignment hits of ``queries(query, seq)`` on ``targets(target, seq)``, both with one row for a name.

    Pairs with ``min_seeds`` common k-mers on one diagonal are aligned within ``band`` of it (0: without gaps).
    With the score S, m residues of the query and n of all targets, bits are ``(lambda S - ln K) / ln 2`` and the expectation is
    ``m n 2^-bits``; the constants are those of ungapped scores, which for alignments with gaps makes the expectation too small
    by a moderate factor. ``pident`` is the share of equal residues among the alignment's columns.
    """
    used = scoring or Scoring()
    lam, k_value = used.statistics()
    listed = broadcast_if_small(targets.select("target", F.col("seq").alias("tseq")), BROADCAST_SEEDS // 200)
    table = seed_table(targets, "target", k, BROADCAST_SEEDS)
    if table is not None:
        sides = shared_diagonals(queries, table, min_seeds)
    else:
        pairs = materialize(_joined_diagonals(queries, targets, k, min_seeds), "seed-pairs")
        sides = pairs.join(queries.select("query", F.col("seq").alias("qseq")), "query")
    aligned = materialize(align_pairs(sides.join(listed, "target"), used, band), "alignments")
    residues = targets.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("double").alias("_all"))
    bits = (F.lit(lam) * F.col("score") - F.lit(float(np.log(k_value)))) / F.lit(float(np.log(2.0)))
    found = aligned.withColumn("bits", bits).withColumn("_all", residues.scalar())
    return found.select(
        "query", "target",
        (F.col("qlen") * F.col("_all") * F.pow(F.lit(2.0), -F.col("bits"))).alias("evalue"),
        "bits", "qlen", "tlen", "qstart", "qend", "tstart", "tend", "alnlen",
        (F.col("identical") / F.col("alnlen")).alias("pident"), "score",
    )
