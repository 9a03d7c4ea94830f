"""One chain of genes per chunk: frames are scored by their hexamers, and the best chain of them stays.

The hexamer model is counted on the input itself: hexamers read in frame inside long open frames
against all hexamers of both strands. Scores are whole numbers (thousandths of a log-odds), so a
chain does not depend on the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .genes import MIN_ORF_BASES, Scan, orf_scan, scan_slices
from .sequences import min_length_filter

HEXAMERS = 4096
TRAINING_BASES = 300  # open frames as long as this one teach the model
SAME_STRAND_OVERLAP = 60
OPPOSITE_STRAND_OVERLAP = 30


def hexamer_codes(scan: Scan) -> np.ndarray:
    """Number of the hexamer that each codon begins with the next of its run; 4096 if it has a letter other than ACGT, or no next."""
    number = np.full(125, HEXAMERS, dtype=np.int32)
    for a in range(4):
        for b in range(4):
            number[a * 25 + b * 5 + np.arange(4)] = a * 16 + b * 4 + np.arange(4)
    codons = number[scan.codons]
    codes = np.full(len(codons), HEXAMERS, dtype=np.int32)
    codes[:-1] = np.minimum(codons[:-1] * 64 + codons[1:], HEXAMERS)
    codes[scan.stops[scan.stops > 0] - 1] = HEXAMERS
    return codes


def coding_model(chunks: DataFrame, training_bases: int = TRAINING_BASES) -> DataFrame:
    """``(hexamer, coding, background, weight)``, always 4096 rows.

    ``coding`` counts hexamers read codon by codon in open frames of at least ``training_bases``, ``background``
    those at every position of both strands. ``weight`` is the log-odds of the two shares in
    thousandths, rounded, each count raised by one. Tasks send their sums only. Sequences under 100 letters do not count.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, HEXAMERS + 1), dtype=np.int64)
        for _, scan in scan_slices(batches, training_bases):
            codes = hexamer_codes(scan)
            sums[1] += np.bincount(codes, minlength=HEXAMERS + 1)
            inside = np.zeros(len(codes) + 1, dtype=np.int8)  # frames of a run do not overlap
            inside[scan.first] += 1
            inside[scan.last - 1] -= 1
            sums[0] += np.bincount(codes[np.cumsum(inside[:-1], dtype=np.int8) > 0], minlength=HEXAMERS + 1)
        met = np.flatnonzero(sums[1][:HEXAMERS])
        columns = [pa.array(c) for c in (met, sums[0][met], sums[1][met])]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "coding", "background"])

    sums = (
        min_length_filter(chunks.select("accession", "seq"))
        .mapInArrow(count, "id bigint, coding bigint, background bigint")
        .groupBy("id")
        .agg(F.sum("coding").alias("coding"), F.sum("background").alias("background"))
    )
    letters = [
        F.substring(F.lit("ACGT"), (F.floor(F.col("id") / 4**i) % 4 + 1).cast("int"), F.lit(1)) for i in range(5, -1, -1)
    ]
    every = (
        chunks.sparkSession.range(HEXAMERS)
        .join(sums, "id", "left")
        .select(
            F.concat(*letters).alias("hexamer"),
            F.coalesce("coding", F.lit(0)).cast("bigint").alias("coding"),
            F.coalesce("background", F.lit(0)).cast("bigint").alias("background"),
        )
    )
    whole = Window.partitionBy(F.lit(1))  # 4096 rows

    def share(name: str):
        return (F.col(name) + 1) / (F.sum(name).over(whole) + HEXAMERS)

    weight = F.floor(1000 * F.log(share("coding") / share("background")) + F.lit(0.5))
    return every.withColumn("weight", weight.cast("bigint"))


def coding_weights(model: DataFrame) -> np.ndarray:
    """The model's weights by hexamer number; hexamers with another letter, and those left out, weigh nothing."""
    weights = np.zeros(HEXAMERS + 1, dtype=np.int64)
    for row in model.select("hexamer", "weight").collect():
        code = 0
        for letter in row["hexamer"]:
            code = 4 * code + "ACGT".index(letter)
        weights[code] = row["weight"]
    return weights


def best_chain(
    begin: list[int], end: list[int], strand: list[int], score: list[int],
    same: int = SAME_STRAND_OVERLAP, opposite: int = OPPOSITE_STRAND_OVERLAP,
) -> list[int]:
    """Places of the frames that make the chain of the highest total score.

    Frames come ordered by end, begin and strand. In a chain begins and ends both grow, and neighbours
    share at most ``same`` bases, or ``opposite`` if their strands differ. As ``opposite`` is not
    larger than ``same``, what holds for neighbours holds for all pairs of a chain. Only frames with
    a score above zero are taken. Of equal totals the one whose last frame comes first wins, and so on backwards.

    All frames that end before one begins are met by their best total so far; only those that end
    within the allowed overlap are looked at one by one.
    """
    if opposite > same:
        raise ValueError("the overlap across strands may not be larger than that on one strand")
    ends = np.asarray(end, dtype=np.int64)
    clear = np.searchsorted(ends, np.asarray(begin, dtype=np.int64), "left").tolist()
    n = len(begin)
    total, before, leader = [0] * n, [-1] * n, [-1] * (n + 1)  # leader[i]: best of the first i frames
    for i in range(n):
        leader[i + 1] = leader[i]
        if score[i] <= 0:
            continue
        found = leader[clear[i]]
        for j in range(clear[i], i):
            shared = end[j] - begin[i] + 1
            if shared > same or end[j] == end[i]:
                break
            fits = total[j] > 0 and begin[j] < begin[i] and (strand[j] == strand[i] or shared <= opposite)
            if fits and (found < 0 or total[j] > total[found]):
                found = j
        total[i], before[i] = score[i] + (total[found] if found >= 0 else 0), found
        if leader[i] < 0 or total[i] > total[leader[i]]:
            leader[i + 1] = i
    kept, at = [], leader[n]
    while at >= 0:
        kept.append(at)
        at = before[at]
    return kept[::-1]


def _chooser(weights: np.ndarray, same: int, opposite: int):
    def choose(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
        sums = np.concatenate([[0], np.cumsum(weights[hexamer_codes(scan)])])
        score = sums[scan.last - 1] - sums[scan.first]
        order = np.lexsort((scan.strand, scan.low, scan.high, scan.sequence))
        order = order[score[order] > 0]  # no other frame can be taken
        columns = [c[order].tolist() for c in (scan.low, scan.high, scan.strand, score)]
        cuts = np.flatnonzero(np.diff(scan.sequence[order])) + 1
        kept = []
        for a, b in pairwise([0, *cuts.tolist(), len(order)]):
            kept += [a + i for i in best_chain(*[c[a:b] for c in columns], same, opposite)]
        places = np.sort(order[np.array(kept, dtype=np.int64)])
        return places, score[places]

    return choose


def gene_chain(
    chunks: DataFrame,
    model: DataFrame | None = None,
    min_bases: int = MIN_ORF_BASES,
    same: int = SAME_STRAND_OVERLAP,
    opposite: int = OPPOSITE_STRAND_OVERLAP,
) -> DataFrame:
    """The open frames of ``orf_scan`` that make each chunk's best chain, with ``coding_score``.

    ``model`` is a table like that of ``coding_model``, which is counted on the chunks if none is given. A frame's score is
    the sum of the weights of its hexamers, codon by codon. Frames are chosen where they are found:
    the model's 4096 numbers travel to the tasks, and nothing is shuffled.
    """
    weights = coding_weights(coding_model(chunks) if model is None else model)
    return orf_scan(chunks, min_bases, _chooser(weights, same, opposite))
