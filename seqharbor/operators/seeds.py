"""Common k-mers of sequences, counted in the task that holds the query.

A ``SeedTable`` holds every k-mer of a bounded set of targets. Queries meet it a slice at a time, and what a
query shares with a target is counted where the query lies, so that no k-mer match leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

SLICE_LETTERS = 1 << 20  # letters of the queries met at once, or one query
MATCHES = 1 << 22  # matches that are listed before they are counted
FILTER = 20  # bits of the filter before the search in the table
SPREADER = np.uint64(0x9E3779B97F4A7C15)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by one more byte, and the lengths; null is empty."""
    texts = pc.fill_null(column.cast(pa.binary()), b"").to_pylist()
    return np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8), np.array([len(t) for t in texts], dtype=np.int64)


@dataclass(frozen=True)
class SeedTable:
    """The k-mers of the targets: ``numbers`` sorted, and the (target, place) of number ``i`` from ``begins[i]`` on.

    A k-mer is numbered letter by letter, in the base of the targets' letters; 0 is any other. Before a
    number would pass 62 bits it becomes its rank in the next of ``ranks``.
    """

    names: pa.Array
    k: int
    letters: np.ndarray
    base: int
    ranks: list[np.ndarray]
    numbers: np.ndarray
    begins: np.ndarray
    target: np.ndarray
    place: np.ndarray
    sizes: np.ndarray  # longest target, by letters
    filter: np.ndarray

    @staticmethod
    def build(names: pa.Array, seqs: pa.Array, k: int) -> SeedTable:
        """Targets of one name are one target."""
        known = names.dictionary_encode()
        data, sizes = joined(seqs)
        ends = np.cumsum(sizes + 1)
        inner = np.ones(len(data), dtype=bool)
        inner[ends - 1] = False
        letters = np.zeros(256, dtype=np.int64)
        met = np.unique(data[inner])
        letters[met] = np.arange(1, len(met) + 1)
        coded = np.where(inner, letters[data], 0)
        base, ranks = len(met) + 1, []
        numbers = _numbers(coded, k, base, ranks, learn=True)
        row = np.repeat(np.arange(len(sizes)), sizes + 1)[: len(numbers)]
        place = np.arange(len(numbers)) - (ends - sizes - 1)[row]
        whole = np.flatnonzero(place + k <= sizes[row])
        order = whole[np.argsort(numbers[whole], kind="stable")]
        found, begins = np.unique(numbers[order], return_index=True)
        filtered = np.zeros(1 << FILTER, dtype=bool)
        filtered[_spread(found)] = True
        return SeedTable(
            known.dictionary, k, letters, base, ranks, found, np.append(begins, len(order)),
            known.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row[order]], place[order], sizes.max(initial=0), filtered,
        )

    def distinct(self) -> SeedTable:
        """Each (k-mer, target) once; places mean nothing then."""
        number = np.repeat(np.arange(len(self.numbers)), np.diff(self.begins))
        both = np.unique(number * max(1, len(self.names)) + self.target)
        number, target = np.divmod(both, max(1, len(self.names)))
        begins = np.searchsorted(number, np.arange(len(self.numbers) + 1))
        return SeedTable(
            self.names, self.k, self.letters, self.base, self.ranks, self.numbers, begins, target, np.zeros(len(target), np.int64), self.sizes,
            self.filter,
        )

    def places(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, number's place in the table) of every k-mer of the joined queries that a target has."""
        ends = np.cumsum(sizes + 1)
        begin, pieces = 0, []
        while not pieces or begin < len(data):  # a long query is met in parts, which share k - 1 letters
            stop = min(len(data), begin + SLICE_LETTERS + self.k - 1)
            coded = self.letters[data[begin:stop]]
            low, high = np.searchsorted(ends, [begin + 1, stop + 1])
            coded[ends[low:high] - 1 - begin] = 0
            numbers = _numbers(coded, self.k, self.base, self.ranks)
            maybe = np.flatnonzero(self.filter[_spread(numbers)])
            at = np.searchsorted(self.numbers, numbers[maybe])
            last = len(self.numbers) - 1
            good = self.numbers[np.minimum(at, last)] == numbers[maybe] if last >= 0 else np.zeros(len(maybe), dtype=bool)
            pieces.append((maybe[good] + begin, at[good]))
            begin += SLICE_LETTERS
        maybe, at = (np.concatenate(part) for part in zip(*pieces, strict=True))
        query = np.searchsorted(ends, maybe, "right")
        return query, maybe - (ends - sizes - 1)[query], at

    def slices(self, batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
        """``places`` of slices of a batch: first row, the three arrays, and the longest query."""
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(lengths, dtype=np.int64) - lengths) // SLICE_LETTERS
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]):
            if a < b:
                data, sizes = joined(batch.column(column).slice(a, b - a))
                yield a, *self.places(data, sizes), int(sizes.max())

    def matches(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in ``at``, place in the table's rows) of all matches, at most ``MATCHES`` or those of one place at once."""
        found = self.begins[at + 1] - self.begins[at]
        part = (np.cumsum(found) - found) // MATCHES
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]):
            here = np.repeat(np.arange(a, b), found[a:b])
            ends = np.cumsum(found[a:b])
            yield here, np.arange(len(here)) + np.repeat(self.begins[at[a:b]] - ends + found[a:b], found[a:b])


def _spread(numbers: np.ndarray) -> np.ndarray:
    return (numbers.astype(np.uint64) * SPREADER) >> np.uint64(64 - FILTER)


def _numbers(coded: np.ndarray, k: int, base: int, ranks: list[np.ndarray], learn: bool = False) -> np.ndarray:
    """Numbers of the k-mers that begin at each letter; one with a letter 0 equals none of the targets'."""
    places = max(0, len(coded) - k + 1)
    out, span, used = coded[:places].copy(), base, 0
    dead = out == 0
    for i in range(1, k):
        if span * base >= 1 << 62:
            if learn:
                ranks.append(np.unique(out[~dead]))
            table = ranks[used]
            at = np.minimum(np.searchsorted(table, out), len(table) - 1)
            out = np.where(table[at] == out, at + 1, 0) if len(table) else np.zeros_like(out)
            span, used = len(table) + 1, used + 1
        nexts = coded[i : i + places]
        out *= base
        out += nexts
        span *= base
        if learn:
            dead |= nexts == 0
    return out


def counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all pieces, each once, with the sums of their counts."""
    if len(keys) == 1:
        return keys[0], counts[0]
    every, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
    sums = np.zeros(len(every), dtype=np.int64)
    np.add.at(sums, inverse, np.concatenate([np.zeros(0, np.int64), *counts]))
    return every, sums


def seed_table(targets: DataFrame, name: str, k: int, most: int) -> SeedTable | None:
    """The table of ``targets(name, seq)`` if they have at most ``most`` k-mers, which are counted first."""
    size = F.octet_length(F.col("seq").cast("binary"))
    used = targets.select(F.col(name), "seq").where((size >= k) & F.col(name).isNotNull())
    if (used.agg(F.sum(size - (k - 1))).first()[0] or 0) > most:
        return None
    found = used.toArrow().combine_chunks()
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in found.columns]
    return SeedTable.build(*columns, k)


def shared_kmers(queries: DataFrame, table: SeedTable, min_containment: float) -> DataFrame:
    """(query, target, shared, target_kmers): how many of a target's distinct k-mers a query holds, where the share is large enough.

    ``table`` has each k-mer of a target once (``distinct``).
    """
    many = max(1, len(table.names))
    sizes = np.bincount(table.target, minlength=many)
    needed = np.ceil(sizes * float(min_containment) - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, query, _, at, _ in table.slices(batch):
                kinds = max(1, len(table.numbers))
                query, at = np.divmod(np.unique(query * kinds + at), kinds)
                pieces = [np.unique(query[here] * many + table.target[rows], return_counts=True) for here, rows in table.matches(at)]
                keys, shared = counted([p[0] for p in pieces], [p[1] for p in pieces])
                query, target = np.divmod(keys, many)
                kept = np.flatnonzero(shared >= needed[target])
                columns = [
                    batch.column(0).take(pa.array(query[kept] + first)),
                    table.names.take(pa.array(target[kept])),
                    pa.array(shared[kept].astype(np.int64)),
                    pa.array(sizes[target[kept]].astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "target", "shared", "target_kmers"])

    return queries.select(F.col("query").cast("string"), F.col("seq").cast("binary")).mapInArrow(
        run, "query string, target string, shared bigint, target_kmers bigint"
    )


def shared_diagonals(queries: DataFrame, table: SeedTable, min_seeds: int) -> DataFrame:
    """(query, target, diagonal, seeds, qseq): the diagonal with the most common k-mers of each pair, the smallest of equals."""
    many = max(1, len(table.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query", "target", "diagonal", "seeds", "qseq"]
        for batch in batches:
            for first, query, place, at, longest in table.slices(batch):
                wide = longest + int(table.sizes) + 1
                pieces = []
                for here, rows in table.matches(at):
                    diagonal = place[here] - table.place[rows] + int(table.sizes)
                    pieces.append(np.unique((query[here] * many + table.target[rows]) * wide + diagonal, return_counts=True))
                keys, seeds = counted([p[0] for p in pieces], [p[1] for p in pieces])
                good = seeds >= min_seeds
                pair, diagonal = np.divmod(keys[good], wide)
                seeds = seeds[good]
                order = np.lexsort((diagonal, -seeds, pair))
                best = order[np.flatnonzero(np.diff(pair[order], prepend=-1))]
                query, target = np.divmod(pair[best], many)
                from_row = pa.array(query + first)
                columns = [
                    batch.column(0).take(from_row),
                    table.names.take(pa.array(target)),
                    pa.array(diagonal[best] - int(table.sizes)),
                    pa.array(seeds[best].astype(np.int64)),
                    batch.column(1).take(from_row),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return queries.select(F.col("query").cast("string"), F.col("seq").cast("string")).mapInArrow(
        run, "query string, target string, diagonal bigint, seeds bigint, qseq string"
    )
