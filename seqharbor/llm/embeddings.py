"""Embedding near-duplicates: inverted lists with product-quantised residuals and exact cosine rerank."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded, materialize
from .components import components
from .simhash import join_roots

SAMPLE_ROWS = 20_000
LIST_ROWS = 128
MOST_LISTS = 2048
PROBES = 16
SUBSPACES, CODES = 8, 256
BLOCK_ROWS = 1024
DEALT = 32


@dataclass
class Quantiser:
    """Coarse centres, and code words for each slice of what is left after the nearest one."""

    centres: np.ndarray
    slices: list[slice]
    words: list[np.ndarray]
    probes: int

    def coarse(self, x: np.ndarray) -> np.ndarray:
        """The ``probes`` nearest centres of each row, nearest first."""
        far = _squares(x, self.centres)
        near = np.argpartition(far, self.probes - 1, axis=1)[:, : self.probes]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each row is from what its code stands for."""
        rest = x - self.centres[at]
        codes = np.stack(
            [_squares(rest[:, s], w).argmin(1) for s, w in zip(self.slices, self.words, strict=True)], axis=1
        ).astype(np.uint8)
        coded = np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], axis=1)
        return codes, np.sqrt(((rest - coded) ** 2).sum(1))

    def tables(self, x: np.ndarray, at: int) -> list[np.ndarray]:
        """Squared distances of each row's residual slices to all code words of a list."""
        rest = x - self.centres[at]
        return [_squares(rest[:, s], w) for s, w in zip(self.slices, self.words, strict=True)]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _squares(x, centres).argmin(1)
        sums, many = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres[many > 0] = sums[many > 0] / many[many > 0, None]
    return centres


def train(sample: np.ndarray, lists: int, probes: int = PROBES, subspaces: int = SUBSPACES) -> Quantiser:
    """Fit the coarse centres and the code words on unit vectors."""
    lists = max(1, min(lists, len(sample)))
    centres = k_means(sample, lists)
    rest = sample - centres[_squares(sample, centres).argmin(1)]
    edges = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
    slices = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    words = [k_means(rest[:, s], min(CODES, len(sample))) for s in slices]
    return Quantiser(centres, slices, words, min(probes, lists))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """Rows of packed components as unit vectors in double precision."""
    rows = np.stack([np.frombuffer(v, dtype=kind) for v in column.to_pylist()]).astype(np.float64)
    rows /= np.abs(rows).max(axis=1)[:, None]
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _component_kind(vectors: DataFrame, column: str):
    """Components travel as they are stored, singles as singles."""
    return np.float32 if isinstance(vectors.schema[column].dataType.elementType, T.FloatType) else np.float64


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, class, packed): each row's components as bytes, and a 128-bit digest of their direction.

    Rows with a null key and vectors that are null, empty, zero or hold a null or non-finite
    component are left out.
    """
    kind, store = vectors.schema[key].dataType.simpleString(), _component_kind(vectors, column)

    def run(batches):
        for batch in batches:
            kept, units, classes = [], [], []
            for i, values in enumerate(batch.column(1).to_pylist()):
                if not values or None in values:
                    continue
                x = np.array(values, dtype=np.float64)
                if not np.isfinite(x).all() or not x.any():
                    continue
                kept.append(i)
                units.append(x.astype(store).tobytes())
                x = x / np.abs(x).max()
                classes.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest())
            keys = batch.column(0).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(classes, pa.binary()), pa.array(units, pa.binary())], names=[key, "class", "packed"]
            )

    return vectors.select(key, column).filter(F.col(key).isNotNull()).mapInArrow(
        run, f"`{key}` {kind}, class binary, packed binary"
    )


def _fit(nodes: DataFrame, kind, sample_rows: int, probes: int) -> Quantiser:
    """A quantiser of at most ``sample_rows`` vectors, chosen by a hash of their digest."""
    total = nodes.count()
    share = min(1.0, sample_rows / total)
    picked = nodes.filter(F.pmod(F.xxhash64("class"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30))))
    units = picked.orderBy("class").select("packed").limit(2 * sample_rows).toArrow().column(0).combine_chunks()
    if not len(units):
        units = nodes.select("packed").limit(1).toArrow().column(0).combine_chunks()
    return train(_matrix(units, kind), max(1, min(MOST_LISTS, total // LIST_ROWS)), probes)


def near_links(nodes: DataFrame, quantiser: Quantiser, least: float, store=np.float64) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (node, root) of the pairs of ``nodes`` (node, copies, packed) with cosine >= ``least``.

    Every node is a member of its nearest list and visits the lists of its nearest centres. In a
    list a visitor's lookup tables give its distance to every member's code; the code's own error
    bounds how far that can be off, so no near member of a visited list is passed over, and what
    is left is measured in double precision. Members of a large list are dealt over blocks of
    about ``BLOCK_ROWS``, each of which all visitors see. A pair is found once: in the list of the
    smaller number if each visits the other's. Links are counted by the copies behind them, and
    components are connected by the first node of each group of linked rows, not by all pairs.
    """
    sent = nodes.sparkSession.sparkContext.broadcast(quantiser)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9

    def place(batches):
        q = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2), store)
            near = q.coarse(x)
            codes, error = q.encode(x, near[:, 0])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(near[:, 0].astype(np.int32)),
                    pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())),
                    pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
                ],
                names=["node", "copies", "packed", "home", "visits", "code", "error"],
            )

    placed = materialize(
        nodes.select("node", "copies", "packed").mapInArrow(
            place,
            "node bigint, copies bigint, packed binary, home int, visits array<int>, code binary, error double",
        ),
        "placed",
    )
    sizes = placed.groupBy("home").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    blocks = F.broadcast(sizes.withColumnRenamed("home", "at"))  # at most MOST_LISTS rows
    members = placed.join(blocks, placed.home == F.col("at")).select(
        "at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"),
        "node", "copies", "packed", "home", "visits", "code", "error",
    )
    visitors = placed.withColumn("to", F.explode("visits")).join(blocks, F.col("to") == F.col("at")).select(
        "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"),
        "node", "copies", "packed", "home", "visits", F.lit(None).cast("binary").alias("code"),
        F.lit(None).cast("double").alias("error"),
    )
    together = members.union(visitors).repartition("at", "block").sortWithinPartitions("at", "block", "kind", "node")

    def run(batches):
        q, held, now = sent.value, [], None
        for batch in batches:
            at, block, kind = (batch.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])])
            for a, b in zip(cut, [*cut[1:], len(at)], strict=True):
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    if now != (at[a], block[a]):
                        held, now = [], (at[a], block[a])
                    held.append(part)
                elif held and now == (at[a], block[a]):
                    for i in range(0, part.num_rows, 1024):
                        yield from _measure(q, int(at[a]), held, part.slice(i, 1024), least, reach, store)

    found = materialize(together.mapInArrow(run, "node bigint, links bigint, root bigint"), "near-links")
    links = found.filter("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    return links, found.filter("root <> node").select("node", "root")


def _measure(q: Quantiser, at: int, held: list, part: pa.RecordBatch, least: float, reach: float, kind):
    if len(held) > 1:
        held[:] = [pa.Table.from_batches(held).combine_chunks().to_batches()[0]]
    group = held[0]
    mine, theirs = group.column(3).to_numpy(), part.column(3).to_numpy()
    codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in group.column(8).to_pylist()])
    x, y = _matrix(part.column(5), kind), _matrix(group.column(5), kind)
    square = np.zeros((len(theirs), len(mine)))
    for i, lookup in enumerate(q.tables(x, at)):
        square += lookup[:, codes[:, i]]
    v, m = np.nonzero(np.sqrt(square) <= reach + group.column(9).to_numpy()[None] + 1e-6)
    home = part.column(6).to_numpy()
    # a pair of one list once; one of two lists in the smaller, if both would find it
    visits = np.stack(group.column(7).to_pylist())
    once = np.where(home[v] == at, theirs[v] < mine[m], (home[v] > at) | ~(visits[m] == home[v][:, None]).any(1))
    v, m = v[once], m[once]
    near = np.einsum("ij,ij->i", x[v], y[m]) >= least
    v, m = v[near], m[near]
    if not len(v):
        return
    all_nodes, inverse = np.unique(np.r_[theirs, mine], return_inverse=True)
    a, b = inverse[: len(theirs)][v], inverse[len(theirs):][m]
    links = np.bincount(a, group.column(4).to_numpy()[m], len(all_nodes)) + np.bincount(
        b, part.column(4).to_numpy()[v], len(all_nodes)
    )
    root = join_roots(np.arange(len(all_nodes)), a, b)
    some = links > 0
    yield pa.RecordBatch.from_arrays(
        [pa.array(all_nodes[some]), pa.array(links[some].astype(np.int64)), pa.array(all_nodes[root[some]])],
        names=["node", "links", "root"],
    )


def near_vectors(
    vectors: DataFrame, least: float = 0.9, key: str = "vec_id", column: str = "embedding",
    sample_rows: int = SAMPLE_ROWS, probes: int = PROBES,
) -> DataFrame:
    """(key, n_links, component_id, kept), a row for each row of ``vectors``.

    Vectors are linked by a cosine of at least ``least``; vectors of different length never are. Equal
    directions are one class with a count, so copies are never paired. Rows without a usable vector and rows with a null key
    have no links and stay. Keys are longs; rows that repeat a key are vectors of their own, each
    with its own links and component. One quantiser is fitted and one search made for each length.
    """
    bounded(vectors.sparkSession)
    kind = _component_kind(vectors, column)
    rows = materialize(usable(vectors, key, column), "units")
    classes = rows.groupBy("class").agg(
        F.min(key).cast("long").alias("first"), F.count("*").alias("copies"), F.min("packed").alias("packed")
    )
    # numbered in the order of the smallest key: the smallest number of a component has its smallest key
    nodes = materialize(
        classes.orderBy("first", "class").withColumn("node", F.monotonically_increasing_id()), "classes"
    )
    size = F.octet_length("packed")
    lengths = nodes.groupBy(size.alias("size")).count().filter("count > 1").collect()
    links = edges = None
    for found in sorted(lengths):
        same = nodes.filter(size == found["size"])
        here, joined = near_links(same, _fit(same, kind, sample_rows, probes), least, kind)
        links = here if links is None else links.union(here)
        edges = joined if edges is None else edges.union(joined)
    judged = nodes.select("class", "copies", "first", F.lit(0).cast("long").alias("links"))
    if links is not None:
        judged = _judged(nodes, links, edges)
    judged = materialize(
        judged.select(
            F.col("class").alias("known"), (F.col("copies") - 1 + F.col("links")).alias("n_links"),
            F.col("first").alias("component_id"),
        ),
        "judged",
    )
    named = rows.select(key, "class").join(judged, F.col("class") == F.col("known")).select(key, "n_links", "component_id")
    rest = _unusable(vectors, key, column).select(
        key, F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id")
    )
    return named.union(rest).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _judged(nodes: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """(class, copies, first, links) with the first key of the class's component."""
    roots = materialize(components(edges), "roots").withColumnRenamed("node", "of")
    firsts = roots.select(F.col("root").alias("top")).distinct().join(nodes.select("node", "first"), F.col("top") == F.col("node"))
    # a component may hold a third of all classes: its members are dealt over as many copies of its first key
    copies = firsts.select("top", F.col("first").alias("top_first"), F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("at"))
    dealt = roots.withColumn("part", F.pmod(F.xxhash64("of"), F.lit(DEALT)))
    known = dealt.join(copies, (F.col("root") == F.col("top")) & (F.col("part") == F.col("at"))).select("of", "top_first")
    return (
        nodes.drop("packed").join(links.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
        .join(known, F.col("node") == F.col("of"), "left")
        .select("class", "copies", F.coalesce("top_first", "first").alias("first"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def _unusable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """The rows that ``usable`` leaves out, judged by the same rules in place."""
    x = F.col(column)
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    fine = (F.size(x) > 0) & ~F.exists(x, odd) & F.exists(x, lambda v: v != 0)
    return vectors.filter(F.col(key).isNull() | ~F.coalesce(fine, F.lit(False)))
