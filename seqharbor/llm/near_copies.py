"""Near copies: SimHash candidates of several seeds, each link decided by the exact Jaccard similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bounded, free_prefix, materialize, slices_by_bytes
from .components import components
from .simhash import join_roots, majority_bits, shingle_hashes, trie_links

SEEDS = 16  # four blocks of 16 bits each: at a similarity of 0.8 one of the 64 agrees in 99 %
BITS, GUARD = 14, 18
BLOCK = 512
_COLUMNS = 4096
DEALT = 32
_PRINTS = [f"f{s}" for s in range(SEEDS)]


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, words), dtype=np.uint64))


def seeded(hashes: np.ndarray, seed: int) -> np.ndarray:
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_key(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` as a written table whose rows have a number: equal rows can be told apart by it."""
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """(row, key, tk, node, f0 ...) of rows (row, key, text).

    ``tk`` is the text's hash, ``node`` the hash of its shingle set, f0 ... a fingerprint of the set per seed.
    """
    bounded(rows.sparkSession)

    def run(batches):
        for part, texts in slices_by_bytes(batches, "text", 2 << 20):
            sets = [shingle_set(t, words) for t in texts]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            hashes = np.concatenate(sets)
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64)
            prints = [majority_bits(seeded(hashes, s), sizes) for s in range(SEEDS)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(3)), *[pa.array(x.view(np.int64)) for x in (nodes, *prints)]],
                names=["row", "key", "tk", "node", *_PRINTS],
            )

    kind = rows.schema["key"].dataType.simpleString()
    columns = ", ".join(f"{c} bigint" for c in ("tk", "node", *_PRINTS))
    return rows.select("row", "key", text_key().alias("tk"), "text").mapInArrow(run, f"row bigint, key {kind}, {columns}")


def candidate_links(nodes: DataFrame) -> DataFrame:
    """(node, root): links that connect all sets whose fingerprints of some seed are near."""
    prints = [
        F.struct(F.lit(s).alias("seed"), F.col(f"f{s}").alias("fp"), F.col(f"f{(s + 1) % SEEDS}").alias("guard"))
        for s in range(SEEDS)
    ]
    rows = nodes.select("node", F.explode(F.array(*prints)).alias("p")).select("node", "p.*")
    return trie_links(rows, BITS, 4, GUARD, agree=1)


def similar(sets: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """For each set the first one of its component; sets are linked at a Jaccard similarity of 0.8.

    Sets of side 0 are compared with those of side 1 only, sets of side 2 with each other.
    """
    sizes = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, place, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times[place] > 1
    number = np.cumsum(times > 1) - 1
    place, owner = number[place[shared]], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, _COLUMNS):
        a, b = np.searchsorted(place, [low, low + _COLUMNS])
        part = np.zeros((len(sets), int(place[b - 1]) - low + 1), dtype=np.float32)
        part[owner[a:b], place[a:b] - low] = 1
        common += part @ part.T
    near = 9 * common.astype(np.int64) >= 4 * (sizes[:, None] + sizes[None, :])
    near &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
    left, right = np.nonzero(np.triu(near, 1))
    return join_roots(np.arange(len(sets)), left, right)


def _verified(rows: DataFrame) -> DataFrame:
    """(node, root) of rows (cell, side, node, shingles): exact links within each cell."""
    bounded(rows.sparkSession)

    def links(held):
        nodes = np.array([r[2] for r in held], dtype=np.int64)
        nodes, first = np.unique(nodes, return_index=True)
        if len(nodes) < 2:
            return nodes[:0], nodes[:0]
        root = similar([np.frombuffer(held[i][3], dtype=np.uint64) for i in first], np.array([held[i][1] for i in first]))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return nodes[moved], nodes[root[moved]]

    def run(batches):
        held = []
        for batch in batches:
            found = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and held[-1][0] != row[0]:
                    found.append(links(held))
                    held = []
                held.append(row)
            if found:
                yield _batch(found)
        if held:
            yield _batch([links(held)])

    def _batch(found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["node", "root"])

    placed = rows.select("cell", "side", "node", "shingles").repartition("cell").sortWithinPartitions("cell")
    return placed.mapInArrow(run, "node bigint, root bigint")


def _shingles(rows: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(node, grp, m, shingles) of the members' texts."""
    wanted = members.select("node", "grp", "m", F.col("first.row").alias("_row"))
    texts = rows.select("row", F.col("text").alias("_text"))
    found = texts.join(wanted.hint("merge"), F.col("row") == F.col("_row")).select("node", "grp", "m", "_text")

    def run(batches):
        for part, raw in slices_by_bytes(batches, "_text", 2 << 20):
            sets = [shingle_set(t, words).tobytes() for t in raw]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(3)), pa.array(sets, pa.binary())], names=["node", "grp", "m", "shingles"]
            )

    return found.mapInArrow(run, "node bigint, grp bigint, m bigint, shingles binary")


def _parts(n):
    return F.ceil(n / BLOCK).cast("long")


def _dealt(column: str, parts):
    return F.pmod(F.xxhash64(column, F.lit(7)), parts)


def _across(sets: DataFrame, links: DataFrame) -> DataFrame:
    """Links between the blocks of large groups, added to those within their blocks.

    The largest components of the blocks meet first. What they make together is the group's core; its
    sets are connected already, so only the others are compared with all of it and each other.
    """
    def labelled(links, name):
        roots = components(links).select(F.col("node").alias("of"), F.col("root").alias("label"))
        out = sets.join(roots, F.col("node") == F.col("of"), "left").withColumn("label", F.coalesce("label", "node"))
        return materialize(out.drop("of"), name)

    inner = labelled(links, "block-labels").withColumn("blk", _dealt("node", _parts(F.col("m"))))
    sizes = inner.groupBy("grp", "m", "blk", "label").agg(F.count("*").alias("n"))
    heads = sizes.groupBy("grp", "m", "blk").agg(F.max_by("label", F.struct("n", "label")).alias("head"))
    heads = materialize(heads.select("head", F.xxhash64("grp", _dealt("blk", _parts(_parts(F.col("m"))))).alias("cell")), "heads")
    met = _verified(sets.join(heads, F.col("node") == F.col("head")).withColumn("side", F.lit(2)))
    links = materialize(links.union(met), "core-links")

    rows = labelled(links, "core-labels")
    counts = rows.groupBy("grp", "label").agg(F.count("*").alias("n"))
    cores = counts.groupBy(F.col("grp").alias("of")).agg(
        F.max_by("label", F.struct("n", "label")).alias("core"), F.max("n").alias("inside"), F.sum("n").alias("every")
    ).withColumn("outside", F.col("every") - F.col("inside")).filter("outside > 0")
    rows = rows.join(materialize(cores, "cores"), F.col("grp") == F.col("of"))
    rows = rows.withColumn("ins", _parts(F.col("inside"))).withColumn("outs", _parts(F.col("outside")))
    core = F.col("label") == F.col("core")
    rows = rows.withColumn("mine", _dealt("node", F.when(core, F.col("ins")).otherwise(F.col("outs"))))

    def upto(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other")

    kept = ["grp", "node", "shingles", "mine"]
    a = rows.filter(core).select(*kept, upto(F.col("outs"))).withColumn("side", F.lit(0))
    a = a.withColumn("cell", F.xxhash64("grp", F.lit(0), "mine", "other"))
    b = rows.filter(~core).select(*kept, upto(F.col("ins"))).withColumn("side", F.lit(1))
    b = b.withColumn("cell", F.xxhash64("grp", F.lit(0), "other", "mine"))
    c = rows.filter(~core).select(*kept, upto(F.col("outs")))
    c = c.withColumn("side", F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1))
    c = c.withColumn("cell", F.xxhash64("grp", F.lit(1), F.least("mine", "other"), F.greatest("mine", "other")))
    wanted = ["cell", "side", "node", "shingles"]
    return links.union(_verified(a.select(*wanted).union(b.select(*wanted)).union(c.select(*wanted))))


def _linked(rows: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of rows (row, key, text), and (node, first, root): each shingle set with its first row and its component."""
    prints = materialize(sketches(rows, words), "sketches")
    first = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("id"), "tk", "row")
    nodes = prints.groupBy("node").agg(F.min(first).alias("first"), *[F.min(f).alias(f) for f in _PRINTS])
    nodes = materialize(nodes, "nodes")
    loose = materialize(components(candidate_links(nodes)), "loose")
    sizes = loose.groupBy(F.col("root").alias("grp")).agg(F.count("*").alias("m"))
    members = loose.withColumnRenamed("node", "of").join(sizes, F.col("root") == F.col("grp"))
    members = nodes.select("node", "first").join(members, F.col("node") == F.col("of"))
    sets = materialize(_shingles(rows, members.select("node", "first", "grp", "m"), words), "shingles")
    cells = sets.withColumn("cell", F.xxhash64("grp", _dealt("node", _parts(F.col("m"))))).withColumn("side", F.lit(2))
    links = materialize(_verified(cells), "exact-links")
    large = sets.filter(F.col("m") > BLOCK)
    if not large.isEmpty():
        links = materialize(_across(materialize(large.dropDuplicates(["node"]), "large-sets"), links), "all-links")
    roots = materialize(components(links), "roots").select(F.col("node").alias("of"), "root")
    linked = nodes.select("node", "first").join(roots, F.col("node") == F.col("of"), "left")
    return prints, materialize(linked.select("node", "first", F.coalesce("root", "node").alias("root")), "linked")


def near_components(docs: DataFrame, words: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, tk, component): a row for each row of ``docs``; ``tk`` is the hash of its text.

    Texts of one component are connected by pairs whose shingle sets have a Jaccard similarity of 0.8 or
    more. Fingerprints only choose what is compared: groups of candidates are compared whole, large
    ones block by block. ``component`` is the first of its rows: the smallest (without id, id, tk, row number).
    """
    rows = numbered(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "row")
    prints, linked = _linked(rows, words)
    smallest = linked.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component"))
    # a component may hold a third of all sets: its rows are dealt over as many copies of its name
    dealt = linked.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(DEALT)))
    copies = smallest.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    named = dealt.join(copies, (F.col("root") == F.col("of")) & (F.col("part") == F.col("at")))
    named = materialize(named.select("node", "component"), "named")
    return prints.select(F.col("key").alias(key), "tk", "node").join(named, "node").select(key, "tk", "component")


def first_of_each(docs: DataFrame, words: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each component of near copies: the first in the order of ``near_components``.

    Rows are known by a number, so that of rows equal in everything one stays as well.
    """
    row = free_prefix(docs, "row_") + "number"
    every = numbered(docs, row)
    rows = every.select(F.col(row).alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    _, linked = _linked(rows, words)
    first = linked.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    # the kept rows grow with the corpus: never broadcast, however few they are
    kept = every.join(materialize(first, "kept").hint("merge"), row, "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
