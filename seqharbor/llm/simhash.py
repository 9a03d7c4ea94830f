"""SimHash near-duplicates: 64-bit fingerprints linked by a self-join of their binary trie."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bounded, materialize, slices_by_bytes
from .components import components

GROUP_ROWS = 16_384
FRONTIER = 400_000
_LANES = 255  # rows that byte-wide counters can add up


def _bit_lanes() -> np.ndarray:
    """For each byte, its eight bits as the eight bytes of one integer."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint per run of ``sizes`` hashes: the bits set in over half of them."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = (np.cumsum(sizes) - sizes)[full]
    parts = -(-sizes[full] // _LANES)
    first = np.cumsum(parts) - parts
    begin = np.repeat(starts, parts) + (np.arange(parts.sum()) - np.repeat(first, parts)) * _LANES
    lanes = _bit_lanes()[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, begin, axis=0).view(np.uint8).astype(np.int32)
    counts = np.add.reduceat(sums, first, axis=0)
    bits = (counts * 2 > sizes[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> list[int]:
    """XXH64 of each shingle of a lower-cased text; a shorter text is one shingle."""
    tokens = text.lower().split()
    if not tokens:
        return []
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(tokens), seed)]
    runs = zip(*(tokens[i:] for i in range(words)), strict=False)
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(seed)))


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, guard): the SimHash of every whole text, as a signed long, and a second one.

    Only A-Z are lower-cased, words are runs without ASCII white space, shingles keep their
    repeats. A null text or one without words has fingerprint zero. ``guard`` is made of the same
    hashes, mixed once more, so that its bits tell chance agreement from likeness.
    """
    bounded(docs.sparkSession)

    def run(batches):
        for part, texts in slices_by_bytes(batches, text, 2 << 20):
            per_doc = [shingle_hashes(t, words) for t in texts]
            sizes = np.array([len(h) for h in per_doc], dtype=np.int64)
            hashes = np.fromiter((h for one in per_doc for h in one), dtype=np.uint64, count=int(sizes.sum()))
            prints = majority_bits(hashes, sizes), majority_bits(_mixed(hashes), sizes)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(p.view(np.int64)) for p in prints]], names=[key, "fp", "guard"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint, guard bigint")


def _mixed(hashes: np.ndarray) -> np.ndarray:
    out = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def trie_roots(
    fps: np.ndarray, groups: np.ndarray, budget: int, guards: np.ndarray | None = None, guard_budget: int = 64
) -> np.ndarray:
    """For each fingerprint the first one of its component, linking within ``budget`` differing bits.

    ``fps`` is sorted by (group, unsigned value) and distinct within a group; only fingerprints of
    one group are linked. A trie node is a range of the sorted array. Node pairs are walked level
    by level from each group's root with itself, and a pair is dropped as soon as its differing
    bits exceed the budget; two leaves compare the bits they have left at once. Wide levels are
    walked in parts, so that memory stays bounded.
    """
    root = np.arange(len(fps))
    if not len(fps):
        return root
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    ends = np.r_[starts[1:], len(fps)]
    many = ends - starts > 1
    zeros: dict[int, np.ndarray] = {}
    stack = [(63, starts[many], ends[many], starts[many], ends[many], np.zeros(int(many.sum()), np.int8))]
    while stack:
        bit, a0, a1, b0, b1, off = stack.pop()
        if not len(a0):
            continue
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(bit, *(x[half:] for x in (a0, a1, b0, b1, off))), (bit, *(x[:half] for x in (a0, a1, b0, b1, off)))]
            continue
        if bit not in zeros:
            zeros[bit] = np.r_[0, np.cumsum((fps >> np.uint64(bit)) & np.uint64(1) == 0)]
        zero = zeros[bit]
        am, bm = a0 + zero[a1] - zero[a0], b0 + zero[b1] - zero[b0]
        other = a0 != b0
        kids = [
            (a0, am, b0, bm, off), (am, a1, bm, b1, off), (a0, am, bm, b1, off + 1),
            (am[other], a1[other], b0[other], bm[other], off[other] + 1),
        ]
        kids = [np.concatenate(x) for x in zip(*kids, strict=True)]
        wide, high = kids[1] - kids[0], kids[3] - kids[2]
        # a node with itself needs two leaves to hold a pair
        live = (wide > 0) & (high > 0) & (kids[4] <= budget) & ((kids[0] != kids[2]) | (wide > 1))
        leaves = live & (wide == 1) & (high == 1)
        left, right = kids[0][leaves], kids[2][leaves]
        near = np.bitwise_count(fps[left] ^ fps[right]) <= budget
        if guards is not None:
            near &= np.bitwise_count(guards[left] ^ guards[right]) <= guard_budget
        root = join_roots(root, left[near], right[near])
        live &= ~leaves
        stack.append((bit - 1, *(x[live] for x in kids)))
    return root


def join_roots(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each position when further links are added."""
    if not len(left):
        return root
    while True:
        before = root
        root = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, before[left], low)
        np.minimum.at(root, before[right], low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def block_masks(budget: int, blocks: int, bits: list[int]) -> list[list[int]]:
    """``bits`` cut into blocks, and every choice of blocks - budget of them: fingerprints within the
    budget agree on all bits of one choice."""
    cut = [x.tolist() for x in np.array_split(np.array(bits), blocks)]
    return [sum(chosen, []) for chosen in combinations(cut, blocks - budget)]


def _signed(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _cut(
    rows: DataFrame, masks: list[tuple[int, list[int]]], budget: int, blocks: int, also: list[str]
) -> tuple[DataFrame, list]:
    """Rows (fp, guard, mask) dealt to the block choices that their mask leaves open: (fp, guard, mask, cell).

    A cell is one value of the chosen bits, by a hash; two values in one cell only mean more to compare.
    ``also`` are further columns to keep; a ``seed`` among them has cells of its own.
    """
    new, branches = [], []
    for number, fixed in masks:
        taken = set(fixed)
        for chosen in block_masks(budget, blocks, [b for b in range(63, -1, -1) if b not in taken]):
            new.append((len(new), fixed + chosen))
            branches.append((number, len(new) - 1, _signed(fixed + chosen)))
    options = F.array(*[
        F.struct(F.lit(m).alias("was"), F.lit(i).alias("mask"), F.lit(bits).cast("long").alias("bits"))
        for m, i, bits in branches
    ])
    if len(masks) > 1:
        options = F.filter(options, lambda o: o.was == F.col("mask"))
    dealt = rows.select("fp", "guard", *also, F.explode(options).alias("o"))
    cell = F.xxhash64("o.mask", F.col("fp").bitwiseAND(F.col("o.bits")), *[c for c in also if c == "seed"])
    return dealt.select("fp", "guard", *also, F.col("o.mask").alias("mask"), cell.alias("cell")), new


def trie_links(
    nodes: DataFrame, budget: int = 2, blocks: int | None = None, guard_budget: int = 64, group_rows: int = GROUP_ROWS,
    agree: int | None = None,
) -> DataFrame:
    """(fp, root): for the distinct fingerprints of ``nodes``, links that connect the same components
    as all pairs within ``budget`` differing bits.

    The bits are cut into ``blocks`` (budget + 1 unless given). Two fingerprints within the budget
    agree on some blocks - budget of them, so for every such choice the trie that starts with its
    bits is cut below each of their values, and the subtries are joined with themselves in
    parallel. A subtrie of more than ``group_rows`` fingerprints is cut again on its open bits,
    twice at most, when few enough are open to bound it. A task emits a fingerprint and the
    first one of its component in that subtrie, never all pairs.

    With ``agree``, pairs must agree on that many blocks at first, whatever the budget. Rows with
    ``node`` and ``seed`` give (node, root) instead: only fingerprints of one seed are linked, and
    equal ones may belong to several nodes.
    """
    also = [c for c in ("node", "seed") if c in nodes.columns]
    guard = F.col("guard") if guard_budget < 64 else F.lit(0).cast("long").alias("guard")
    rows, masks = nodes.select("fp", guard, *also).withColumn("mask", F.lit(0)), [(0, [])]
    found, blocks = [], blocks or budget + 1
    for level in range(3):
        if level or agree is None:
            dealt, masks = _cut(rows, masks, budget, budget + 1 if level else blocks, also)
        else:
            dealt, masks = _cut(rows, masks, blocks - agree, blocks, also)
        if level == 2:
            found.append(dealt)
            break
        sizes = dealt.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > group_rows)
        large = materialize(sizes.select("cell"), "large-cells")
        if large.isEmpty():
            found.append(dealt)
            break
        found.append(dealt.join(large, "cell", "left_anti"))
        rows = materialize(dealt.join(large, "cell", "left_semi").select("fp", "guard", *also, "mask"), "large-rows")

    def run(batches):
        for fps, guards, groups, *ids in _whole_groups(batches, 2 * GROUP_ROWS):
            order = np.lexsort((fps, groups))
            fps, guards, groups = fps[order], guards[order], groups[order]
            names = ids[0][order] if ids else fps.view(np.int64)
            new = np.r_[True, (fps[1:] != fps[:-1]) | (groups[1:] != groups[:-1])][: len(fps)]
            firsts = np.flatnonzero(new)
            found = trie_roots(
                fps[firsts], groups[firsts], budget, guards[firsts] if guard_budget < 64 else None, guard_budget
            )
            root = firsts[found][np.cumsum(new) - 1]
            moved = np.flatnonzero(root != np.arange(len(fps)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[moved]), pa.array(names[root[moved]])], names=[name, "root"]
            )

    out, name = None, "node" if also else "fp"
    for part in found:
        placed = part.select("fp", "guard", "cell", *also[:1]).repartition("cell").sortWithinPartitions("cell")
        links = placed.mapInArrow(run, f"{name} bigint, root bigint")
        out = links if out is None else out.union(links)
    return out


def _whole_groups(batches, rows: int):
    """Rows sorted by cell as slices of whole cells of about ``rows`` rows: (fp, guard, number of the cell, others)."""
    held, size = [], 0
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        held.append(columns)
        size += len(columns[0])
        if size >= rows:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[2], columns[2][-1]))
            if cut:
                yield _numbered(*(c[:cut] for c in columns))
            held, size = [[c[cut:] for c in columns]], size - cut
    if size:
        yield _numbered(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _numbered(fp, guard, cell, *others):
    unsigned = [np.ascontiguousarray(x, dtype=np.int64).view(np.uint64) for x in (fp, guard)]
    return *unsigned, np.cumsum(np.r_[False, cell[1:] != cell[:-1]]), *others


def simhash_components(
    docs: DataFrame, words: int = 3, budget: int = 2, blocks: int | None = None, guard_budget: int = 64,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """(key, fingerprint, component_id), a row for each row of ``docs``.

    Fingerprints that differ in at most ``budget`` bits are linked, equal ones among them (for a wide
    budget, different ones only if their second fingerprints are within ``guard_budget`` as well);
    ``component_id`` is the smallest key reachable. Empty and null texts share fingerprint zero
    and are linked like any other. A null key keeps its row and names no component: a component
    of null keys only has a null id. Further columns of ``docs`` are not read.
    """
    prints = materialize(fingerprints(docs, words, text, key), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(key).alias("first"), F.min("guard").alias("guard")), "nodes")
    roots = materialize(components(trie_links(nodes, budget, blocks, guard_budget)), "roots")
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = materialize(linked.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    named = materialize(linked.join(smallest, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
