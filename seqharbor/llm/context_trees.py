"""Language-model scores by context-tree weighting of bytes, learned and looked up as tables of byte grams."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded, crc_fold, materialize

DEPTH = 5
TOP = 3  # context bytes that tell the parallel subtrees apart
BLOCK_BYTES = 32 << 20
SLICE_BYTES = 2 << 20
END = b"\n"
_MIX = 2654435761


def gram_stream(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams (``depth`` context bytes and the byte after them) of all texts, and where each text ends.

    A text is its words joined by blanks and closed by a line feed; line feeds stand before it.
    """
    parts = [b" ".join(words) + END for words in texts]
    lead = END * depth
    data = np.frombuffer(lead + lead.join(parts), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(p) for p in parts])
    key = np.zeros(len(data) - depth, dtype=np.uint64)
    for j in range(depth + 1):
        key |= data[j : len(data) - depth + j] << np.uint64(8 * (depth - j))
    starts = np.cumsum(sizes + depth) - sizes - depth
    inside = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return key[inside], np.cumsum(sizes)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for positive numbers, by Stirling's series after six steps up."""
    up = x + 6
    low = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4) * (x + 5))
    inverse = 1 / up
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    return (up - 0.5) * np.log(up) - up + 0.5 * np.log(2 * np.pi) + series - low


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - np.log(np.pi)


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
    """(log weighted probability, weight of the own estimate, own estimate of a one) of inner nodes,
    given the sum of their children's logs, or of leaves."""
    own, guess = log_kt(zeros, ones), (ones + 0.5) / (zeros + ones + 1.0)
    if below is None:
        return own, np.ones(len(own)), guess
    return np.logaddexp(own, below) - np.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700))), guess


class Subtrees:
    """The context trees of whole ``TOP``-byte contexts, from sorted distinct grams and their counts.

    A byte is eight binary decisions; decision k of a byte is made in a node named by the bits
    before it. Every (context, node) has its counts; its children are the contexts one byte longer.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int, top: int = TOP):
        self.depth, self.top = depth, top
        self.grams = {depth: grams}
        self.counts = {depth: counts.astype(np.float64)}
        self.up: dict[int, np.ndarray] = {}
        for d in range(depth - 1, top - 1, -1):
            short = self.grams[d + 1] & np.uint64((1 << 8 * (d + 1)) - 1)
            self.grams[d], self.up[d + 1] = np.unique(short, return_inverse=True)
            self.counts[d] = np.bincount(self.up[d + 1], self.counts[d + 1], len(self.grams[d]))
        self.nodes = {(d, k): self._nodes(d, k) for d in self.grams for k in range(8)}
        self.weights: dict[tuple[int, int], tuple] = {}
        for d in range(depth, top - 1, -1):
            for k in range(8):
                _, _, zeros, ones = self.nodes[d, k]
                below = None
                if d < depth:
                    first = self.nodes[d + 1, k][1]
                    parent = self.nodes[d, k][0][self.up[d + 1][first]]
                    below = np.bincount(parent, self.weights[d + 1, k][0], len(zeros))
                self.weights[d, k] = weigh(zeros, ones, below)

    def _nodes(self, d: int, k: int):
        """Of each gram its node, of each node its first gram, zeros and ones."""
        name = self.grams[d] >> np.uint64(8 - k)
        start = np.r_[True, name[1:] != name[:-1]]
        first, counts = np.flatnonzero(start), self.counts[d]
        ones = counts * ((self.grams[d] >> np.uint64(7 - k)) & np.uint64(1))
        some = np.add.reduceat(ones, first)
        return np.cumsum(start) - 1, first, np.add.reduceat(counts, first) - some, some

    def roots(self):
        """(context, node, zeros, ones, log weighted probability) of the ``TOP``-byte contexts."""
        out = []
        for k in range(8):
            _, first, zeros, ones = self.nodes[self.top, k]
            gram = self.grams[self.top][first]
            node = (np.uint64(1 << k) | ((gram & np.uint64(255)) >> np.uint64(8 - k))).astype(np.int64)
            out.append(((gram >> np.uint64(8)).astype(np.int64), node, zeros, ones, self.weights[self.top, k][0]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    def log_probabilities(self, names: np.ndarray, done: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log probability of each gram's last byte after its context.

        ``names`` (context x 256 + node, sorted) have what the shorter contexts give to a one
        (``done``) and the weight they leave (``left``).
        """
        grams = self.grams[self.depth]
        total = np.zeros(len(grams))
        for k in range(8):
            at = np.arange(len(grams))
            chance = self.weights[self.depth, k][2][self.nodes[self.depth, k][0]]
            for d in range(self.depth - 1, self.top - 1, -1):
                at = self.up[d + 1][at]
                node = self.nodes[d, k][0][at]
                _, own, guess = self.weights[d, k]
                chance = own[node] * guess[node] + (1 - own[node]) * chance
            short = grams & np.uint64((1 << 8 * (self.top + 1)) - 1)
            name = ((short >> np.uint64(8)) << np.uint64(8)) | np.uint64(1 << k) | ((grams & np.uint64(255)) >> np.uint64(8 - k))
            where = np.searchsorted(names, name.astype(np.int64))
            chance = done[where] + left[where] * chance
            one = ((grams >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
            total += np.log(np.where(one, chance, 1 - chance))
        return total


def pack(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as compressed steps, the bytes of one place together."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    columns = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(columns.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_numbers(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def unpack_numbers(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of several lists and the sums of their counts."""
    grams, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(grams))
    return grams, counts.astype(np.int64)


def gram_shard(grams: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a gram's last three context bytes."""
    c3 = (grams >> np.uint64(8)) & np.uint64(0xFFFFFF)
    return (((c3 * np.uint64(_MIX)) & np.uint64(0xFFFFFFFF)) >> np.uint64(16)).astype(np.int64) % shards


def _context_shard(c3: str, shards: int) -> Column:
    mixed = (F.col(c3) * F.lit(_MIX)).bitwiseAND(F.lit(0xFFFFFFFF))
    return (F.shiftright(mixed, 16) % shards).cast("int")


def _slices(texts: list[bytes]):
    """(first text, words of each text) of slices of about ``SLICE_BYTES``."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_BYTES:
            yield first, [t.lower().split() for t in texts[first : i + 1]]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, [t.lower().split() for t in texts[first:]]


def _by_shard(batches):
    """(kind, shard, rows) of whole shards, from batches sorted by kind and shard."""
    held, now = [], None
    for batch in batches:
        kind, shard = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (shard[1:] != shard[:-1])]) if len(kind) else []
        for a, b in zip(cut, [*cut[1:], len(kind)], strict=False):
            if now != (kind[a], shard[a]):
                if held:
                    yield *now, pa.Table.from_batches(held).combine_chunks()
                held, now = [], (kind[a], shard[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield *now, pa.Table.from_batches(held).combine_chunks()


def _shard_grams(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The grams of each block, the distinct ones and their training counts."""
    grams = [unpack(d) for d in rows.column("keys").to_pylist()]
    counts = [unpack_numbers(d, np.int64) for d in rows.column("counts").to_pylist()]
    return grams, *merged(list(zip(grams, counts, strict=True)))


def _inner(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds logw, own and guess to nodes with zeros, ones and below."""

    def run(batches):
        for batch in batches:
            n = len(names)
            zeros, ones, below = (batch.column(n + i).to_numpy(zero_copy_only=False) for i in range(3))
            new = [pa.array(np.asarray(x)) for x in weigh(zeros, ones, below)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "logw", "own", "guess"])

    schema = ", ".join([*[f"{c} bigint" for c in names], *[f"{c} double" for c in ("zeros", "ones", "below", "logw", "own", "guess")]])
    return rows.select(*names, "zeros", "ones", "below").mapInArrow(run, schema)


def _sum_up(rows: DataFrame, names: list[str]) -> DataFrame:
    return _inner(
        rows.groupBy(*names).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("logw").alias("below")), names
    )


def top_weights(requests: DataFrame, depth: int) -> DataFrame:
    """(c3, node, done, left): what contexts of up to two bytes give to a one in each node of the
    three-byte contexts, and the weight that they leave.

    Subtrees of three-byte contexts are summed shard by shard; the few nodes above them are summed
    by groupings, weighted, and sent down again by joins.
    """

    def sum_subtrees(batches):
        for _, _, rows in _by_shard(batches):
            _, grams, counts = _shard_grams(rows)
            found = Subtrees(grams, counts, depth).roots()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["c3", "node", "zeros", "ones", "logw"])

    placed = requests.filter("kind = 0").repartition("kind", "shard").sortWithinPartitions("kind", "shard")
    roots = materialize(
        placed.select("kind", "shard", "keys", "counts").mapInArrow(
            sum_subtrees, "c3 bigint, node bigint, zeros double, ones double, logw double"
        ),
        "subtrees",
    )
    two = materialize(_sum_up(roots.withColumn("c2", F.col("c3").bitwiseAND(F.lit(0xFFFF))), ["c2", "node"]), "two")
    one = materialize(_sum_up(two.withColumn("c1", F.col("c2").bitwiseAND(F.lit(0xFF))), ["c1", "node"]), "one")
    none = _sum_up(one, ["node"])
    above = none.select("node", (F.col("own") * F.col("guess")).alias("done"), (1 - F.col("own")).alias("left"))
    above = materialize(_down(one, above, ["node"], ["c1", "node"]), "down-one")
    two = two.withColumn("c1", F.col("c2").bitwiseAND(F.lit(0xFF)))
    above = materialize(_down(two, above, ["c1", "node"], ["c2", "node"]), "down-two")
    contexts = roots.select("c3", "node", F.col("c3").bitwiseAND(F.lit(0xFFFF)).alias("c2"))
    return contexts.join(above, ["c2", "node"]).select("c3", "node", "done", "left")


def answers(requests: DataFrame, depth: int, shards: int) -> DataFrame:
    """(block, kind, keys, values): for the grams of a block their log probabilities, for its tokens
    their training counts."""
    top = top_weights(requests, depth).withColumns(
        {"kind": F.lit(0), "shard": _context_shard("c3", shards), "block": F.lit(-1)}
    )
    columns = ["kind", "shard", "block", "keys", "counts", "c3", "node", "done", "left"]
    both = requests.unionByName(top, allowMissingColumns=True).select(columns)

    def run(batches):
        for kind, _, rows in _by_shard(batches):
            asked = np.array(rows.column("block").to_numpy()) >= 0
            blocks = rows.filter(pa.array(asked))
            if not blocks.num_rows:
                continue
            if kind == 0:
                given = rows.filter(pa.array(~asked))
                lists, grams, counts = _shard_grams(blocks)
                c3, node, done, left = (given.column(c).to_numpy() for c in ("c3", "node", "done", "left"))
                order = np.argsort(c3 * 256 + node)
                tree = Subtrees(grams, counts, depth)
                logs = tree.log_probabilities((c3 * 256 + node)[order], done[order], left[order]).astype(np.float32)
                values = [pack_numbers(logs[np.searchsorted(grams, one)]) for one in lists]
            else:
                lists = [zstandard.decompress(d).split(END) for d in blocks.column("keys").to_pylist()]
                total: Counter = Counter()
                for one, data in zip(lists, blocks.column("counts").to_pylist(), strict=True):
                    for token, n in zip(one, unpack_numbers(data, np.int64).tolist(), strict=True):
                        total[token] += n
                values = [pack_numbers(np.array([total[t] for t in one], dtype=np.int64)) for one in lists]
                known = [n for n in total.values() if n]
                yield _answer([-1], [1], [b""], [pack_numbers(np.array([sum(known), len(known)], dtype=np.int64))])
            n = blocks.num_rows
            yield _answer(blocks.column("block").to_pylist(), [int(kind)] * n, blocks.column("keys").to_pylist(), values)

    placed = both.repartition("kind", "shard").sortWithinPartitions("kind", "shard")
    return placed.mapInArrow(run, "block int, kind int, keys binary, values binary")


def _answer(block: list[int], kind: list[int], keys: list[bytes], values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int32()), pa.array(kind, pa.int32()), pa.array(keys, pa.binary()), pa.array(values, pa.binary())],
        names=["block", "kind", "keys", "values"],
    )


def _down(rows: DataFrame, above: DataFrame, on: list[str], names: list[str]) -> DataFrame:
    """(names, done, left) of nodes, from those of the context one byte shorter."""
    share = F.col("left") * F.col("own")
    return rows.join(above, on).select(
        *names, (F.col("done") + share * F.col("guess")).alias("done"), (F.col("left") - share).alias("left")
    )


def score_texts(
    docs: DataFrame, depth: int = DEPTH, held_out: int = 1, folds: int = 5, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    ``score`` is log10 of the probability that the weighted byte model gives to the text: its
    words, lower-cased and joined by blanks, and its end. ``base_score`` is the same for single tokens,
    smoothed by one half. Both learn from all documents but those of the held-out fold. A null or
    empty text is an end alone; without any training document all estimates are those of no counts.

    Documents are grouped in blocks of about ``BLOCK_BYTES`` by a hash of their id. A block sends each
    gram and token that it has once, with its training count, packed by the shard of its last
    context bytes, and gets their values back once. What moves follows the distinct grams of the
    blocks, and a frequent gram costs its shard no more than a rare one per block.
    """
    spark = bounded(docs.sparkSession)
    held = crc_fold(key, folds) == held_out
    size, ends = docs.agg(F.sum(F.octet_length(text)), F.count(F.when(~held, 1))).first()
    blocks = int((size or 0) // BLOCK_BYTES) + 1
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(
        F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.col(key).alias("id"),
        F.coalesce(text, F.lit("")).cast("binary").alias("text"), held.alias("held"),
    )

    def ask(rows: pa.Table) -> pa.Table:
        out = np.array(rows.column("held").to_pylist(), dtype=bool)
        parts, counted = [], Counter()
        for first, words in _slices(rows.column("text").to_pylist()):
            stream, stops = gram_stream(words, depth)
            learned = np.repeat(~out[first : first + len(words)], np.diff(np.r_[0, stops]))
            grams, inverse = np.unique(stream, return_inverse=True)
            parts.append((grams, np.bincount(inverse, learned, len(grams))))
            for one, skipped in zip(words, out[first : first + len(words)], strict=True):
                counted.update(dict.fromkeys(one, 0) if skipped else one)
        grams, counts = merged(parts)
        shard = gram_shard(grams, shards)
        order = np.argsort(shard, kind="stable")
        found = []
        for places in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            found.append((int(shard[places[0]]), 0, pack(grams[places]), pack_numbers(counts[places])))
        named: dict[int, list[bytes]] = {}
        for token in counted:
            named.setdefault(xxhash.xxh32_intdigest(token) % shards, []).append(token)
        for number, some in named.items():
            some.sort()
            many = np.array([counted[t] for t in some], dtype=np.int64)
            found.append((number, 1, zstandard.compress(END.join(some), 1), pack_numbers(many)))
        number, kind, keys, many = zip(*found, strict=True)
        return pa.table({
            "block": pa.array([rows.column("block")[0].as_py()] * len(found), pa.int32()),
            "shard": pa.array(number, pa.int32()), "kind": pa.array(kind, pa.int32()),
            "keys": pa.array(keys, pa.binary()), "counts": pa.array(many, pa.binary()),
        })

    requests = materialize(
        source.groupBy("block").applyInArrow(ask, "block int, shard int, kind int, keys binary, counts binary"), "requests"
    )
    answered = materialize(answers(requests, depth, shards), "answers")
    sums = [unpack_numbers(r[0], np.int64) for r in answered.filter("block < 0").select("values").collect()]
    total = int(sum(x[0] for x in sums)) + ends
    kinds = int(sum(x[1] for x in sums)) + (ends > 0)
    least = float(np.log10(total + 0.5 * (kinds + 1)))

    def judge(docs: pa.Table, logs: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        names, values = [], []
        for kind, keys, data in zip(*(logs.column(c).to_pylist() for c in ("kind", "keys", "values")), strict=True):
            if kind:
                seen.update(zip(zstandard.decompress(keys).split(END), unpack_numbers(data, np.int64).tolist(), strict=True))
            else:
                names.append(unpack(keys))
                values.append(unpack_numbers(data, np.float32))
        order = np.argsort(np.concatenate(names))
        names, values = np.concatenate(names)[order], np.concatenate(values)[order].astype(np.float64)
        many, known, base, score = [], [], [], []
        for _, words in _slices(docs.column("text").to_pylist()):
            stream, stops = gram_stream(words, depth)
            logp = values[np.searchsorted(names, stream)]
            score.append(np.add.reduceat(logp, np.r_[0, stops[:-1]]) / np.log(10))
            for one in words:
                c = np.fromiter((*map(seen.__getitem__, one), ends), dtype=np.float64, count=len(one) + 1)
                many.append(len(c))
                known.append(int((c > 0).sum()))
                base.append(float((np.log10(c + 0.5) - least).sum()))
        return pa.table({
            key: docs.column("id"), "held_out": docs.column("held"), "n_tokens": pa.array(many, pa.int64()),
            "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([total] * len(many), pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(np.concatenate(score), pa.float64()),
        })

    kind = docs.schema[key].dataType.simpleString()
    return source.groupBy("block").cogroup(answered.filter("block >= 0").groupBy("block")).applyInArrow(
        judge,
        f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double",
    )
