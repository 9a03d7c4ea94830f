"""Repeated word windows: matching statistics from an FM-index per shard of the windows that can repeat."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import bounded, materialize, sha256, slices_by_bytes
from .context_trees import _by_shard, pack, pack_numbers, unpack, unpack_numbers
from .fmindex import FMIndex

WINDOW = 20
ANCHOR = 6
BLOCK_BYTES = 8 << 20
PART_BYTES = 1 << 20
INDEX_WORDS = 200_000
HOT_RUNS = 20_000
ONCE, REPEATED, HOT = 0, 1, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes."""
    n = len(hashes) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out = out * _ODD + hashes[j : j + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


class Runs:
    """Runs of consecutive windows of one document that share their anchor.

    A window's anchor is the smallest hash among its ``ANCHOR``-word grams, at its first place.
    Windows of the same words have the same anchor hash wherever they stand, so windows can only
    be equal if their runs' ``hash`` is; two windows of one run are never equal, as their anchors
    would stand in different places.
    """

    def __init__(self, docs: list[list[bytes]], window: int = WINDOW):
        self.words = [w for d in docs for w in d]
        self.window = window
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        self.doc = np.repeat(np.arange(len(docs)), sizes)
        self.offset = np.cumsum(sizes) - sizes
        none = np.zeros(0, dtype=np.int64)
        self.start, self.many, self.hash, self.hashes = none, none, none.astype(np.uint64), None
        n = len(self.words) - window + 1
        if n < 1:
            return
        self.hashes = word_hashes(self.words)
        width = min(ANCHOR, window)
        grams = rolled(self.hashes, width)
        low, at = grams[:n].copy(), np.zeros(n, dtype=np.int64)
        for j in range(1, window - width + 1):
            less = grams[j : j + n] < low
            low[less] = grams[j : j + n][less]
            at[less] = j
        at += np.arange(n)
        whole = self.doc[:n] == self.doc[window - 1 :]
        first = whole & np.r_[True, (at[1:] != at[:-1]) | ~whole[:-1]]
        self.start = np.flatnonzero(first)
        number = np.cumsum(first)[whole] - 1
        self.many = np.bincount(number, minlength=len(self.start))
        self.hash = low[self.start]

    def segment(self, start: int, many: int) -> bytes:
        return b"\n".join(self.words[start : start + many + self.window - 1])


class Candidates:
    """The distinct segments of a block that may repeat, by shard, and where their copies stand.

    A repeated run is one segment routed by its anchor hash; the runs of a hot anchor are cut into
    single windows, routed by the hash of the whole window. Of equal segments of the block the
    first in document order is asked about, the others repeat it.
    """

    def __init__(self, runs: Runs, ids: np.ndarray, status: np.ndarray, shards: int):
        start, many, key = runs.start[status == REPEATED], runs.many[status == REPEATED], runs.hash[status == REPEATED]
        if (status == HOT).any():
            one, count = runs.start[status == HOT], runs.many[status == HOT]
            each = np.repeat(one - np.cumsum(count) + count, count) + np.arange(count.sum())
            windows = rolled(runs.hashes, runs.window)
            start, many = np.r_[start, each], np.r_[many, np.ones(len(each), dtype=np.int64)]
            key = np.r_[key, windows[each]]
        order = np.lexsort((start, runs.doc[start], ids[runs.doc[start]], key)) if len(start) else np.zeros(0, np.int64)
        self.start, self.many, self.key = start[order], many[order], key[order]
        text = [runs.segment(s, m) for s, m in zip(self.start.tolist(), self.many.tolist(), strict=True)]
        seen: dict[tuple[int, bytes], int] = {}
        first = np.array([seen.setdefault((k, t), i) for i, (k, t) in enumerate(zip(self.key.tolist(), text, strict=True))], dtype=np.int64)
        self.copies = np.flatnonzero(first != np.arange(len(first)))
        asked = np.flatnonzero(first == np.arange(len(first)))
        shard = (self.key[asked] % np.uint64(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        self.asked, self.shard = asked[by], shard[by]
        self.text = [text[i] for i in self.asked.tolist()]


def _words(texts: list[bytes]) -> list[list[bytes]]:
    return [t.split() for t in texts]


def _blocks(docs: DataFrame, key: str, text: str, shards: int, window: int) -> DataFrame:
    """One pass over the documents: compressed blocks of them (kind 0), and the anchors that each block has (kind 1)."""

    def flush(parts, number):
        ids = [i for p in parts for i in p[0]]
        rows = []
        for j, (some, texts) in enumerate(parts):
            data = zstandard.compress(b"".join(texts), 3)
            rows.append((0, j, some, [len(t) for t in texts], data, None))
        runs = Runs(_words([t for p in parts for t in p[1]]), window)
        anchors, many = np.unique(runs.hash, return_counts=True)
        shard = (anchors % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        for places in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
            rows.append((1, int(shard[places[0]]), None, None, pack(anchors[places]), pack_numbers(many[places].astype(np.uint32))))
        block = number ^ (hash((len(ids), ids[0], ids[-1])) & 0xFFFFFFFF)
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block] * len(rows), pa.int64()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()),
                pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.list_(pa.int32())),
                pa.array(columns[4], pa.binary()), pa.array(columns[5], pa.binary()),
            ],
            names=["block", "kind", "number", "ids", "sizes", "data", "counts"],
        )

    def run(batches):
        held, size, made, task = [], 0, 0, 0
        for part, texts in slices_by_bytes(batches, "text", PART_BYTES):
            task = part.column(2)[0].as_py()
            held.append((part.column(0).to_pylist(), texts))
            size += sum(map(len, texts))
            if size >= BLOCK_BYTES:
                yield flush(held, (task << 44) + (made << 32))
                held, size, made = [], 0, made + 1
        if held:
            yield flush(held, (task << 44) + (made << 32))

    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.spark_partition_id().alias("task"))
    return source.mapInArrow(
        run, "block bigint, kind int, number int, ids array<bigint>, sizes array<int>, data binary, counts binary"
    )


def _anchor_status(blocks: DataFrame, hot_runs: int) -> DataFrame:
    """(block, kind, number, data): for the anchors that a block has in a shard, whether they repeat anywhere."""

    def run(batches):
        for _, number, rows in _by_shard(batches):
            lists = [unpack(d) for d in rows.column("data").to_pylist()]
            counts = [unpack_numbers(d, np.uint32) for d in rows.column("counts").to_pylist()]
            anchors, inverse = np.unique(np.concatenate(lists), return_inverse=True)
            total = np.bincount(inverse, np.concatenate(counts), len(anchors))
            status = np.where(total > hot_runs, HOT, np.where(total > 1, REPEATED, ONCE)).astype(np.uint8)
            edges = np.cumsum([len(x) for x in lists])[:-1]
            said = [pack_numbers(x) for x in np.split(status[inverse], edges)]
            n = len(lists)
            yield pa.RecordBatch.from_arrays(
                [rows.column("block").combine_chunks(), pa.array([1] * n, pa.int32()), pa.array([int(number)] * n, pa.int32()), pa.array(said, pa.binary())],
                names=["block", "kind", "number", "data"],
            )

    asked = blocks.filter("kind = 1").select("kind", F.col("number").alias("shard"), "block", "data", "counts")
    placed = asked.repartition("kind", "shard").sortWithinPartitions("kind", "shard", "block")
    return placed.mapInArrow(run, "block bigint, kind int, number int, data binary")


def _open(block: pa.Table) -> tuple[np.ndarray, list, list[bytes]]:
    """Ids (null: the smallest number), ids as given and texts of a block, in the order of its parts."""
    order = np.argsort(block.column("number").to_numpy())
    given, texts = [], []
    for i in order.tolist():
        data, at = zstandard.decompress(block.column("data")[i].as_py()), 0
        given += block.column("ids")[i].as_py()
        for size in block.column("sizes")[i].as_py():
            texts.append(data[at : at + size])
            at += size
    ids = np.array([np.iinfo(np.int64).min if i is None else i for i in given], dtype=np.int64)
    return ids, given, texts


def _status_of(runs: Runs, said: pa.Table, shards: int) -> np.ndarray:
    anchors, inverse = np.unique(runs.hash, return_inverse=True)
    status = np.zeros(len(anchors), dtype=np.uint8)
    shard = (anchors % np.uint64(shards)).astype(np.int64)
    for number, data in zip(said.column("number").to_pylist(), said.column("data").to_pylist(), strict=True):
        status[shard == number] = unpack_numbers(data, np.uint8)
    return status[inverse]


def earlier_windows(keys: np.ndarray, texts: list[bytes], window: int = WINDOW) -> np.ndarray:
    """For segments in (key, document order): the windows, as bits, that an earlier one of their key has.

    Each distinct segment goes once into an FM-index; a later copy of it has all its windows
    earlier. The index is searched backwards for every window at once. A search ends at the first
    suffix with one occurrence; those that match over the whole window are located, and the
    earliest place tells the window that comes first from those that repeat it.
    """
    bits = np.zeros(len(texts), dtype=np.uint32)
    seen: dict[tuple[int, bytes], int] = {}
    symbols: dict[bytes, int] = {}
    numbers, rows, sizes = [], [], []
    for i, (key, text) in enumerate(zip(keys.tolist(), texts, strict=True)):
        words = text.split(b"\n")
        if seen.setdefault((key, text), i) != i:
            bits[i] = (1 << (len(words) - window + 1)) - 1
            continue
        numbers += [symbols.setdefault(w, len(symbols) + 2) for w in words]
        numbers.append(1)
        rows.append(i)
        sizes.append(len(words))
    text = np.array(numbers, dtype=np.int64)
    length = np.array(sizes, dtype=np.int64)
    begin = np.cumsum(length + 1) - length - 1
    many = length - window + 1
    at = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
    index = FMIndex(text, len(symbols) + 2)
    found, low, high = index.search(np.lib.stride_tricks.sliding_window_view(text, window)[at], least=2)
    if not len(found):
        return bits
    low, place = np.unique(low, return_inverse=True)
    size = np.zeros(len(low), dtype=np.int64)
    size[place] = high - low[place]
    spread = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
    where = index.locate(spread)
    earliest = np.minimum.reduceat(where, np.cumsum(size) - size)
    later = found[earliest[place] < at[found]]
    mine = np.searchsorted(begin, at[later], side="right") - 1
    np.bitwise_or.at(bits, np.array(rows)[mine], np.uint32(1) << (at[later] - begin[mine]).astype(np.uint32))
    return bits


def _ask(blocks: DataFrame, status: DataFrame, shards: int, window: int) -> DataFrame:
    """(shard, block, ...): the distinct segments that a block asks about."""

    def run(block: pa.Table, said: pa.Table) -> pa.Table:
        ids, _, texts = _open(block)
        runs = Runs(_words(texts), window)
        ask = Candidates(runs, ids, _status_of(runs, said, shards), shards)
        doc = runs.doc[ask.start[ask.asked]] if len(ask.asked) else np.zeros(0, dtype=np.int64)
        rows = []
        for places in np.split(np.arange(len(ask.asked)), np.flatnonzero(np.diff(ask.shard)) + 1) if len(ask.asked) else []:
            at = ask.asked[places]
            rows.append((
                int(ask.shard[places[0]]), pack(ask.key[at]), pack_numbers(ids[doc[places]]),
                pack_numbers(doc[places].astype(np.int32)), pack_numbers(ask.start[at].astype(np.int32)),
                zstandard.compress(b"\r".join([ask.text[i] for i in places.tolist()]), 3),
            ))
        name = block.column("block")[0].as_py()
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.table({
            "kind": pa.array([0] * len(rows), pa.int32()), "shard": pa.array(columns[0], pa.int32()),
            "block": pa.array([name] * len(rows), pa.int64()),
            **{c: pa.array(v, pa.binary()) for c, v in zip(("keys", "ids", "docs", "starts", "texts"), columns[1:], strict=True)},
        })

    return blocks.filter("kind = 0").groupBy("block").cogroup(status.groupBy("block")).applyInArrow(
        run, "kind int, shard int, block bigint, keys binary, ids binary, docs binary, starts binary, texts binary"
    )


def _judge(asked: DataFrame, window: int) -> DataFrame:
    """(block, number, data): the bits of every segment asked about, in the order of asking."""

    def run(batches):
        for _, number, rows in _by_shard(batches):
            keys = [unpack(d) for d in rows.column("keys").to_pylist()]
            sizes = [len(k) for k in keys]
            key = np.concatenate(keys)
            column = lambda c, kind: np.concatenate([unpack_numbers(d, kind) for d in rows.column(c).to_pylist()])
            ids, docs, starts = column("ids", np.int64), column("docs", np.int32), column("starts", np.int32)
            block = np.repeat(rows.column("block").to_numpy(), sizes)
            texts = [t for d in rows.column("texts").to_pylist() for t in zstandard.decompress(d).split(b"\r")]
            order = np.lexsort((starts, docs, block, ids, key))
            words = np.array([t.count(b"\n") + 2 for t in texts], dtype=np.int64)[order]
            # whole keys together in each index
            edge = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            filled = (np.cumsum(words)[edge] - words[edge]) // INDEX_WORDS
            cuts = edge[np.flatnonzero(np.r_[True, filled[1:] != filled[:-1]])]
            bits = np.zeros(len(key), dtype=np.uint32)
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                part = order[a:b]
                bits[part] = earlier_windows(key[part], [texts[i] for i in part.tolist()], window)
            said = [pack_numbers(x) for x in np.split(bits, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays(
                [rows.column("block").combine_chunks(), pa.array([int(number)] * len(said), pa.int32()), pa.array(said, pa.binary())],
                names=["block", "number", "data"],
            )

    placed = asked.repartition("kind", "shard").sortWithinPartitions("kind", "shard", "block")
    return placed.mapInArrow(run, "block bigint, number int, data binary")


def removed_words(
    docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", keep_text: bool = False,
    hot_runs: int = HOT_RUNS,
) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256), and with ``keep_text`` the kept words joined by blanks.

    A word goes if a window of ``window`` words covers it whose words also start earlier: in a
    document of a smaller id or before in the same one. Windows are judged on the input. Null and
    wordless texts have no words. Ids are longs; a null id comes before all others, and of rows
    that repeat an id an earlier one in the table's blocks comes first.

    The documents are read once into compressed blocks. What moves by shard are the blocks' anchor
    hashes, then the distinct segments whose anchor repeats anywhere, each a few words longer than
    a window. The windows of an anchor with over ``hot_runs`` runs travel by their own hash, so a shard
    meets a hot window once per block. Each shard indexes its segments and answers with bits.
    """
    spark = bounded(docs.sparkSession)
    if not 1 < window <= 32:
        raise ValueError("a window has 2 to 32 words")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = materialize(_blocks(docs, key, text, shards, window), "blocks")
    status = materialize(_anchor_status(blocks, hot_runs), "anchor-status")
    judged = materialize(_judge(_ask(blocks, status, shards, window), window), "segment-bits")
    both = status.union(judged.select("block", F.lit(2).alias("kind"), "number", "data"))
    kind = docs.schema[key].dataType.simpleString()

    def run(block: pa.Table, said: pa.Table) -> pa.Table:
        ids, given, texts = _open(block)
        runs = Runs(_words(texts), window)
        kinds = said.column("kind").to_numpy()
        ask = Candidates(runs, ids, _status_of(runs, said.filter(pa.array(kinds == 1)), shards), shards)
        bits = np.zeros(len(ask.start), dtype=np.uint64)
        bits[ask.copies] = (np.uint64(1) << ask.many[ask.copies].astype(np.uint64)) - np.uint64(1)
        answer = said.filter(pa.array(kinds == 2))
        for number, data in zip(answer.column("number").to_pylist(), answer.column("data").to_pylist(), strict=True):
            bits[ask.asked[ask.shard == number]] = unpack_numbers(data, np.uint32)
        change = np.zeros(len(runs.words) + 1, dtype=np.int64)
        for j in range(int(ask.many.max()) if len(ask.many) else 0):
            at = ask.start[(bits >> np.uint64(j)) & np.uint64(1) == 1] + j
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
        stays = np.cumsum(change[:-1]) == 0
        counts = np.bincount(runs.doc[~stays], minlength=len(texts)) if len(stays) else np.zeros(len(texts), dtype=np.int64)
        sizes = np.bincount(runs.doc, minlength=len(texts))
        kept = []
        for first, size, gone in zip(runs.offset.tolist(), sizes.tolist(), counts.tolist(), strict=True):
            words = runs.words[first : first + size]
            kept.append(b" ".join([w for w, s in zip(words, stays[first : first + size].tolist(), strict=True) if s] if gone else words))
        out = {key: pa.array(given), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(counts, pa.int64()),
               "kept_sha256": pa.array([sha256(k) for k in kept])}
        if keep_text:
            out["kept_text"] = pa.array([k.decode() for k in kept])
        return pa.table(out | {key: pa.array(given, pa.int64())})

    schema = f"`{key}` bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if keep_text else "")
    out = blocks.filter("kind = 0").groupBy("block").cogroup(both.groupBy("block")).applyInArrow(run, schema)
    return out if kind == "bigint" else out.withColumn(key, F.col(key).cast(kind))
