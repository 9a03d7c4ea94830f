"""Benchmark passages in documents: an FM-index per shard of a task, searched for item windows."""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded, free_prefix, slices_by_bytes
from .fmindex import FMIndex

WINDOW = 10
SHARD_BYTES = 4 << 20
PART_BYTES = 8 << 20
_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32 for b in range(256)
)
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII."""
    return text.translate(_FOLD).split()


class Patterns:
    """The distinct windows of some items: word ids by length, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set]] = {}
        for item, text in items:
            ids = [self.ids.setdefault(w, len(self.ids) + 2) for w in words(text)]
            if ids:
                size = min(window, len(ids))
                for i in range(len(ids) - size + 1):
                    by_length.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.windows = [
            (size, np.array(list(found), dtype=np.int64), [sorted(x for x in s if x is not None) for s in found.values()])
            for size, found in sorted(by_length.items())
        ]
        self.sigma = len(self.ids) + 2
        self.shortest = min(by_length, default=0)


def runs_of_known(ids: np.ndarray, doc: np.ndarray, shortest: int) -> np.ndarray:
    """Positions in runs of at least ``shortest`` benchmark words of one document: no window lies elsewhere."""
    known = ids > 1
    edge = np.r_[True, (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])]
    number = np.cumsum(edge) - 1
    return np.flatnonzero(known & (np.bincount(number)[number] >= shortest))


def search_shard(ids: np.ndarray, doc: np.ndarray, patterns: Patterns):
    """(start, end, window list, window number) of every occurrence in a shard of words."""
    kept = runs_of_known(ids, doc, patterns.shortest)
    if not len(kept):
        return []
    gap = np.r_[False, (kept[1:] != kept[:-1] + 1) | (doc[kept[1:]] != doc[kept[:-1]])]
    place = np.arange(len(kept)) + np.cumsum(gap)
    text = np.ones(place[-1] + 1, dtype=np.int64)  # 1 stands between runs
    text[place] = ids[kept]
    back = np.zeros(len(text), dtype=np.int64)
    back[place] = kept
    index = FMIndex(text, patterns.sigma)
    found = []
    for number, (size, matrix, _) in enumerate(patterns.windows):
        which, low, high = index.search(matrix)
        if len(which):
            many = high - low
            rows = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            start = back[index.locate(rows)]
            found.append((start, start + size, number, np.repeat(which, many)))
    return found


def _parts(benchmark: DataFrame, key: str, text: str, most: int):
    """The items in lists of at most ``most`` bytes, one longer item by itself, streamed."""
    held, size = [], 0
    for row in benchmark.select(F.col(key).cast("string"), F.col(text)).toLocalIterator():
        data = (row[1] or "").encode()
        if held and size + len(data) > most:
            yield held
            held, size = [], 0
        held.append((row[0], data))
        size += len(data)
    yield held


def mark_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
    item: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES, names: str = "bm_",
) -> DataFrame:
    """``docs`` with ``bm_words`` (word count), ``bm_starts``, ``bm_ends`` (merged word spans that
    benchmark windows cover) and ``bm_items`` (ids of the items with occurring windows).

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Documents
    are read once, in shards of a few MB, without a shuffle. The items are sent to the tasks in
    parts of bounded size; further parts are searched by further passes of the same job. Null
    and wordless texts have no words, items without words find nothing, an item with a null id
    marks words but is not named. Columns of ``docs`` called like the added ones are replaced.
    """
    bounded(docs.sparkSession)
    added = {f"{names}words": T.LongType(), f"{names}starts": T.ArrayType(T.IntegerType()),
             f"{names}ends": T.ArrayType(T.IntegerType()), f"{names}items": T.ArrayType(T.StringType())}
    kept = docs.drop(*added)
    empty = {f"{names}words": F.lit(0).cast("long")} | {
        c: F.array().cast(t) for c, t in added.items() if c != f"{names}words"
    }
    out, schema = kept.withColumns(empty), T.StructType(kept.schema.fields + [T.StructField(c, t) for c, t in added.items()])
    for items in _parts(benchmark, item, item_text, part_bytes):
        held = docs.sparkSession.sparkContext.broadcast((items, window))

        def run(batches, held=held, made=[]):  # noqa: B006 - the patterns of this worker
            if not made:
                made.append(Patterns(*held.value))
            for part, texts in slices_by_bytes(batches, text, SHARD_BYTES):
                yield _searched(part, texts, made[0], names)

        out = out.mapInArrow(run, schema)
    return out


def _searched(part: pa.RecordBatch, texts: list[bytes], patterns: Patterns, names: str) -> pa.RecordBatch:
    per_doc = [words(t) for t in texts]
    sizes = np.array([len(w) for w in per_doc], dtype=np.int64)
    total, first = int(sizes.sum()), np.cumsum(sizes) - sizes
    get = patterns.ids.get
    ids = np.fromiter((i for w in per_doc for i in map(get, w, repeat(1))), dtype=np.int64, count=total)
    doc = np.repeat(np.arange(len(texts)), sizes)
    column = {c: part.schema.get_field_index(f"{names}{c}") for c in ("words", "starts", "ends", "items")}
    was = {c: part.column(i) for c, i in column.items()}
    found = search_shard(ids, doc, patterns)
    starts, ends, items = (was[c] for c in ("starts", "ends", "items"))
    if found:
        named = [set(x) for x in items.to_pylist()]
        for start, _, number, which in found:
            pairs = np.unique(np.stack([doc[start], which]), axis=1)
            lists = patterns.windows[number][2]
            for d, w in pairs.T.tolist():
                named[d].update(lists[w])
        change = np.zeros(total + 1, dtype=np.int64)
        for start, end, _, _ in found:
            np.add.at(change, start, 1)
            np.add.at(change, end, -1)
        for d, (s, e) in enumerate(zip(starts.to_pylist(), ends.to_pylist(), strict=True)):
            for a, b in zip(s, e, strict=True):
                change[first[d] + a] += 1
                change[first[d] + b] -= 1
        hit = np.cumsum(change[:-1]) > 0
        edge = np.r_[True, doc[1:] != doc[:-1]]
        begin = np.flatnonzero(hit & (edge | ~np.r_[False, hit[:-1]]))
        stop = np.flatnonzero(hit & (np.r_[edge[1:], True] | ~np.r_[hit[1:], False])) + 1
        counts = np.bincount(doc[begin], minlength=len(texts))
        offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        starts = pa.ListArray.from_arrays(offsets, pa.array((begin - first[doc[begin]]).astype(np.int32)))
        ends = pa.ListArray.from_arrays(offsets, pa.array((stop - first[doc[begin]]).astype(np.int32)))
        items = pa.array([sorted(x) for x in named], pa.list_(pa.string()))
    new = {"words": pa.array(sizes), "starts": starts, "ends": ends, "items": items}
    by_place = {column[c]: v for c, v in new.items()}
    arrays = [by_place.get(i, part.column(i)) for i in range(part.num_columns)]
    return pa.RecordBatch.from_arrays(arrays, names=part.schema.names)


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each document: words, hit words, the items found and their digest."""
    marked = mark_passages(docs.select(key, "text"), benchmark)
    spans = F.zip_with("bm_ends", "bm_starts", lambda e, s: (e - s).cast("long"))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
    return marked.select(
        key,
        F.col("bm_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("bm_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("bm_items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def remove_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the merged spans cut out of their texts; a text without a hit is unchanged.

    A span goes from the first byte of its first word to the last byte of its last one; what
    stands around it stays.
    """
    columns, names = docs.columns, free_prefix(docs, "bm_")
    marked = mark_passages(docs, benchmark, text=text, names=names)
    schema = marked.schema

    def run(batches):
        for batch in batches:
            hit = [i for i, s in enumerate(batch.column(batch.schema.get_field_index(f"{names}starts")).to_pylist()) if s]
            if hit:
                at = batch.schema.get_field_index(text)
                texts = batch.column(at).to_pylist()
                starts = batch.column(batch.schema.get_field_index(f"{names}starts"))
                ends = batch.column(batch.schema.get_field_index(f"{names}ends"))
                for i in hit:
                    texts[i] = _cut(texts[i].encode(), starts[i].as_py(), ends[i].as_py()).decode()
                batch = batch.set_column(at, text, pa.array(texts, batch.column(at).type))
            yield batch

    return marked.mapInArrow(run, schema).select(*[F.col(f"`{c}`") for c in columns])


def _cut(data: bytes, starts: list[int], ends: list[int]) -> bytes:
    spans = [m.span() for m in WORD.finditer(data)]
    kept, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        kept.append(data[at : spans[s][0]])
        at = spans[e - 1][1]
    return b"".join([*kept, data[at:]])
