"""Ranked lexical search: term at a time with a limit on accumulators, over shards of documents.

The postings of the queries' terms are written once, by document. A task turns its documents into
inverted lists, shard by shard, and for each query adds up the lists, rarest term first. New
accumulators are created only while the terms that remain could lift a new document to the k-th best
score so far; after that only the accumulators that exist are updated, exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .common import bounded, free_prefix, materialize, slices_by_bytes

TOP = 50
SLICE_BYTES = 4 << 20  # texts taken apart at once
SHARD_POSTINGS = 1 << 20  # postings of a shard, beyond one document's own
QUERY_BYTES = 4 << 20  # texts of the queries that one pass answers
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return _TERM.findall(text.translate(_FOLD))


def postings(docs: DataFrame, wanted: list[bytes], text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n`` (terms of the document), ``term_ids`` and ``tfs`` of the wanted terms."""
    kept = [c for c in docs.columns if c != text]
    names = ("n", "term_ids", "tfs")
    schema = T.StructType([*[docs.schema[c] for c in kept]])
    schema = schema.add("n", T.LongType()).add("term_ids", T.ArrayType(T.IntegerType())).add("tfs", T.ArrayType(T.IntegerType()))
    assert not set(names) & set(kept)
    known = docs.sparkSession.sparkContext.broadcast(wanted)

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {t: i for i, t in enumerate(known.value)}
        for part, texts in slices_by_bytes(batches, text, SLICE_BYTES):
            lengths, starts, found, often = [], [0], [], []
            for value in texts:
                words = terms(value)
                counts = Counter(map(ids.get, words))
                counts.pop(None, None)
                lengths.append(len(words))
                found.extend(counts)
                often.extend(counts.values())
                starts.append(len(found))
            at = pa.array(starts, pa.int32())
            columns = [part.column(part.schema.get_field_index(c)) for c in kept]
            columns += [
                pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(found, pa.int32())),
                pa.ListArray.from_arrays(at, pa.array(often, pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return docs.mapInArrow(take_apart, schema)


class Best:
    """The best ``top`` (score, key) of a query: highest score, then smallest key, null last."""

    def __init__(self, top: int):
        self.top, self.rows, self.least = top, [], 0

    def offer(self, scores: np.ndarray, keys: list) -> None:
        rows = self.rows + [(-int(s), k is None, k) for s, k in zip(scores, keys, strict=True)]
        self.rows = sorted(rows, key=lambda r: (r[0], r[1], r[2] if r[2] is not None else 0))[: self.top]
        if len(self.rows) == self.top:
            self.least = -self.rows[-1][0]


def search_shard(lists: dict, query: list[int], size: int, best: Best) -> tuple[np.ndarray, np.ndarray]:
    """Documents (positions in the shard) that may be among the best of a query, and their exact scores.

    ``lists[term]`` is (ascending positions, what the term adds to each, the most it adds); ``query`` has the
    terms rarest first. A document without an accumulator can reach the sum of the most that the remaining
    terms add: below the k-th best score known so far it cannot enter, ties included.
    """
    todo = [lists[t] for t in query if t in lists]
    remaining = np.cumsum([most for _, _, most in todo][::-1])[::-1] if todo else []
    score = np.zeros(size, dtype=np.int64)
    alive, threshold = None, best.least
    for (at, adds, _), rest in zip(todo, remaining, strict=True):
        if alive is None:
            # the k-th best partial score: a bound from below, as scores only grow
            if score.size > best.top and threshold <= rest < score.max():
                threshold = max(threshold, int(np.partition(score, -best.top)[-best.top]))
            if threshold > rest:
                alive = np.flatnonzero(score)
        if alive is None:
            score[at] += adds
        elif alive.size:
            place = np.searchsorted(at, alive)
            place[place == at.size] = 0
            same = at[place] == alive
            score[alive[same]] += adds[place[same]]
    found = np.flatnonzero(score) if alive is None else alive
    found = found[score[found] >= max(best.least, 1)]
    if found.size > best.top:
        found = found[score[found] >= np.partition(score[found], -best.top)[-best.top]]
    return found, score[found]


def _query_blocks(queries: DataFrame, item: str, text: str, key: str) -> tuple[DataFrame, int]:
    """The queries as a written table with a block number; a block's texts add up to about ``QUERY_BYTES``."""
    rows = queries.select(F.col(f"`{item}`").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = int(size // QUERY_BYTES) + 1
    return materialize(rows.withColumn("block", F.pmod(F.xxhash64(key, "text"), F.lit(blocks))), "query-blocks"), blocks


def search(
    docs: DataFrame, queries: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id"
) -> DataFrame:
    """(item, rank, key, score): the ``top`` documents of each query with a score above 0.

    The score is the sum over the query's distinct terms of ``w * ((10^9 tf) div (1000 tf + 20 m))`` with
    ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and ``m = 50 + (50 n N) div L``; N documents that have a term, L terms in
    them, n terms of the document, df documents with the term. Equal scores rank by key, null keys
    last. Every row of ``docs`` is a document of its own, also one that repeats a key or a text; a
    repeated query id is a query of its own under that id, ranked apart. A null or empty text has no
    terms, and an empty table no results. Queries are answered in blocks of ``QUERY_BYTES``; only a block's terms are sent to
    the tasks, and every block reads all documents.
    """
    spark = bounded(docs.sparkSession)
    mark = free_prefix(docs, "q_")
    table, blocks = _query_blocks(queries, item, text, f"{mark}item")
    table = table.withColumnRenamed(f"{mark}item", "item")
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType().add("query", T.IntegerType()).add("key", own.schema["key"].dataType).add("score", T.LongType())
    parts = [_search_block(spark, own, table, b, top, schema) for b in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    first = Window.partitionBy("query_no").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def _search_block(
    spark: SparkSession, docs: DataFrame, table: DataFrame, block: int, top: int, schema: T.StructType
) -> DataFrame:
    """The best rows of every task for the queries of one block: (query_no, item, key, score)."""
    nothing = spark.createDataFrame([], "query_no string").select(
        "query_no",
        F.lit(None).cast(table.schema["item"].dataType).alias("item"),
        F.lit(None).cast(schema["key"].dataType).alias("key"),
        F.lit(None).cast("long").alias("score"),
    )
    asked = [(r["item"], r["text"].encode()) for r in table.filter(F.col("block") == block).collect()]
    if not asked:
        return nothing
    sets = [sorted(set(terms(t))) for _, t in asked]
    wanted = sorted({t for s in sets for t in s})
    ids = {t: i for i, t in enumerate(wanted)}
    # a text's own bytes make its document frequency known before any list is built
    written = materialize(postings(docs, wanted), "postings")
    whole = written.filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not whole["docs"]:
        return nothing
    documents, length = whole["docs"], whole["terms"]
    frequency = written.select(F.explode("term_ids").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * documents + 2.0) / (2.0 * F.col("df") + 1.0)))
    weights = {r["t"]: r["w"] for r in frequency.select("t", weight.alias("w")).collect()}
    # rarest first: the weight falls as the frequency grows
    ordered = [sorted((ids[t] for t in s if ids[t] in weights), key=lambda t: (-weights[t], t)) for s in sets]
    shared = spark.sparkContext.broadcast((ordered, weights))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight_of = shared.value
        best = [Best(top) for _ in queries]
        for shard in _shards(batches):
            lists, keys = _inverted(shard, weight_of, documents, length)
            for query, kept in zip(queries, best, strict=True):
                at, score = search_shard(lists, query, len(keys), kept)
                if at.size:
                    kept.offer(score, keys.take(pa.array(at)).to_pylist())
        rows = [(q, k, -s) for q, kept in enumerate(best) for s, _, k in kept.rows]
        kind = _arrow_type(schema["key"].dataType)
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())],
            names=["query", "key", "score"],
        )

    rows = written.mapInArrow(answer, schema)
    names = spark.createDataFrame(
        [(i, item) for i, (item, _) in enumerate(asked)], T.StructType().add("query", T.IntegerType()).add("item", table.schema["item"].dataType)
    )
    joined = rows.join(F.broadcast(names), "query")  # one row for each query of a block
    return joined.select(F.concat_ws("-", F.lit(block), "query").alias("query_no"), "item", "key", "score")


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Documents in runs of about ``SHARD_POSTINGS`` postings."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch) + len(batch.column(batch.schema.get_field_index("term_ids")).flatten())
        if size >= SHARD_POSTINGS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _inverted(shard: pa.Table, weights: dict[int, int], documents: int, length: int) -> tuple[dict, pa.ChunkedArray]:
    """The shard's lists: term -> (positions, what it adds to each score, the most it adds)."""
    ids = shard.column("term_ids").combine_chunks()
    at = np.repeat(np.arange(len(ids)), np.diff(ids.offsets.to_numpy()))
    term = ids.flatten().to_numpy()
    tf = shard.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
    n = shard.column("n").to_numpy().astype(np.int64)
    m = 50 + (50 * n * documents) // length
    add = (1_000_000_000 * tf) // (1000 * tf + 20 * m[at])
    order = np.argsort(term, kind="stable")
    term, at, add = term[order], at[order], add[order]
    cuts = np.flatnonzero(np.diff(term)) + 1
    lists = {}
    for a, b in zip([0, *cuts], [*cuts, term.size], strict=True):
        if b > a:
            adds = add[a:b] * weights[int(term[a])]
            lists[int(term[a])] = (at[a:b], adds, int(adds.max()))
    return lists, shard.column("key")
