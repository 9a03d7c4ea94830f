"""Cutting, shuffling and batching sequences."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rand import hash_int32, uniform, uniform_int
from ..functions.ranking import hash_rank
from ..functions.scalars import let
from ..session import small_batches

CHUNK_SUFFIX = r"_chunk\d+_\d+$"
PASS_THROUGH_MARGIN = 500
MAX_TRIES = 50
PIECE_TYPE = "struct<start:int,end:int>"
MIN_GENE_SCAN_LENGTH = 100
SHUFFLE_BYTES = 1 << 20


def chunk_overlap(df: DataFrame, chunk_size: int = 10000, overlap: int = 1000) -> DataFrame:
    """Overlapping chunks ``(genome, accession, start, end, seq, chunk_len)``.

    A sequence no longer than ``chunk_size`` keeps its name; a longer one is cut every
    ``chunk_size - overlap`` letters and named ``{accession}_chunk{start}_{end}``. The number of
    chunks has a closed form, so this is one projection and one explode: no shuffle.
    """
    if not 0 <= overlap < chunk_size:
        raise ValueError("overlap must be at least 0 and below chunk_size")
    step = chunk_size - overlap
    whole = F.col("_len") <= chunk_size
    last = F.when(whole, F.lit(0)).otherwise(
        F.ceil((F.col("_len") - F.lit(chunk_size)) / F.lit(step)).cast("int")
    )
    cut = (
        _as_bytes(df, F.col("accession").alias("genome"))
        .select("genome", "_bytes", "_len", F.explode(F.sequence(F.lit(0), last)).alias("_k"))
        .withColumn("start", F.col("_k") * F.lit(step))
        .withColumn("end", F.least(F.col("start") + F.lit(chunk_size), F.col("_len")))
    )
    name = F.concat("genome", F.lit("_chunk"), "start", F.lit("_"), "end")
    return cut.select(
        "genome",
        F.when(whole, F.col("genome")).otherwise(name).alias("accession"),
        "start",
        "end",
        F.substring("_bytes", F.col("start") + F.lit(1), F.col("end") - F.col("start"))
        .cast("string")
        .alias("seq"),
        (F.col("end") - F.col("start")).alias("chunk_len"),
    )


def _as_bytes(df: DataFrame, *columns: Column | str) -> DataFrame:
    """The sequence as bytes: a slice then costs its own length, while a slice of a string walks
    it from the start, which is quadratic over the chunks of a chromosome."""
    content = F.col("seq").cast("binary")
    return df.select(*columns, content.alias("_bytes"), F.octet_length("seq").alias("_len"))


def _piece(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _no_pieces() -> Column:
    return F.array().cast(f"array<{PIECE_TYPE}>")


def tile_pieces(chunk_size: int, min_length: int, seed: int) -> Column:
    """Spans of back-to-back tiles after a random offset, as an array, from ``_len``."""
    length = F.col("_len")
    offset = uniform_int(0, chunk_size, F.col("accession"), seed, "tile")
    tiles = F.transform(
        F.sequence(F.lit(0), F.ceil((length - offset) / F.lit(chunk_size)).cast("int") - F.lit(1)),
        lambda j: _piece(
            offset + j * F.lit(chunk_size),
            F.least(offset + (j + F.lit(1)) * F.lit(chunk_size), length),
        ),
    )
    pieces = F.concat(F.array(_piece(F.lit(0), offset)), tiles)
    return F.when(length <= chunk_size, F.array(_piece(F.lit(0), length))).otherwise(
        F.filter(pieces, lambda p: p["end"] - p["start"] >= min_length)
    )


def undefined_runs() -> Column:
    """Spans of undefined bases (``N``) of a sequence, as an array."""
    pieces = F.regexp_extract_all(F.col("seq"), F.lit("(N+|[^N]+)"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), _no_pieces().alias("runs"))

    def step(seen: Column, text: Column) -> Column:
        end = seen["at"] + F.length(text)
        grown = F.concat(seen["runs"], F.array(_piece(seen["at"], end)))
        return F.struct(
            end.alias("at"),
            F.when(F.startswith(text, F.lit("N")), grown).otherwise(seen["runs"]).alias("runs"),
        )

    found = F.aggregate(pieces, start, step, lambda seen: seen["runs"])
    return F.when(F.contains(F.col("seq"), F.lit("N")), found).otherwise(_no_pieces())


def uniform_pieces(
    max_size: int, min_size: int, seed: int, target_coverage: float = 1.0
) -> Column:
    """Spans of random start and length, as an array, from ``_len`` and ``_runs`` (the undefined
    spans); a span over an undefined base is drawn again.

    Only a sequence holding an undefined base needs more than the first draw.
    """
    length, runs = F.col("_len"), F.col("_runs")
    expected = length * F.lit(target_coverage) / F.lit((min_size + max_size) / 2.0)
    copies = (
        F.floor(expected)
        + F.when(
            uniform(F.col("accession"), seed, "copies") < expected - F.floor(expected), 1
        ).otherwise(0)
    ).cast("int")
    undefined = F.size(runs) > 0
    longest = F.least(F.lit(max_size), length)

    def draw(i: Column, t: Column) -> Column:
        start = uniform_int(0, length - F.lit(min_size), F.col("accession"), seed, i, t, "start")

        def from_start(s: Column) -> Column:
            largest = F.least(longest, length - s)
            size = uniform_int(min_size, largest, F.col("accession"), seed, i, t, "size")
            return _piece(s, s + size)

        return let(start, from_start)

    def defined(piece: Column) -> Column:
        return ~F.exists(
            runs, lambda run: (run["start"] < piece["end"]) & (run["end"] > piece["start"])
        )

    def first_defined(i: Column) -> Column:
        # Once a draw is kept, the later tries only pass it on.
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(MAX_TRIES)),
            F.lit(None).cast(PIECE_TYPE),
            lambda kept, t: F.when(kept.isNotNull(), kept).otherwise(
                let(draw(i, t), lambda p: F.when(defined(p), p))
            ),
        )

    every = F.sequence(F.lit(1), copies)
    drawn = F.when(undefined, F.transform(every, first_defined)).otherwise(
        F.transform(every, lambda i: draw(i, F.lit(1)))
    )
    short = F.when(undefined, _no_pieces()).otherwise(
        F.array_repeat(_piece(F.lit(0), length), copies)
    )
    return (
        F.when((length < min_size) | (copies == 0), _no_pieces())
        .when(length <= min_size + PASS_THROUGH_MARGIN, short)
        .otherwise(F.filter(drawn, lambda p: p.isNotNull()))
    )


def _cut(df: DataFrame, pieces: Column) -> DataFrame:
    """One row per span, numbered from 1 inside the sequence."""
    return df.select(
        "accession", "_bytes", F.posexplode(pieces).alias("_pos", "_p")
    ).select(
        "accession",
        (F.col("_pos") + F.lit(1)).alias("chunk_no"),
        F.col("_p.start").alias("start"),
        F.col("_p.end").alias("end"),
        F.substring(
            "_bytes", F.col("_p.start") + F.lit(1), F.col("_p.end") - F.col("_p.start")
        ).cast("string").alias("seq"),
    )


def chunk_tile(
    df: DataFrame, chunk_size: int = 10000, min_length: int = 1000, seed: int = 42
) -> DataFrame:
    return _cut(_as_bytes(df, "accession"), tile_pieces(chunk_size, min_length, seed))


def chunk_uniform_random(
    df: DataFrame,
    max_size: int = 10000,
    min_size: int = 1000,
    target_coverage: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    prepared = _as_bytes(df, "accession", undefined_runs().alias("_runs"))
    return _cut(prepared, uniform_pieces(max_size, min_size, seed, target_coverage))


def generate_chunks(
    df: DataFrame,
    chunk_size: int = 10000,
    min_length: int = 1000,
    strategy: str = "uniform-random",
    seed: int = 42,
) -> DataFrame:
    """Training chunks named ``{accession}_chunk{k}``, k from 1."""
    if strategy == "tile":
        cut = chunk_tile(df, chunk_size, min_length, seed)
    elif strategy == "uniform-random":
        cut = chunk_uniform_random(df, chunk_size, min_length, seed=seed)
    else:
        raise ValueError(f"unknown chunk strategy: {strategy}")
    name = F.concat("accession", F.lit("_chunk"), "chunk_no")
    return cut.select(
        name.alias("chunk_id"), F.col("accession").alias("parent"), "start", "end", "seq"
    )


def _shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of the column before the last, permuted by the seed in the last one, which goes. A task holds a slice
    of ``SHUFFLE_BYTES`` as letters, or one sequence."""
    multiplier, low32 = np.uint64(0x45D9F3B), np.uint64(0xFFFFFFFF)

    def mix(x):
        # A bijection on 32 bits: distinct positions get distinct sort keys.
        for _ in range(2):
            x = ((x ^ (x >> np.uint64(16))) * multiplier) & low32
        return x ^ (x >> np.uint64(16))

    def permute(seq: str | None, seed: int) -> bytes | None:
        if seq is None:
            return None
        plain = seq.isascii()
        letters = np.frombuffer(seq.encode("ascii" if plain else "utf-32-le"), dtype=np.uint8 if plain else np.uint32)
        position = np.arange(len(letters), dtype=np.uint64)
        keys = (mix(mix(position) ^ np.uint64(seed))).astype(np.uint32)
        shuffled = letters[np.argsort(keys, kind="stable")].tobytes()
        return shuffled if plain else shuffled.decode("utf-32-le").encode()

    for batch in batches:
        seqs, seeds = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        sizes = pc.fill_null(pc.binary_length(seqs), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) - sizes) // SHUFFLE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in pairwise(cuts):
            rows = zip(seqs.slice(a, b - a).to_pylist(), seeds.slice(a, b - a).to_pylist(), strict=True)
            found = pa.array([permute(seq, seed) for seq, seed in rows], pa.string())
            kept = [c.slice(a, b - a) for c in batch.columns[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, found], names=batch.schema.names[:-1])


def shuffle_sequence(df: DataFrame, seed: int = 42) -> DataFrame:
    """Seeded random permutation of the letters of each sequence."""
    small_batches(df.sparkSession)
    others = [c for c in df.columns if c != "seq"]
    seeded = df.select(*others, "seq", hash_int32(F.col("accession"), seed, "shuffle").alias("_seed"))
    return seeded.mapInArrow(_shuffled, df.select(*others, "seq").schema).select(*df.columns)


def genome_id(accession: str | Column = "accession") -> Column:
    """Chunk name to genome name."""
    return F.regexp_replace(accession, CHUNK_SUFFIX, "")


def min_length_filter(df: DataFrame, min_length: int = MIN_GENE_SCAN_LENGTH) -> DataFrame:
    return df.where(F.length("seq") >= min_length)


def fragment_size(length: str | Column, chunk_size: int) -> Column:
    column = F.col(length) if isinstance(length, str) else length
    if chunk_size <= 0:
        return F.lit(0.0)
    return column / F.lit(float(chunk_size))


def _batch_starts(
    histogram: Iterable[tuple[int, int]], batch_size: int, tolerance: int
) -> list[tuple[int, int, int]]:
    """Per length: the batch its first row goes to, and the rows already in that batch."""
    rows, batch, fill, shortest = [], -1, 0, 0
    for length, count in histogram:
        if batch < 0 or fill >= batch_size or length - shortest > tolerance:
            batch, fill, shortest = batch + 1, 0, length
        rows.append((length, batch, fill))
        filled = fill + count
        opened = (filled - 1) // batch_size
        if opened:
            batch, shortest = batch + opened, length
        fill = filled - opened * batch_size
    return rows


def length_bucket_batches(
    df: DataFrame,
    batch_size: int = 16,
    tolerance: int = 500,
    key: str = "accession",
    length: str = "chunk_len",
    seed: int = 42,
) -> DataFrame:
    """Add ``batch_id``: length-sorted batches of at most ``batch_size`` rows whose lengths differ
    by at most ``tolerance``. Equal lengths are ordered by a seeded hash of the key.

    Where batches break depends on the length histogram alone. Chunk lengths are bounded by the
    chunk size, so the histogram is small; it is walked in order and three integers are kept for
    each length. The rows themselves are ranked by ``hash_rank``, which
    splits the one dominant length (full chunks) over many tasks.
    """
    spark = df.sparkSession
    counts = df.groupBy(F.col(length).alias("_l")).agg(F.count(F.lit(1)).alias("_n")).orderBy("_l")
    starts = _batch_starts(((r["_l"], r["_n"]) for r in counts.toLocalIterator()), batch_size, tolerance)
    plan = spark.createDataFrame(
        pd.DataFrame(starts, columns=["_l", "_batch", "_fill"]).astype("int64"),
        "_l bigint, _batch bigint, _fill bigint",
    )
    ranked = hash_rank(df, [length], key, seed, "_rank")
    slot = F.col("_fill") + F.col("_rank") - F.lit(1)
    return (
        ranked.join(plan, F.col(length) == F.col("_l"))
        .withColumn("batch_id", (F.col("_batch") + F.floor(slot / F.lit(batch_size))).cast("bigint"))
        .drop("_l", "_batch", "_fill", "_rank")
    )
