"""Genes on chunks: scan, translation, numbering, context, architecture features.

The gene table ``(accession, idx, begin_pos, end_pos, strand, aa_len, motif, score)`` is the
contract: genes called elsewhere can be supplied in its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import (
    ARCH_FEATURES,
    BACTEROIDETES_MOTIFS,
    BINDING_SITES,
    CANONICAL_SD_MOTIFS,
    CODON_AMINO_ACIDS,
    CODON_BASES,
    START_CODONS,
    TATATA_MOTIFS,
    TRANSLATION_TABLE,
)
from ..functions.ranking import blocked_rank
from ..functions.scalars import null_to_nan
from .sequences import fragment_size, min_length_filter

MIN_RESIDUES = 90
MIN_ORF_BASES = 90
UPSTREAM = 20  # bases before a start codon that may hold its binding site
GENE_ROWS = 20_000  # genes that a task sends on at once
SLICE_LETTERS = 1 << 20  # letters that a task scans at once
GENE_BLOCK = 4096  # genes (or, for numbering, kilobases) per window block

ORF_SCHEMA = (
    "accession string, idx int, begin_pos int, end_pos int, strand int, partial_begin boolean, "
    "partial_end boolean, start_type string, amino_acid_sequence string, rbs_motif string, rbs_spacer string, "
    "rbs_score double"
)


def codon_table() -> dict[str, str]:
    codons = [a + b + c for a in CODON_BASES for b in CODON_BASES for c in CODON_BASES]
    return dict(zip(codons, CODON_AMINO_ACIDS))


def reverse_complement(seq: str | Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def translate_codons(cds: str | Column) -> Column:
    """Nucleotides to amino acids, codon by codon; a codon with another letter is X."""
    table = F.create_map(*[F.lit(part) for pair in codon_table().items() for part in pair])
    codons = F.regexp_extract_all(cds, F.lit("(...)"), F.lit(1))
    return F.array_join(
        F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), ""
    )


@dataclass(frozen=True)
class Scan:
    """The open frames of a slice of sequences, by sequence, begin, end and strand, and the codons that they were found in.

    ``codons`` numbers the codons of one strand after the other, of each sequence its three frames; ``stops`` are the
    ends of these runs. A frame holds the codons from ``first`` up to ``last``.
    """

    codons: np.ndarray
    stops: np.ndarray
    sequence: np.ndarray
    low: np.ndarray
    high: np.ndarray
    strand: np.ndarray
    edge5: np.ndarray
    edge3: np.ndarray
    first: np.ndarray
    last: np.ndarray
    site: np.ndarray

    def take(self, places: np.ndarray) -> Scan:
        part = {f.name: getattr(self, f.name)[places] for f in fields(self)[2:]}
        return Scan(self.codons, self.stops, **part)


def _codon_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By codon number (letters ACGT and any other, base 5): residue, whether it opens, name."""
    names = [a + b + c for a in "ACGTN" for b in "ACGTN" for c in "ACGTN"]
    table = codon_table()
    residue = np.array([ord(table.get(name, "X")) for name in names], dtype=np.uint8)
    return residue, np.array([name in START_CODONS for name in names]), np.array([*names, "Edge"], dtype=object)


def _motifs(pattern: str) -> list[str]:
    """The plain motifs, with dots, that a binding site's pattern stands for."""
    parts = pattern.strip("()").split("|")
    return [m for part in parts for m in ([part[:-2], part[:-1]] if part.endswith("?") else [part])]


def first_sites(before: np.ndarray) -> np.ndarray:
    """``binding_site`` for many starts at once: the place of the site in ``BINDING_SITES``, their number if there is none.

    ``before`` has a column for each start: the numbers of the ``UPSTREAM`` letters before it, ACGT as 0 to 3,
    other letters 4, none 5.
    """
    equal = {letter: before == i for i, letter in enumerate("ACGT")} | {".": before < 5}
    known: dict[str, np.ndarray] = {}

    def places(motif: str) -> np.ndarray:
        if motif not in known:
            wide = UPSTREAM - len(motif) + 1
            known[motif] = np.logical_and.reduce([equal[letter][i : i + wide] for i, letter in enumerate(motif)])
        return known[motif]

    found = np.full(before.shape[1], len(BINDING_SITES), dtype=np.int64)
    for place in range(len(BINDING_SITES) - 1, -1, -1):
        _, pattern, least, most = BINDING_SITES[place]
        here = np.zeros(len(found), dtype=bool)
        for motif in _motifs(pattern):
            end = UPSTREAM - len(motif)
            here |= places(motif)[max(0, end - most) : max(0, end - least + 1)].any(axis=0)
        found[here] = place
    return found


def scan_slice(texts: list[bytes], min_bases: int) -> Scan:
    """Open frames of all sequences at once: the codons of a frame lie one after the other, so that each
    stretch between stop codons is a piece of one array."""
    base = np.full(256, 4, dtype=np.uint8)
    base[[ord(letter) for letter in "ACGT"]] = range(4)
    residue, opens, _ = _codon_tables()
    length = np.array([len(t) for t in texts], dtype=np.int64)
    end = np.cumsum(length)
    forward = base[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    size = len(forward)
    found, strands, before = [], [], 0
    for strand in (1, -1):
        letters = forward if strand == 1 else np.array([3, 2, 1, 0, 4], dtype=np.uint8)[forward[::-1]]
        begin = end - length if strand == 1 else size - end
        every = letters[:-2] * np.uint8(25) + letters[1:-1] * np.uint8(5) + letters[2:]
        spans = zip(begin.tolist(), (begin + length - 2).tolist(), strict=True)
        runs = [every[a + f : max(b, 0) : 3] for a, b in spans for f in range(3)]
        codons = np.concatenate([np.zeros(0, dtype=np.uint8), *runs])
        run_end = np.cumsum([len(run) for run in runs], dtype=np.int64)
        run_begin = np.concatenate([[0], run_end[:-1]]).astype(np.int64)
        # stretches: each run has one more than it has stop codons
        closed = np.flatnonzero((residue == ord("*"))[codons])
        seen = np.searchsorted(closed, run_end)
        last_of_run = np.arange(len(runs)) + seen
        first_of_run = np.concatenate([[0], last_of_run[:-1] + 1]).astype(np.int64)
        total = len(closed) + len(runs)
        edge5, edge3 = np.zeros(total, dtype=bool), np.zeros(total, dtype=bool)
        edge5[first_of_run], edge3[last_of_run] = True, True
        left, right = np.empty(total, dtype=np.int64), np.empty(total, dtype=np.int64)
        left[edge5], left[~edge5] = run_begin, closed + 1
        right[edge3], right[~edge3] = run_end, closed + 1
        run = np.repeat(np.arange(len(runs)), np.diff(seen, prepend=0) + 1)
        wide = np.flatnonzero((right - left) * 3 >= min_bases)
        left, right, edge5, edge3, run = left[wide], right[wide], edge5[wide], edge3[wide], run[wide]
        start_at = np.append(np.flatnonzero(opens[codons]), len(codons))
        first = np.where(edge5, left, start_at[np.searchsorted(start_at, left)])
        kept = np.flatnonzero((first < right - ~edge3) & ((right - first) * 3 >= min_bases))
        first, last, edge5, edge3, run = first[kept], right[kept], edge5[kept], edge3[kept], run[kept]
        sequence, offset = run // 3, run % 3 - 3 * run_begin[run]
        low, high = offset + 3 * first, offset + 3 * last  # from 0, along the strand
        at = np.arange(-UPSTREAM, 0)[:, None] + (begin[sequence] + low)
        upstream = np.where(at >= begin[sequence], letters[np.maximum(at, 0)], np.uint8(5)) if len(low) else np.zeros((UPSTREAM, 0))
        site = np.where(edge5, len(BINDING_SITES), first_sites(upstream))
        if strand == -1:
            low, high = length[sequence] - high, length[sequence] - low
        found.append((sequence, low + 1, high, np.full(len(low), strand), edge5, edge3, first + before, last + before, site))
        strands.append((codons, run_end + before))
        before += len(codons)
    codons, stops = (np.concatenate(part) for part in zip(*strands, strict=True))
    scan = Scan(codons, stops, *[np.concatenate(part) for part in zip(*found, strict=True)])
    return scan.take(np.lexsort((scan.strand, scan.high, scan.low, scan.sequence)))


def scan_slices(batches: Iterator[pa.RecordBatch], min_bases: int) -> Iterator[tuple[pa.Array, Scan]]:
    """Names and open frames of slices of (accession, seq): sequences of ``SLICE_LETTERS`` together, or one."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) - sizes) // SLICE_LETTERS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in pairwise(cuts):
            if a < b:
                texts = [seq.encode("ascii", "replace") for seq in batch.column(1).slice(a, b - a).to_pylist()]
                yield batch.column(0).slice(a, b - a), scan_slice(texts, min_bases)


def _residues(scan: Scan, codon_residues: np.ndarray) -> pa.Array:
    sizes = scan.last - scan.first
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = codon_residues[scan.codons[np.repeat(scan.first - ends[:-1], sizes) + np.arange(ends[-1])]]
    data[ends[:-1][~scan.edge5]] = ord("M")
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def orf_finder(min_bases: int, choose=None):
    """The scan of a task. ``choose``, if given, takes a ``Scan`` and returns the places of the frames to keep, in
    their order, with their scores."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        residue, _, codon_names = _codon_tables()
        motifs = pa.array([*[site[0] for site in BINDING_SITES], ""])
        spacers = pa.array([*[f"{least}-{most}bp" for _, _, least, most in BINDING_SITES], ""])
        for names, scan in scan_slices(batches, min_bases):
            score = None
            if choose is not None:
                places, score = choose(scan)
                scan = scan.take(places)
            idx = np.arange(len(scan.sequence)) - np.searchsorted(scan.sequence, scan.sequence) + 1
            for a in range(0, len(idx), GENE_ROWS):
                rows = np.arange(a, min(a + GENE_ROWS, len(idx)))
                genes, none = scan.take(rows), scan.site[rows] == len(BINDING_SITES)
                forward = genes.strand == 1
                columns = {
                    "accession": names.take(pa.array(genes.sequence)),
                    "idx": pa.array(idx[rows], pa.int32()),
                    "begin_pos": pa.array(genes.low, pa.int32()),
                    "end_pos": pa.array(genes.high, pa.int32()),
                    "strand": pa.array(genes.strand, pa.int32()),
                    "partial_begin": pa.array(np.where(forward, genes.edge5, genes.edge3)),
                    "partial_end": pa.array(np.where(forward, genes.edge3, genes.edge5)),
                    "start_type": pa.array(codon_names[np.where(genes.edge5, 125, genes.codons[genes.first])], pa.string()),
                    "amino_acid_sequence": _residues(genes, residue),
                    "rbs_motif": motifs.take(pa.array(genes.site)),
                    "rbs_spacer": spacers.take(pa.array(genes.site)),
                    "rbs_score": pa.array((len(BINDING_SITES) - genes.site).astype(np.float64), mask=none),
                }
                if score is not None:
                    columns["coding_score"] = pa.array(score[rows], pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

    return find


def binding_site(upstream: str | Column) -> Column:
    """(motif, spacer, score) of the strongest binding site in the bases before a start codon, or null.

    ``BINDING_SITES`` are tried in their order: a motif with so many bases between it and the start. The
    score counts from 1 for the weakest.
    """
    bases = F.col(upstream) if isinstance(upstream, str) else upstream
    chain = None
    for place, (motif, pattern, least, most) in enumerate(BINDING_SITES):
        found = F.struct(
            F.lit(motif).alias("motif"),
            F.lit(f"{least}-{most}bp").alias("spacer"),
            F.lit(float(len(BINDING_SITES) - place)).alias("score"),
        )
        here = F.rlike(bases, F.lit(f"{pattern}.{{{least},{most}}}$"))
        chain = F.when(here, found) if chain is None else chain.when(here, found)
    return chain


def orf_scan(chunks: DataFrame, min_bases: int = MIN_ORF_BASES, choose=None) -> DataFrame:
    """Open reading frames of both strands and all frames, one row each.

    In each frame a stretch between stop codons yields the gene from its first start codon to
    its stop. A stretch cut by the chunk's edge runs from or to that edge and is marked partial.
    Sequences under 100 letters have none. Overlapping frames all stay, unless ``choose`` picks among them
    (``gene_chain``); its scores come as ``coding_score``. The binding site is the
    strongest one in the bases before the start codon (what ``binding_site`` gives); genes that begin at an edge have
    none. Genes are numbered by position where they are found, so the scan is map-only: neither chunks
    nor genes are shuffled.
    """
    inputs = min_length_filter(chunks.select("accession", "seq"))
    schema = ORF_SCHEMA if choose is None else f"{ORF_SCHEMA}, coding_score bigint"
    orfs = inputs.mapInArrow(orf_finder(min_bases, choose), schema)
    site = ["rbs_motif", "rbs_spacer", "rbs_score"]
    return orfs.select(
        *[c for c in orfs.columns if c not in site],
        F.concat("accession", F.lit("_"), "idx").alias("protein_id"),
        F.length("amino_acid_sequence").alias("aa_len"),
        *site,
        F.lit(TRANSLATION_TABLE).alias("translation_table"),
    )


def gene_table(orfs: DataFrame) -> DataFrame:
    """Numbered open reading frames in the gene table's form."""
    return orfs.select(
        "accession",
        "idx",
        "begin_pos",
        "end_pos",
        "strand",
        "aa_len",
        F.nullif("rbs_motif", F.lit("")).alias("motif"),
        F.col("rbs_score").alias("score"),
    )


def protein_table(orfs: DataFrame) -> DataFrame:
    return orfs.select(
        "protein_id",
        "amino_acid_sequence",
        F.col("begin_pos").alias("protein_start"),
        F.col("end_pos").alias("protein_end"),
        F.col("strand").alias("protein_strand"),
        "partial_begin",
        "partial_end",
        "start_type",
        "rbs_motif",
        "rbs_spacer",
        "translation_table",
    )


def number_proteins(genes: DataFrame) -> DataFrame:
    """Add ``idx`` (from 1 by position, all genes) and ``protein_id`` = ``{accession}_{idx}`` to a
    supplied gene table."""
    ranked = blocked_rank(
        genes,
        ["accession"],
        F.floor(F.col("begin_pos") / F.lit(GENE_BLOCK * 1000)),
        ["begin_pos", "end_pos", "strand"],
        "idx",
    )
    return ranked.withColumn("idx", F.col("idx").cast("int")).withColumn(
        "protein_id", F.concat("accession", F.lit("_"), "idx")
    )


def classify_rbs(motif: str | Column = "motif") -> dict[str, Column]:
    """Membership of a motif in the three groups. Missing or empty is in none."""
    shown = F.upper(F.col(motif) if isinstance(motif, str) else motif)
    groups = {
        "bacteroidetes": BACTEROIDETES_MOTIFS,
        "canonical": CANONICAL_SD_MOTIFS,
        "tatata": TATATA_MOTIFS,
    }
    return {
        f"is_{name}_rbs": F.coalesce(shown.isin(members), F.lit(False))
        for name, members in groups.items()
    }


def _context_by_blocks(
    genes: DataFrame, remembered: dict, running: dict, kept: Column
) -> DataFrame:
    blocked = genes.withColumn(
        "_block", F.floor((F.col("idx") - F.lit(1)) / F.lit(GENE_BLOCK)).cast("int")
    )
    before = (
        Window.partitionBy("accession", "_block")
        .orderBy("idx")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier_blocks = (
        Window.partitionBy("accession").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        blocked.groupBy("accession", "_block")
        .agg(
            *[
                F.max_by(value, F.when(where, F.col("idx"))).alias(name)
                for name, (value, where) in remembered.items()
            ]
        )
        .select(
            "accession",
            "_block",
            *[F.last(name, True).over(earlier_blocks).alias(f"{name}_c") for name in remembered],
        )
        .where("_block > 0")
    )
    return (
        blocked.withColumns({name: value.over(before) for name, value in running.items()})
        .where(kept)
        .join(carried, ["accession", "_block"], "left")
        .withColumns({name: F.coalesce(name, f"{name}_c") for name in remembered})
    )


def most_orfs(chunk_size: int, min_bases: int = MIN_ORF_BASES) -> int:
    """Most open reading frames a chunk can have: six frames of back-to-back stretches."""
    return 6 * (chunk_size // min_bases + 1)


def gene_context(
    genes: DataFrame, min_residues: int = MIN_RESIDUES, most_genes: int | None = None
) -> DataFrame:
    """Kept genes with their position flags.

    The previous stop on a strand counts genes dropped for length; the previous strand does not.
    Both are running values over one sort by ``idx``. Unless ``most_genes`` promises that a chunk
    has no more than a block of them, genes are cut into blocks of 4096, and what a block must
    know of the earlier ones travels in one small row per block.
    """
    kept = F.col("aa_len") >= min_residues
    remembered = {
        "_end_fwd": (F.col("end_pos"), F.col("strand") == 1),
        "_end_rev": (F.col("end_pos"), F.col("strand") == -1),
        "_strand_kept": (F.col("strand"), kept),
    }
    running = {
        name: F.last(F.when(where, value), True) for name, (value, where) in remembered.items()
    }
    if most_genes is not None and most_genes <= GENE_BLOCK:
        whole = Window.partitionBy("accession").orderBy("idx")
        before = whole.rowsBetween(Window.unboundedPreceding, -1)
        seen = genes.withColumns({n: value.over(before) for n, value in running.items()}).where(kept)
    else:
        seen = _context_by_blocks(genes, remembered, running, kept)
    start0 = F.col("begin_pos") - F.lit(1)
    previous_end = F.when(F.col("strand") == 1, F.col("_end_fwd")).otherwise(F.col("_end_rev"))
    has_rbs = F.coalesce(F.col("motif") != "", F.lit(False))
    return seen.select(
        "accession",
        "idx",
        start0.alias("start"),
        F.col("end_pos").alias("end"),
        "strand",
        F.col("aa_len").alias("length"),
        (start0 <= 2).alias("leaderless"),
        (start0 - F.coalesce(previous_end, F.lit(-3)) <= 3).alias("short_utr"),
        F.coalesce(F.col("strand") != F.col("_strand_kept"), F.lit(False)).alias("strand_switch"),
        has_rbs.alias("has_rbs"),
        F.when(has_rbs, F.upper("motif")).otherwise("").alias("rbs_motif"),
        F.when(has_rbs, F.col("score").cast("double")).otherwise(F.lit(0.0)).alias("rbs_score"),
        *[flag.alias(name) for name, flag in classify_rbs("motif").items()],
    )


def arch_features(
    chunks: DataFrame, context: DataFrame, chunk_size: int = 10000, with_lengths: bool = False
) -> DataFrame:
    """One row of architecture features per chunk, from its kept genes.

    ``chunks`` needs ``accession`` and ``chunk_len`` only, so sequences stay out of the shuffle.
    Undefined features are NULL. ``with_lengths`` adds the median and maximum gene length.
    """
    share = lambda flag: F.sum(F.when(F.col(flag), 1.0).otherwise(0.0))
    lengths = (
        [
            F.median("length").cast("double").alias("median_orf_length"),
            F.max("length").cast("double").alias("max_orf_length"),
        ]
        if with_lengths
        else []
    )
    per_chunk = context.groupBy("accession").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("end") - F.col("start")).alias("_coding"),
        share("strand_switch").alias("_switch"),
        share("leaderless").alias("_leaderless"),
        share("short_utr").alias("_short"),
        share("has_rbs").alias("_rbs"),
        share("is_bacteroidetes_rbs").alias("_bact"),
        share("is_canonical_rbs").alias("_sd"),
        share("is_tatata_rbs").alias("_tata"),
        F.avg(F.when(F.col("has_rbs"), F.col("rbs_score"))).alias("_score"),
        F.sum(F.when(F.col("strand") == 1, 1).otherwise(0)).alias("_fwd"),
        *lengths,
    )
    joined = chunks.select("accession", "chunk_len").join(per_chunk, "accession", "left")
    n, length = F.col("_n"), F.col("chunk_len")
    some, many = n >= 1, n >= 2

    def per_kb(count: Column) -> Column:
        return F.when(many, F.when(length > 0, count / (length / 1000.0)).otherwise(0.0))

    features = {
        "fragment_size": fragment_size("chunk_len", chunk_size),
        "strand_switch_rate": F.when(many, F.col("_switch") / n),
        "coding_density": F.when(some & (length > 0), F.col("_coding") / length).otherwise(0.0),
        "leaderless_freq": F.when(many, F.col("_leaderless") / n),
        "short_utr_freq": F.when(many, F.col("_short") / n),
        "no_rbs_freq": F.when(some, (n - F.col("_rbs")) / n),
        "sd_bacteroidetes_rbs_freq": F.when(some, F.col("_bact") / n),
        "sd_canonical_rbs_freq": F.when(some, F.col("_sd") / n),
        "tatata_rbs_freq": F.when(some, F.col("_tata") / n),
        "mean_rbs_score": F.when(some, F.coalesce(F.col("_score") / 100.0, F.lit(0.0))),
        "gene_density": per_kb(n),
        "gene_density_fwd": per_kb(F.col("_fwd")),
        "gene_density_rev": per_kb(n - F.col("_fwd")),
    }
    return joined.select(
        "accession",
        *[features[name].cast("double").alias(name) for name in ARCH_FEATURES],
        F.coalesce(n, F.lit(0)).cast("bigint").alias("n_genes"),
        *(["median_orf_length", "max_orf_length"] if with_lengths else []),
    )


def feature_vector(features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(accession, vector)`` in the given order, float32, NaN for undefined."""
    order = names or [*ARCH_FEATURES, "n_genes"]
    missing = [name for name in order if name not in features.columns]
    if missing:
        raise ValueError(f"unknown features: {missing}")
    return features.select(
        "accession",
        F.array(*[null_to_nan(F.col(c).cast("double")).cast("float") for c in order]).alias("vector"),
    )
