"""Sequence passes take slices of bounded size, and slices do not show in the results."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from catalog import views
from seqharbor.constants import BINDING_SITES
from seqharbor.operators import gene_chain as chains, genes as ops, sequences

from tests.test_genes import brute_site, scan_loop


def batch(rng, letters="ACGTACGTACGTN"):
    seqs = ["".join(rng.choice(letters) for _ in range(n)) for n in (100, 1207, 350, 0, 2, 901, 100, 3000, 101)]
    return pa.RecordBatch.from_pydict({"accession": [f"s{i}" for i in range(len(seqs))], "seq": seqs})


def test_scan_takes_sequences_together(monkeypatch):
    given, calls, found = batch(random.Random(1)), [], []
    scan = ops.scan_slice
    monkeypatch.setattr(ops, "scan_slice", lambda texts, least: calls.append(len(texts)) or scan(texts, least))
    for size in (1 << 20, 1000, 1):
        monkeypatch.setattr(ops, "SLICE_LETTERS", size)
        calls.clear()
        found.append([r for b in ops.orf_finder(90)([given]) for r in b.to_pylist()])
        assert sum(calls) == given.num_rows and (size > 1000) == (len(calls) == 1)
    assert found[0] == found[1] == found[2]
    for name, seq in zip(given["accession"].to_pylist(), given["seq"].to_pylist(), strict=True):
        own = [r for r in found[0] if r["accession"] == name]
        assert [r["idx"] for r in own] == list(range(1, len(own) + 1))
        names = ("begin_pos", "end_pos", "strand", "partial_begin", "partial_end", "start_type", "amino_acid_sequence")
        assert {tuple(r[n] for n in names) for r in own} == scan_loop(seq)


def test_sites_of_many_starts_equal_brute_force():
    rng = random.Random(2)
    cases = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(21))) for _ in range(4000)]
    cases += ["", "A" * 20, "AGGAGG" + "C" * 5, "AGGAGG" + "C" * 14, "TATATACCCCCC", "NNAGNAGGCCCC"]
    for motif, pattern, least, most in BINDING_SITES:
        cases += [m.replace(".", "T") + "C" * n for m in ops._motifs(pattern) for n in range(least - 1, most + 2)]
    cases = [c[-20:] for c in cases]
    before = np.array([["ACGTN-".index(c) for c in case.rjust(20, "-")] for case in cases], dtype=np.uint8).T
    top = len(BINDING_SITES)
    want = [top - int(site[2]) if (site := brute_site(case)) else top for case in cases]
    assert ops.first_sites(before).tolist() == want


def test_chains_do_not_depend_on_slices(monkeypatch):
    given, found = batch(random.Random(3), "AACCGGT"), []
    weights = np.random.default_rng(3).integers(-5, 6, chains.HEXAMERS + 1)
    weights[-1] = 0
    for size in (1 << 20, 1):
        monkeypatch.setattr(ops, "SLICE_LETTERS", size)
        found.append([r for b in ops.orf_finder(30, chains._chooser(weights, 60, 30))([given]) for r in b.to_pylist()])
    assert found[0] == found[1] and found[0]


def test_every_character_becomes_the_same_base(spark):
    text = "".join(chr(c) for c in range(1, 0x300)) + "€\U0001f600￿"
    given = pa.RecordBatch.from_pydict({"n": ["a", "b", "c", "d"], "t": [text, None, "", "plain Text, 7"]})
    got = [r["t"] for b in views.bases([given]) for r in b.to_pylist()]
    frame = spark.createDataFrame([(text,), (None,), ("",), ("plain Text, 7",)], "t string")
    seq = F.translate("t", *views.LETTERS)
    for pattern, base in views.OTHERS:
        seq = F.regexp_replace(seq, pattern, base)
    assert got == [r[0] for r in frame.select(seq).collect()]


def test_shuffle_holds_slices(monkeypatch):
    rng = random.Random(4)
    seqs = ["".join(rng.choices("ACGTN", k=1000)) for _ in range(200)] + [None, "", "äö€x" * 3]
    names = [f"s{i}" for i in range(len(seqs))]
    given = pa.RecordBatch.from_pydict({"accession": names, "seq": seqs, "_seed": list(range(len(seqs)))})
    whole = pa.Table.from_batches(sequences._shuffled([given]))
    monkeypatch.setattr(sequences, "SHUFFLE_BYTES", 5000)
    parts = list(sequences._shuffled([given]))
    assert pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()
    assert max(part.num_rows for part in parts[:-1]) <= 6
    for before, after in zip(seqs, whole.column("seq").to_pylist(), strict=True):
        assert after is None if before is None else sorted(after) == sorted(before)


def test_sequences_come_in_small_batches(spark):
    frame = spark.createDataFrame([(f"s{i}", "ACGT" * 25_000) for i in range(120)], "accession string, seq string").coalesce(1)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    shuffled = sequences.shuffle_sequence(frame)
    assert shuffled.count() == 120
    got = [r[0] for r in frame.mapInArrow(sizes, "n bigint").collect()]
    assert len(got) > 1 and max(got) < 8 << 20
