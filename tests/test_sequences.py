from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from seqharbor.operators import sequences as ops

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "accession string, seq string")


def loop_chunks(name, seq, size, overlap):
    """Start at 0, move on by size - overlap, stop at the first chunk that reaches the end."""
    if len(seq) <= size:
        return [(name, name, 0, len(seq), seq)]
    out, at = [], 0
    while True:
        end = min(at + size, len(seq))
        out.append((name, f"{name}_chunk{at}_{end}", at, end, seq[at:end]))
        if end == len(seq):
            return out
        at += size - overlap


def test_default_chunk_names(spark):
    df = ops.chunk_overlap(frame(spark, [("g", "A" * 44992)]))
    assert [r["accession"] for r in df.orderBy("start").collect()] == [
        "g_chunk0_10000", "g_chunk9000_19000", "g_chunk18000_28000", "g_chunk27000_37000", "g_chunk36000_44992",
    ]


def test_chunks_equal_the_loop(spark, rows):
    rng = random.Random(1)
    for size, overlap in ((10, 0), (10, 3), (10, 9), (7, 1)):
        lengths = [0, 1, size - 1, size, size + 1, 2 * size - overlap, 2 * size, 61]
        pairs = [(f"s{n}", "".join(rng.choice("ACGT") for _ in range(n))) for n in lengths]
        expected = sorted(
            [c for name, seq in pairs for c in loop_chunks(name, seq, size, overlap)], key=repr
        )
        got = rows(ops.chunk_overlap(frame(spark, pairs), size, overlap), "genome", "accession", "start", "end", "seq")
        assert got == expected


def test_chunk_arguments(spark):
    for overlap in (10, 11, -1):
        with pytest.raises(ValueError):
            ops.chunk_overlap(frame(spark, [("a", "ACGT")]), 10, overlap)


def test_tiles_cover_without_overlap(spark):
    seq = "".join(random.Random(2).choice("ACGT") for _ in range(1234))
    df = ops.chunk_tile(frame(spark, [("a", seq), ("short", "ACG")]), 100, 20, seed=7)
    found = df.where("accession = 'a'").orderBy("chunk_no").collect()
    assert [r["chunk_no"] for r in found] == list(range(1, len(found) + 1))
    assert all(a["end"] == b["start"] for a, b in zip(found, found[1:]))
    assert all(r["seq"] == seq[r["start"] : r["end"]] and len(r["seq"]) >= 20 for r in found)
    assert df.where("accession = 'short'").select("seq").first()[0] == "ACG"


def test_uniform_chunks(spark):
    rng = random.Random(3)
    clean = "".join(rng.choice("ACGT") for _ in range(5000))
    gappy = "".join("N" * 30 if i % 5 == 4 else clean[i * 300 : (i + 1) * 300] for i in range(15))
    pairs = [("clean", clean), ("gappy", gappy), ("tiny", "A" * 99), ("allN", "N" * 3000),
             ("small", "A" * 400), ("smallN", "A" * 300 + "N"), ("once", "N" * 200 + "A" * 700)]
    df = ops.chunk_uniform_random(frame(spark, pairs), 400, 100, target_coverage=3.0, seed=5)
    seqs = dict(pairs)
    found = df.collect()
    for r in found:
        assert "N" not in r["seq"] and r["seq"] == seqs[r["accession"]][r["start"] : r["end"]]
        if r["accession"] != "small":
            assert 100 <= len(r["seq"]) <= 400
    names = {r["accession"] for r in found}
    assert {"clean", "gappy", "once"} <= names and not names & {"tiny", "allN", "smallN"}
    assert {r["seq"] for r in found if r["accession"] == "small"} == {"A" * 400}
    count = sum(r["accession"] == "clean" for r in found)
    assert count in (60, 61)  # 5000 * 3 / 250


def test_generate_chunks(spark):
    df = frame(spark, [("a", "ACGT" * 500)])
    assert ops.generate_chunks(df, 100, 20, "tile").select("chunk_id").first()[0].startswith("a_chunk")
    with pytest.raises(ValueError, match="strategy"):
        ops.generate_chunks(df, strategy="other")


def test_shuffle_is_a_seeded_permutation(spark, rows):
    pairs = [(f"s{i}", "ACGTN" * i) for i in range(1, 30)] + [("empty", "")]
    df = frame(spark, pairs)
    once = dict(rows(ops.shuffle_sequence(df, 1)))
    assert once == dict(rows(ops.shuffle_sequence(df.repartition(5), 1)))
    assert all(sorted(once[name]) == sorted(seq) for name, seq in pairs)
    assert once["s20"] != "ACGTN" * 20 and once != dict(rows(ops.shuffle_sequence(df, 2)))


def test_genome_id(spark):
    names = ["a_chunk0_10", "a_chunk0_10_chunk5_6", "a_chunk1", "b"]
    df = spark.createDataFrame([(n,) for n in names], "accession string")
    assert [r[0] for r in df.select(ops.genome_id()).collect()] == ["a", "a_chunk0_10", "a_chunk1", "b"]


def greedy(lengths, batch_size, tolerance):
    batches = []
    for n in sorted(lengths):
        if batches and len(batches[-1]) < batch_size and n - batches[-1][0] <= tolerance:
            batches[-1].append(n)
        else:
            batches.append([n])
    return batches


@SLOW
@given(
    lengths=st.lists(st.integers(1, 40), min_size=1, max_size=60),
    batch=st.integers(1, 7),
    tolerance=st.integers(0, 12),
)
def test_batches_equal_the_loop(spark, lengths, batch, tolerance):
    df = spark.createDataFrame([(f"c{i}", n) for i, n in enumerate(lengths)], "accession string, chunk_len int")
    found = ops.length_bucket_batches(df, batch, tolerance).collect()
    got: dict[int, list[int]] = {}
    for r in found:
        got.setdefault(r["batch_id"], []).append(r["chunk_len"])
    assert [sorted(got[b]) for b in sorted(got)] == greedy(lengths, batch, tolerance)


def test_fragment_size_and_min_length(spark):
    df = frame(spark, [("a", "A" * 99), ("b", "A" * 100)])
    assert [r["accession"] for r in ops.min_length_filter(df).collect()] == ["b"]
    sized = spark.createDataFrame([(50,)], "n int")
    assert sized.select(ops.fragment_size("n", 200)).first()[0] == 0.25
    assert sized.select(ops.fragment_size("n", 0)).first()[0] == 0.0
