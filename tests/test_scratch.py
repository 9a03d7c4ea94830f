from __future__ import annotations

import os

import pytest

from seqharbor import session
from seqharbor.plans.checks import TableCheck, find_problems, require_unique, validate_inputs
from seqharbor.plans.predict import score_model
from seqharbor.sources.hits_json import read_hits_json


def test_a_job_removes_its_scratch_tables(spark):
    with session.scratch_run(spark, "test") as folder:
        kept = session.materialize(spark.range(5), "rows")
        assert kept.count() == 5 and os.path.isdir(folder.removeprefix("file:"))
        assert all(folder in f for f in kept.inputFiles())
    assert not os.path.exists(folder.removeprefix("file:"))
    assert session.materialize(spark.range(3), "rows").count() == 3


def test_all_problems_are_listed(spark):
    frame = spark.createDataFrame([(f"s{i}",) for i in range(30)] * 2, "accession string")
    with pytest.raises(ValueError) as error:
        require_unique(frame)
    assert all(f"duplicate key s{i} (2)" in str(error.value) for i in range(30))
    validate_inputs(spark, [TableCheck("t", frame, ["accession"])])


def test_pretty_and_broken_json(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n  "a": {"m": 1.5,\n "n": 2}\n}\n')
    rows = read_hits_json(spark, str(tmp_path / "one.json"), multi_line=True).collect()
    assert sorted(map(tuple, rows)) == [("a", "m", 1.5), ("a", "n", 2.0)]
    with pytest.raises(Exception, match="not a JSON object"):
        read_hits_json(spark, str(tmp_path / "one.json")).collect()


def test_every_fold_scores_every_chunk(spark):
    rows = [(f"c{i}", 100 + i % 7, [float(i), 1.0]) for i in range(50)]
    chunks = spark.createDataFrame(rows, "accession string, chunk_len int, x array<double>")

    def model(shift):
        def make_predict():
            return lambda x: x * 2.0 + shift

        return make_predict

    got = score_model(chunks, {"fold_0": model(0.0), "fold_1": model(1.0)}, ["x"], 4, 2, [[2]])
    found = {(r["fold"], r["accession"]): r["logits"] for r in got.collect()}
    assert found == {(f"fold_{s}", a): [v * 2 + s for v in x] for s in (0, 1) for a, _, x in rows}


def test_keys_are_checked_in_one_pass(spark, rows):
    frame = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), ("b", None), ("b", 2), ("c", 3)], "k string, n int")
    read = frame.mapInArrow(lambda batches: batches, frame.schema)
    found = find_problems(spark, [TableCheck("t", read, ["k"], ["k", "n"])])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert rows(found) == [("t", "duplicate key", "a|1", 2), ("t", "null key", "k|n", 2)]
