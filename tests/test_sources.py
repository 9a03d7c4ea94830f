from __future__ import annotations

import json

import pytest

from seqharbor.operators import training
from seqharbor.sources import fasta, hits_json, models, reports, tables


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_fasta_forms(spark, rows, tmp_path):
    write(tmp_path / "a.fasta", ">s1 first > one\r\nacgt\r\nAC GT\r\n>s2\n>s3\tdesc\nNNNN\n")
    write(tmp_path / "b.fasta", "\n> s4 padded\nac\n\ngt\n")
    found = fasta.read_fasta(spark, str(tmp_path))
    assert rows(found) == [("s1", "ACGTACGT", 8), ("s2", "", 0), ("s3", "NNNN", 4), ("s4", "ACGT", 4)]
    kept = fasta.read_fasta(spark, str(tmp_path / "a.fasta"), upper=False)
    assert rows(kept, "seq") == [("",), ("NNNN",), ("acgtACGT",)]


def test_fasta_round_trip_and_wrap(spark, rows, tmp_path):
    df = spark.createDataFrame(
        [("a", "ACGT" * 40), ("b", "A" * 80), ("c", "A" * 81), ("d", "")], "accession string, seq string"
    )
    fasta.write_fasta(df.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert max(len(line) for line in text.splitlines()) == 80
    assert text.count("\n") == 2 + 1 + 1 + 1 + 1 + 2 + 1
    assert rows(fasta.read_fasta(spark, str(tmp_path / "out")), "accession", "seq") == rows(df)


def test_protein_fasta_is_unwrapped(spark, tmp_path):
    df = spark.createDataFrame([("p_1", "M" * 300)], "protein_id string, amino_acid_sequence string")
    fasta.write_protein_fasta(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text == ">p_1\n" + "M" * 300 + "\n"


def test_marker_metadata(spark, rows, tmp_path):
    path = write(tmp_path / "m.tsv", " Marker\tSPECIFICITY_CLASS\tnote\nm1\tvv\tNA\nm2\tnan\tx\nm3\tCC\t\n")
    df = tables.read_marker_metadata(spark, path)
    assert df.columns == ["marker", "specificity_class", "note"]
    assert rows(df) == [("m1", "vv", None), ("m2", None, "x"), ("m3", "CC", None)]
    with pytest.raises(ValueError, match="specificity_class"):
        tables.read_marker_metadata(spark, write(tmp_path / "n.tsv", "marker\tother\nm\tx\n"))


def test_alignment_hits(spark, rows, tmp_path):
    good = "q_1\tm1\t1e-5\t50.5\t100\t200\t1\t90\t2\t80\t85"
    lines = [
        good,
        "",
        "q_2\tm1\t1e-5\t50",
        "q_3\tm1\t1e-5\tbad\t100\t200\t1\t90\t2\t80\t85",
        "q_4\tm1\t1e-5\t7\t100\t200\t1\tx\t2\t80\t85",
        "q_5\tm1\t1e-5\t7\t100\t200\t1\t90.0\t2\t80\t85",
        "  q_6\tm1\t1e-5\t1e2\t+5\t200\t1\t90\t2\t80\t85\textra  ",
        "q_7\tm1\t1e-5\tnan\t5\t200\t1\t90\t2\t80\t85",
    ]
    df = tables.read_alignment_hits(spark, write(tmp_path / "h.tsv", "\n".join(lines) + "\n"))
    found = {r["query"]: r for r in df.collect()}
    assert sorted(found) == ["q_1", "q_3", "q_4", "q_5", "q_6", "q_7"]
    assert found["q_1"]["evalue"] == "1e-5" and found["q_1"]["bits"] == 50.5
    assert found["q_3"]["bits"] == 1.0 and found["q_3"]["alnlen"] == 85
    for broken in ("q_4", "q_5"):
        assert [found[broken][c] for c in ("qlen", "tlen", "qend", "alnlen")] == [0, 0, 0, 0]
    assert found["q_6"]["qlen"] == 5 and found["q_6"]["bits"] == 100.0
    assert found["q_7"]["bits"] != found["q_7"]["bits"]
    assert tables.read_alignment_hits(spark, write(tmp_path / "e.tsv", "")).count() == 0


def test_feature_table(spark, rows, tmp_path):
    path = write(tmp_path / "f.tsv", "x\tid\ty\n1.5\ta\tn/a\n\tb\t-2e1\n")
    assert rows(tables.read_feature_table(spark, path)) == [("a", 1.5, 0.0), ("b", 0.0, -20.0)]
    assert rows(tables.read_feature_table(spark, path, keep_missing=True)) == [("a", 1.5, None), ("b", None, -20.0)]
    gaps = write(tmp_path / "gaps.csv", "accession,x,y\na,1.5,\nb,,nan\nc,1,2\nd,3,\n")
    kept = tables.read_feature_table(spark, gaps, ",", keep_missing=True)
    sequences = spark.createDataFrame([(x, "ACGT") for x in "abcd"], "accession string, seq string")
    labels = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x"), ("d", "y")], "accession string, label string")
    loaded = training.load_training_set(sequences, labels, kept, 0.5).select("accession", "features")
    assert rows(loaded) == [("a", [1.5, None]), ("b", [None, None]), ("c", [1.0, 2.0]), ("d", [3.0, None])]
    first = write(tmp_path / "g.tsv", "name\tx\na\t1\n")
    assert rows(tables.read_feature_table(spark, first)) == [("a", 1.0)]
    with pytest.raises(ValueError, match="no feature column"):
        tables.read_feature_table(spark, write(tmp_path / "h.tsv", "accession\na\n"))
    gate = write(tmp_path / "i.tsv", "accession\tgene_density\tother\tfragment_size\na\t1\t2\t3\n")
    assert tables.read_gate_features(spark, gate).columns == ["accession", "fragment_size", "gene_density"]
    assert tables.read_gate_features(spark, first) is None


def test_labels(spark, rows, tmp_path):
    path = write(tmp_path / "l.tsv", "acc\tkind\tmore\n1\tx\tz\n2\ty\tz\n")
    assert rows(tables.read_labels(spark, path)) == [("1", "x"), ("2", "y")]
    short = write(tmp_path / "s.tsv", "acc\tkind\n1\tx\n2\n")
    assert rows(tables.read_labels(spark, short, skip_short=True)) == [("1", "x")]
    with pytest.raises(ValueError, match="two columns"):
        tables.read_labels(spark, write(tmp_path / "c.csv", "acc,kind\n1,x\n"))
    assert rows(tables.read_labels(spark, str(tmp_path / "c.csv"), sep=",")) == [("1", "x")]


def test_hits_json(spark, rows, tmp_path):
    data = {"a": {"m1": 1.5, "m2": 2.0}, "b": {"m1": 3.0}, "c": {}}
    path = write(tmp_path / "one.json", json.dumps(data))
    expected = [("a", "m1", 1.5), ("a", "m2", 2.0), ("b", "m1", 3.0)]
    df = hits_json.read_hits_json(spark, path)
    assert rows(df) == expected
    for parts in (1, 2):
        out = str(tmp_path / f"out{parts}")
        hits_json.write_hits_json(df, out, parts)
        assert rows(hits_json.read_hits_json(spark, out)) == expected


def test_calibration(spark, tmp_path):
    path = write(
        tmp_path / "c.json",
        '{"classes": {"0": {"w0": 0.5}, "2": {"w1": -1}},'
        ' "posthoc_top_label": {"enabled": true, "target_class": 1, "w0": 0.2}}',
    )
    read = models.load_calibration(spark, path)
    assert read.weights(3) == [(0.5, 0.0), (0.0, 0.0), (0.0, -1.0)]
    assert read.length_scale == 1000.0 and read.posthoc == models.Posthoc(1, 0.2, 0.0)
    off = write(tmp_path / "d.json", '{"length_scale": 500, "posthoc_top_label": {"enabled": false}}')
    read = models.load_calibration(spark, off)
    assert read.classes is None and read.posthoc is None and read.length_scale == 500.0
    with pytest.raises(ValueError):
        models.load_calibration(spark, None)


def test_folds(spark):
    names = ["fold_10", "fold_2", "fold_x", "fold_0", "other"]
    manifest = spark.createDataFrame([(n,) for n in names], "fold string")
    assert [r[0] for r in models.load_folds(manifest).collect()] == ["fold_0", "fold_2", "fold_10", "fold_x"]
    assert models.select_folds(manifest, num_folds=2) == ["fold_0", "fold_2"]
    assert models.select_folds(manifest, fold_index=10) == ["fold_10"]
    assert models.select_folds(manifest, explicit=["fold_x", "fold_0"], num_folds=2) == ["fold_x", "fold_0"]
    for bad in ({"num_folds": 9}, {"fold_index": -1}, {"fold_index": 5}, {"explicit": ["fold_7"]}):
        with pytest.raises(ValueError):
            models.select_folds(manifest, **bad)


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 0.5), ("b", "", 1.0)], "k string, t string, v double")
    reports.write_report(df, str(tmp_path / "r"), single=True)
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))
    assert sorted(text.splitlines()) == ["a\t\t0.5", "b\t\t1.0", "k\tt\tv"]
    reports.write_report(df.limit(0), str(tmp_path / "empty"))
    text = "".join(p.read_text() for p in (tmp_path / "empty").glob("part-*"))
    assert text.strip() == "k\tt\tv"


def test_staging_checks_chunks(spark, rows, tmp_path):
    arch = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "accession string, x double")
    hits = spark.createDataFrame([("a", "m", 1.0)], "accession string, marker string, bitscore double")
    folder = str(tmp_path / "staged")
    reports.stage_features(folder, arch, hits)
    again, found = reports.load_staged_features(spark, folder, arch.select("accession"))
    assert rows(again) == rows(arch) and rows(found) == rows(hits)
    for other in ([("a",)], [("a",), ("b",), ("c",)], [("a",), ("c",)], [("a",), ("a",), ("b",)]):
        with pytest.raises(ValueError, match="chunks"):
            reports.load_staged_features(spark, folder, spark.createDataFrame(other, "accession string"))


def test_marker_ref(spark, rows, tmp_path):
    path = write(tmp_path / "ref.tsv", "fold\tmarker\tclass_code\tcutoff\nfold_0\tm1\tK\t2.5\nfold_0\tm2\t\t\n")
    df = models.load_marker_ref(spark, path, "tsv")
    assert rows(df) == [("fold_0", "m1", "K", 2.5), ("fold_0", "m2", None, None)]
