from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from seqharbor.llm import queries
from tests.llm.test_decontaminate import brute as brute_passages
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_pieces import want as brute_pieces


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with planted toxic documents, boilerplate, copies and benchmark passages."""
    rng = random.Random(11)
    path = tmp_path_factory.mktemp("tables")
    calm, foul = [f"w{i}" for i in range(400)], [f"foul{i}" for i in range(8)]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(calm) for _ in range(rng.randint(30, 90))]
        toxic = i % 5 == 3
        if toxic:
            for f in foul[:5]:
                words.insert(rng.randrange(len(words)), f)
        text = " ".join(words)
        if i % 10 == 1:
            text = "Site menu line\n" + text
        if i % 40 == 7:
            text += "\n" + item
        docs.append((i, text, "en", "src%d" % (i % 3), len(text)))
        labels.append((i, 1, int(toxic)))
    for i in range(0, 50, 5):  # exact copies, and copies with a word more
        docs.append((1000 + i, docs[i][1], "en", "src9", 1))
        docs.append((2000 + i, docs[i + 1][1] + " more", "en", "src9", 1))
    docs += [(3000, None, None, None, None), (3001, "", "en", "src0", 0), (3002, "", "en", "src0", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(3)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        after = {r.doc_id: r for r in docs.collect()}
        seen.append(name)
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "toxicity":
            gone = set(before) - set(after)
            toxic = {i for i in range(400) if i % 5 == 3}
            assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 5
            assert all(before[i] == after[i] for i in after)
        if name == "line_dedup":
            rows = [(i, r.source, r.text) for i, r in before.items()]
            assert sorted([(i, r.text) for i, r in after.items()], key=repr) == sorted([(x[0], x[3]) for x in brute_lines(rows, 0.1, 5)], key=repr)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) or r.text is None for r in after.values())
        if name == "simhash_near_dedup":
            texts = [r.text or "" for r in after.values()]
            assert len(set(texts)) == len(texts) and set(after) <= set(before)
            assert {r.text or "" for r in after.values()} >= {r.text or "" for i, r in before.items() if i < 1000}
            assert not [i for i in after if 1000 <= i < 3000]
            assert 3001 not in after and 3002 not in after and 3000 in after
        if name == "decontamination":
            items = [(1, spark.read.parquet(f"{folder}/benchmark.parquet").first().text)]
            assert set(before) == set(after)
            for i, r in after.items():
                hit = brute_passages(before[i].text, items)[1]
                assert (r.text == before[i].text) == (hit == 0) and brute_passages(r.text, items)[1] == 0
        if name == "sentencepiece":
            assert {i: tuple(r)[1:] for i, r in after.items()} == {i: brute_pieces(r.text or "") for i, r in before.items()}
    assert seen == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]


def test_run_gives_the_last_stage(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 250 < found.count() < 340


def test_clashing_columns_nulls_and_empty_tables(spark, folder):
    docs = spark.createDataFrame(
        [(1, "a b c d e f", "x", 1.5, "y", [1], "k", 2, "u"), (None, None, None, None, None, None, None, None, None), (1, "a b c d e f", "x", 1.5, "y", [1], "k", 2, "u")],
        "doc_id bigint, text string, source string, tox_score double, ld_text string, bm_starts array<int>, kept_id string, fp int, block string",
    )
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, rows, folder)
            assert got.columns == rows.columns
            want = sorted(map(repr, rows.collect()))
            # equal rows are near copies of each other: one of them stays
            want = sorted(set(want)) if stage is corpus_pipeline.drop_near_copies else want
            assert sorted(map(repr, got.collect())) == want


def test_every_query_is_registered():
    found = entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(found)
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert sentencepiece and public_tokenizers
