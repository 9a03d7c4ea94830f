from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from seqharbor.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TABLE = pieces.ChunkTable(MODEL, most=50, longest=8)
TEXTS = [
    "", " ", "  a  b ", "plain words here", "\n\n\t x", "▁", "a▁b ▁▁c", "<s> </s> <unk> <0x41>", "日本語 テキスト 😀😀", "\x00 a\x00",
    "x" * 20000, " " * 500, "word " * 30000, "é\u0301 \u00a0\u3000z", "\ufeff\ufffd",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(text):
    ids = LIBRARY.encode(text)
    return len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\n\tab<>s/0é日😀"), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_chunks_equal_the_library(text):
    assert TABLE.digests([text]) == [want(text)]
    assert TABLE.encode([text]) == [LIBRARY.encode(text)]


def test_queries_rows_and_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", "x"), (2, TEXTS[2], "x"), (99, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = pieces.piece_digests(docs, MODEL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    found = sorted(((r[0] is None, r[0] or 0), tuple(r)[1:]) for r in got.collect())
    assert found == sorted(((i is None, i or 0), want(t or "")) for i, t, _ in rows)
    encoded = pieces.encode_documents(docs, MODEL)
    texts = {r.doc_id: r.text for r in pieces.decode_documents(encoded, MODEL).collect()}
    assert all(texts[i] == LIBRARY.decode(LIBRARY.encode(t)) for i, t in enumerate(TEXTS))
    assert pieces.piece_digests(docs.limit(0), MODEL).count() == 0


def test_decoding_null_ids(spark):
    frame = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert [r.text for r in pieces.decode_documents(frame, MODEL).collect()] == ["", ""]


def test_table_starts_anew_when_full():
    table = pieces.ChunkTable(MODEL, most=2)
    texts = ["a b c d", "a b", "e f a"]
    assert table.digests(texts) == [want(t) for t in texts] and not table.table
    with pytest.raises(Exception, match="."):
        pieces.ChunkTable("/nowhere")
