"""SentencePiece encoding and decoding over a table of distinct whitespace-marked chunks."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import bounded, sha256

SPACE = "▁"
TABLE_CHUNKS = 250_000
LONGEST_KEPT = 64
_CHUNK = re.compile(f"[ {SPACE}]+[^ {SPACE}]*")


class ChunkTable:
    """Segments each distinct chunk of a task once and puts ids back in the order of positions.

    A chunk is a run of whitespace marks and what follows it up to the next mark. No piece of the
    model has a mark behind another character, so no merge can cross a chunk's start and the
    chunks of a text are segmented apart exactly as in the whole text. The table holds at most
    ``most`` chunks of at most ``longest`` characters; when full it starts anew, and longer chunks
    are segmented where they stand.
    """

    def __init__(self, model: str, most: int = TABLE_CHUNKS, longest: int = LONGEST_KEPT):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        for i in range(self.model.get_piece_size()):
            if SPACE in self.model.id_to_piece(i).lstrip(SPACE):
                raise ValueError("a piece of this model crosses a whitespace mark")
        if self.model.encode(" a  b ") != self.model.encode(f"{SPACE}a{SPACE}{SPACE}b{SPACE}"):
            raise ValueError("the model's normalizer changes white space")
        self.most, self.longest = most, longest
        self.mark, self.lead = self.model.piece_to_id(SPACE), self.model.piece_to_id("a")
        self.table: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def _segment(self, chunks: list[str]) -> None:
        # the encoder puts the first mark in front by itself, but none in front of an empty text
        ids = self.model.encode([c[1:] for c in chunks], num_threads=1)
        ids = [i or [self.mark] for i in ids]
        # behind an id of its own, so that the decoder leaves the first mark
        texts = self.model.decode([[self.lead, *i] for i in ids], num_threads=1)
        for chunk, i, text in zip(chunks, ids, texts, strict=True):
            self.table[chunk] = ",".join(map(str, i))
            if text[1:] != chunk.replace(SPACE, " "):
                self.odd[chunk] = text[1:]

    def segments(self, texts: list[str]) -> list[tuple[list[str], str]]:
        """For each text: the decimal ids of its chunks in order, and the decoded text."""
        found = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        new = set().union(*found).difference(self.table)
        if new:
            self._segment(sorted(new))
        get, out = self.table.__getitem__, []
        for chunks in found:
            if self.odd:
                decoded = "".join([self.odd.get(c) or c.replace(SPACE, " ") for c in chunks])
            else:
                decoded = "".join(chunks).replace(SPACE, " ")
            # the decoder drops one leading blank, the mark that the encoder added
            out.append((list(map(get, chunks)), decoded[1:] if decoded[:1] == " " else decoded))
        if len(self.table) > self.most:
            self.table.clear()
            self.odd.clear()
        else:
            for chunk in new:
                if len(chunk) > self.longest:
                    del self.table[chunk]
                    self.odd.pop(chunk, None)
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for part in ids for i in part.split(",")] for ids, _ in self.segments(texts)]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, digest of the ids, digest of the decoded text) of each text."""
        out = []
        for parts, decoded in self.segments(texts):
            ids = ",".join(parts)
            out.append((ids.count(",") + bool(ids), sha256(ids.encode()), sha256(decoded.encode())))
        return out


def _mapped(
    docs: DataFrame, model: str, key: str, text: str, new: dict[str, pa.DataType], types: str, digest: Callable
) -> DataFrame:
    bounded(docs.sparkSession)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, {types}"
    made: list[ChunkTable] = []

    def run(batches):
        if not made:
            made.append(ChunkTable(model))
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                rows = digest(made[0], [value or "" for value in part.column(at).to_pylist()])
                arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(new.values())]
                yield pa.RecordBatch.from_arrays([part.column(1 - at), *arrays], names=[key, *new])

    return docs.select(key, text).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of every whole text, without begin or end ids; null texts have none."""
    return _mapped(
        docs, model, key, text, {"ids": pa.list_(pa.int32())}, "ids array<int>",
        lambda chunks, texts: [(ids,) for ids in chunks.encode(texts)],
    )


def decode_documents(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the library's decoding of each list of ids; a null list becomes the empty text."""
    kind, made = encoded.schema[key].dataType.simpleString(), []

    def run(batches):
        if not made:
            made.append(sentencepiece.SentencePieceProcessor(model_file=model))
        for batch in batches:
            texts = [made[0].decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def piece_digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256), a row for each row; nothing is shuffled.

    Null and empty texts have no ids and decode to the empty text. Other columns are not read.
    """
    return _mapped(
        docs, model, key, text, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()},
        "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        lambda chunks, texts: chunks.digests(texts),
    )
