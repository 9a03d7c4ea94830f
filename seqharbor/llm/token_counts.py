"""Token counts of sections: whole documents are encoded once, tokens are dealt out by their offsets."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import bounded, slices_by_bytes

RULES = ("most", "first")


def load_ranks(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def line_sections(data: np.ndarray) -> np.ndarray:
    """Byte offsets where a text's lines start; a line feed ends its own line."""
    starts = np.flatnonzero(data == 10) + 1
    return np.r_[0, starts[starts < len(data)]]


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token span, and whether the span crosses a section's border.

    ``bounds`` are the section starts, ascending from 0. ``first`` gives a crossing token to the
    section of its first character, ``most`` to the one that holds most of its characters, the
    earlier of two with as many.
    """
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, np.maximum(ends - 1, starts), side="right") - 1
    crossing = last > first
    section = first.copy()
    if rule == "most":
        for i in np.flatnonzero(crossing):
            cuts = np.r_[starts[i], bounds[first[i] + 1 : last[i] + 1], ends[i]]
            section[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return section, crossing


def section_tokens(
    docs: DataFrame, ranks: str, pattern: str, rule: str = "most", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, section, start_char, end_char, n_tokens, n_crossing, doc_tokens) for each line of each text.

    Every whole text is encoded once; a token's span are the characters that its bytes touch.
    Each token counts for exactly one section, by ``rule`` if it crosses a border, so a document's
    ``n_tokens`` add up to ``doc_tokens``; ``n_crossing`` are the crossing ones among a section's
    tokens. A null or empty text has one empty section without tokens.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    bounded(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = ["section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"]
    made: list = []

    def run(batches):
        if not made:
            encoding = load_ranks(ranks, pattern)
            sizes = np.zeros(encoding.n_vocab, dtype=np.int64)
            for data, i in encoding._mergeable_ranks.items():  # noqa: SLF001 - bytes of every id
                sizes[i] = len(data)
            made.extend([encoding, sizes])
        encoding, sizes = made
        for part, texts in slices_by_bytes(batches, text, 1 << 20):
            found = [_one(encoding, sizes, t, rule) for t in texts]
            many = np.array([len(f[0]) for f in found])
            columns = [np.concatenate([f[i] for f in found]) for i in range(len(names))]
            keys = part.column(0).take(pa.array(np.repeat(np.arange(len(texts)), many)))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(c) for c in columns]], names=[key, *names])

    schema = f"`{key}` {kind}, " + ", ".join(f"{n} bigint" for n in names)
    return docs.select(key, text).mapInArrow(run, schema)


def _one(encoding, sizes: np.ndarray, text: bytes, rule: str) -> tuple[np.ndarray, ...]:
    if not text:
        zero = np.zeros(1, dtype=np.int64)
        return (zero,) * 6
    data = np.frombuffer(text, dtype=np.uint8)
    ids = np.array(encoding.encode_ordinary(text.decode()), dtype=np.int64)
    stop = np.cumsum(sizes[ids])
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    starts, ends = char[stop - sizes[ids]], char[stop - 1] + 1
    bounds = char[line_sections(data)]
    section, crossing = attribute(starts, ends, bounds, rule)
    n = len(bounds)
    return (
        np.arange(n), bounds, np.r_[bounds[1:], char[-1] + 1],
        np.bincount(section, minlength=n), np.bincount(section[crossing], minlength=n),
        np.full(n, len(ids), dtype=np.int64),
    )
