"""Toxic passages: maximal-scoring segments of token log-odds, judged by extreme-value statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded, crc_fold, materialize, slices_by_bytes
from .decontaminate import words

BUCKETS = 1 << 20
LABELLED_ROWS = 100_000
PRIOR = 4.0
QUIET = 0.7
DRIFT = 0.15
SIGNIFICANT = 0.05
CACHED_WORDS = 300_000


def bucket(token: bytes, buckets: int) -> int:
    return xxhash.xxh64_intdigest(token) % buckets


def stem(word: bytes) -> bytes:
    """The first four characters of a longer word, the word itself otherwise."""
    if len(word) < 5:
        return word
    text = word.decode(errors="ignore")
    return text[:4].encode() + b"*" if len(text) > 5 else word


@dataclass
class Odds:
    """Log-odds by hashed word and by hashed stem, the base rate, and the calibration."""

    word: np.ndarray
    stem: np.ndarray
    rate: float
    decay: float = 1.0
    scale: float = 1.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)


def logit(p):
    return np.log(p) - np.log1p(-p)


class WordScores(dict):
    """Scores of words, looked up in the hashed tables when first met."""

    def __init__(self, odds: Odds):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: bytes) -> float:
        size = len(self.odds.word)
        known = self.odds.word[bucket(word, size)]
        # a word that training did not see speaks for its stem
        score = float(known if known == known else self.odds.stem[bucket(stem(word), size)])
        score = (score if abs(score) > QUIET else 0.0) - DRIFT
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = score
        return score


def log_odds(counts: dict[str, np.ndarray], clean: float, toxic: float) -> Odds:
    """Two-level Dirichlet smoothing of document counts: stems by the base rate, words by the stem.

    ``counts`` has an array for ``stem`` and one for ``word``: clean and toxic documents by bucket,
    and for a word the bucket of its stem. Words that no training document has are NaN.
    """
    rate = (toxic + 1) / (clean + toxic + 20)  # one in twenty before any document is seen
    s = counts["stem"]
    stem_rate = (s[:, 1] + PRIOR * rate) / (s[:, 0] + s[:, 1] + PRIOR)
    w = counts["word"]
    seen = w[:, 0] + w[:, 1]
    word_rate = (w[:, 1] + PRIOR * stem_rate[w[:, 2].astype(np.int64)]) / (seen + PRIOR)
    word = np.where(seen > 0, logit(word_rate) - logit(rate), np.nan)
    return Odds(word.astype(np.float32), (logit(stem_rate) - logit(rate)).astype(np.float32), float(rate))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal-scoring segments, in order, in one scan.

    A candidate that ends higher than an earlier one with a lower start swallows it and what lies
    between; each candidate keeps the last earlier one that starts lower, so the scan is linear.
    """
    total = np.r_[0.0, np.cumsum(scores)]
    up = np.r_[False, scores > 0, False]
    starts, ends = np.flatnonzero(up[1:] & ~up[:-1]), np.flatnonzero(~up[1:] & up[:-1])
    held: list[tuple[int, int, float, float, int]] = []  # start, end, low, high, lower one
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        low, high = float(total[start]), float(total[end])
        at = len(held) - 1
        while True:
            while at >= 0 and held[at][2] >= low:
                at = held[at][4]
            if at < 0 or held[at][3] >= high:
                held.append((start, end, low, high, at))
                break
            start, low, at_next = held[at][0], held[at][2], held[at][4]
            del held[at:]
            at = at_next
    return [(s, e, high - low) for s, e, low, high, _ in held]


def decay_rate(scores: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of E[exp(decay * score)] = 1 under the background; 1 if there is none."""
    if not len(scores) or scores.max() <= 0 or (scores * weight).sum() >= 0:
        return 1.0
    share = weight / weight.sum()
    low, high = 1e-6, 1.0
    value = lambda x: float((share * np.exp(np.minimum(x * scores, 500))).sum()) - 1
    while value(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return (low + high) / 2


def evidence(odds: Odds, best: np.ndarray, size: np.ndarray) -> np.ndarray:
    """-log of the chance that a clean text of this size holds a segment as high as its best one."""
    rate = odds.scale * np.maximum(size, 1) * np.exp(-odds.decay * best)
    return -np.log(np.maximum(-np.expm1(-np.maximum(rate, 1e-300)), 1e-300))


def features(odds: Odds, best: np.ndarray, mass: np.ndarray, size: np.ndarray) -> np.ndarray:
    strong = np.log1p(np.maximum(mass, 0))
    return np.stack([np.ones(len(best)), np.minimum(evidence(odds, best, size), 60.0), strong], axis=1)


def fit_logistic(sums, size: int, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton steps; ``sums`` takes weights and gives the rows' gradient and curvature, added up."""
    w = np.zeros(size)
    for _ in range(50):
        gradient, curvature = sums(w)
        step = np.linalg.solve(curvature + ridge * np.eye(size), gradient + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def _scan(cache: WordScores, odds: Odds, text: bytes):
    found = words(text)
    scores = np.fromiter(map(cache.__getitem__, found), dtype=np.float64, count=len(found))
    segments = maximal_segments(scores)
    best = max((s for _, _, s in segments), default=0.0)
    n = max(len(found), 1)
    strong = [g for g in segments if odds.scale * n * np.exp(-odds.decay * g[2]) < SIGNIFICANT]
    return len(found), best, sum(s for _, _, s in strong), strong


def training_labels(labels: DataFrame, most: int = LABELLED_ROWS, key: str = "doc_id", label: str = "toxic"):
    """{id: (label, fold)} of the rows that may be learned from, at most about ``most`` of them.

    Fold 0 of the ids' crc32 is never learned from. Beyond ``most`` rows the ids are thinned by a
    hash, which is the documented bound of the classifier's sample; null ids and labels are left out.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).withColumn("_fold", crc_fold(key))
    known = known.filter("_fold <> 0").groupBy(key, "_fold").agg(F.max(label).alias("_label"))
    share = min(1.0, most / max(known.count(), 1))
    picked = known.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    found = picked.select(key, "_label", "_fold").toArrow()
    return {k: (int(y > 0), f) for k, y, f in zip(*(c.to_pylist() for c in found.columns), strict=True)}


def fit(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = LABELLED_ROWS,
    key: str = "doc_id", text: str = "text",
) -> Odds:
    """Learn the calibration from fold 4 of the labelled documents, scored by log-odds that folds 1 to 3
    give, and the log-odds themselves from all four folds.

    Document counts of hashed words and stems are added up on the cluster and come back as at most
    ``buckets`` rows; of the labelled documents of fold 4 the driver sees sums only. Rows that repeat a labelled id
    all count; of two labels of one id the larger holds.
    """
    spark = bounded(docs.sparkSession)
    sent = spark.sparkContext.broadcast(training_labels(labels, most, key))
    source, names = docs.select(key, text), [f"c{i}" for i in range(8)]

    def count(batches):
        # document counts by bucket: words clean and toxic, stems clean and toxic, for folds 1 to 3
        # and again for fold 4; a word's stem
        tables = np.zeros((8, buckets), dtype=np.int32)
        stem_of = np.full(buckets, buckets, dtype=np.int32)
        totals, places = [0] * 8, {}
        for part, texts in slices_by_bytes(batches, text, 4 << 20):
            for one, data in zip(part.column(0).to_pylist(), texts, strict=True):
                label, fold = sent.value.get(one, (0, 0))
                if not fold:
                    continue
                label += 4 * (fold == 4)
                totals[label] += 1
                if len(places) > CACHED_WORDS:
                    places.clear()
                found = set(words(data))
                for w in found.difference(places):
                    places[w] = (bucket(w, buckets), bucket(stem(w), buckets))
                both = np.array([places[w] for w in found], dtype=np.int64).reshape(-1, 2)
                tables[label, np.unique(both[:, 0])] += 1
                tables[2 + label, np.unique(both[:, 1])] += 1
                np.minimum.at(stem_of, both[:, 0], both[:, 1])
        for some in np.array_split(np.flatnonzero(tables.any(axis=0)), 32):
            columns = [some, stem_of[some], *tables[:, some]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["w", "s", *names])
        totals = [pa.array([x], pa.int64()) for x in (-1, -1, *totals)]
        yield pa.RecordBatch.from_arrays(totals, names=["w", "s", *names])

    counted = source.mapInArrow(count, "w bigint, s bigint, " + ", ".join(f"{c} bigint" for c in names))
    # of the stems of words that share a bucket the smallest stands for them
    summed = counted.groupBy("w").agg(F.min("s").alias("s"), *[F.sum(c).alias(c) for c in names])
    found = np.stack([c.to_numpy() for c in summed.select("w", "s", *names).toArrow().columns], axis=1).astype(float)
    total, found = found[found[:, 0] < 0][:, 2:].sum(axis=0), found[found[:, 0] >= 0]
    first = _odds(found, total, [0, 1, 2, 3], buckets)
    odds = _odds(found, total, [[0, 4], [1, 5], [2, 6], [3, 7]], buckets)
    calibrated = _calibrate(source, first, sent, key, text)
    odds.decay, odds.scale, odds.weights = calibrated.decay, calibrated.scale, calibrated.weights
    return odds


def _odds(found: np.ndarray, total: np.ndarray, columns: list, buckets: int) -> Odds:
    """The log-odds of the added-up count columns: words clean and toxic, stems clean and toxic."""
    picked = [found[:, 2:][:, np.atleast_1d(c)].sum(axis=1) for c in columns]
    clean, toxic = (float(np.sum(total[columns[i]])) for i in (0, 1))
    counts = {"word": np.zeros((buckets, 3)), "stem": np.zeros((buckets, 2))}
    at = found[:, 0].astype(np.int64)
    counts["word"][at] = np.stack([*picked[:2], np.where(found[:, 1] < buckets, found[:, 1], 0)], axis=1)
    counts["stem"][at] = np.stack(picked[2:], axis=1)
    odds = log_odds(counts, clean, toxic)
    scores = np.where(np.abs(odds.word) > QUIET, odds.word, 0) - DRIFT
    calm = counts["word"][:, 0] > 0
    odds.decay = decay_rate(scores[calm], counts["word"][calm, 0])
    return odds


def _calibrate(source: DataFrame, odds: Odds, sent, key: str, text: str) -> Odds:
    """Fit the scale and the logistic's weights. The segments of fold 4 are written in the shared folder and
    stay there: the driver sees sums only, however many rows repeat a labelled id."""
    model = source.sparkSession.sparkContext.broadcast(odds)

    def measure(batches):
        cache = WordScores(model.value)
        for part, texts in slices_by_bytes(batches, text, 4 << 20):
            rows = []
            for one, data in zip(part.column(0).to_pylist(), texts, strict=True):
                label, fold = sent.value.get(one, (0, 0))
                if fold == 4:
                    found = words(data)
                    scores = np.fromiter(map(cache.__getitem__, found), dtype=np.float64, count=len(found))
                    segments = [s for _, _, s in maximal_segments(scores)]
                    rows.append((label, len(found), segments))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([sorted(r[2], reverse=True) for r in rows], pa.list_(pa.float64())),
                ],
                names=["label", "n", "segments"],
            )

    found = materialize(source.mapInArrow(measure, "label int, n bigint, segments array<double>"), "segments")
    best, size = F.coalesce(F.array_max("segments"), F.lit(0.0)), F.greatest("n", F.lit(1)).cast("double")
    calm = (F.col("label") == 0) & (F.col("n") > 0)
    row = found.agg(
        F.count("*").alias("rows"), F.count_if(calm).alias("calm"),
        F.sum(F.when(calm, F.col("n") * F.exp(-odds.decay * best))).alias("expected"),
    ).first()
    if not row["rows"]:  # nothing to calibrate with: the base rate, raised by the evidence
        odds.weights = (float(logit(odds.rate)), 0.5, 0.0)
        return odds
    if row["calm"]:  # the likelihood's maximum for the scale, given the decay
        odds.scale = float(row["calm"] / max(row["expected"], 1e-12))

    def rate(score):
        return F.lit(odds.scale) * size * F.exp(-odds.decay * score)

    strong = F.filter("segments", lambda s: rate(s) < SIGNIFICANT)
    mass = F.aggregate(strong, F.lit(0.0), lambda total, s: total + s)
    chance = F.greatest(-F.expm1(-F.greatest(rate(best), F.lit(1e-300))), F.lit(1e-300))
    x = found.select(
        F.col("label").cast("double").alias("y"), F.lit(1.0).alias("x0"),
        F.least(-F.log(chance), F.lit(60.0)).alias("x1"), F.log1p(mass).alias("x2"),
    )
    x = materialize(x, "evidence")
    names = ["x0", "x1", "x2"]

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        line = sum(F.col(c) * F.lit(float(v)) for c, v in zip(names, w, strict=True))
        p = 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(500.0)), F.lit(-500.0))))
        at = x.withColumn("p", p).withColumn("v", F.col("p") * (1 - F.col("p")) + F.lit(1e-9))
        gradient = [F.sum(F.col(c) * (F.col("p") - F.col("y"))) for c in names]
        curvature = [F.sum(F.col(c) * F.col(d) * F.col("v")) for c in names for d in names]
        added = np.array(list(at.agg(*gradient, *curvature).first()))
        return added[:3], added[3:].reshape(3, 3)

    odds.weights = fit_logistic(sums, 3)
    return odds


def score_documents(
    docs: DataFrame, odds: Odds, text: str = "text", passages: bool = False, names: str = "tox_"
) -> DataFrame:
    """``docs`` with ``tox_words``, ``tox_best`` and ``tox_score`` (0 to 1), and with ``passages`` the
    significant segments as ``tox_starts`` and ``tox_ends`` in words.

    Every whole text is scanned once and nothing is shuffled; a null or wordless text has no
    segment and the score of one. Columns of ``docs`` called like the added ones are replaced.
    """
    spark = bounded(docs.sparkSession)
    model = spark.sparkContext.broadcast(odds)
    new = [T.StructField(f"{names}words", T.LongType()), T.StructField(f"{names}best", T.DoubleType()),
           T.StructField(f"{names}score", T.DoubleType())]
    if passages:
        new += [T.StructField(f"{names}{c}", T.ArrayType(T.IntegerType())) for c in ("starts", "ends")]
    kept = docs.drop(*[f.name for f in new])

    def run(batches):
        odds = model.value
        cache = WordScores(odds)
        for part, texts in slices_by_bytes(batches, text, 4 << 20):
            found = [_scan(cache, odds, t) for t in texts]
            n, best, mass = (np.array([f[i] for f in found], dtype=float) for i in range(3))
            x = features(odds, best, mass, n) @ np.array(odds.weights)
            arrays = [pa.array(n.astype(np.int64)), pa.array(best), pa.array(1 / (1 + np.exp(-np.clip(x, -500, 500))))]
            if passages:
                arrays += [pa.array([[g[i] for g in f[3]] for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *[f.name for f in new]])

    return kept.mapInArrow(run, T.StructType(kept.schema.fields + new))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted), a row for each row of ``docs``; the score sees the text only."""
    scored = score_documents(docs.select(key, text), fit(docs, labels, key=key, text=text), text)
    return scored.select(
        key, (crc_fold(key) == 0).alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.5).cast("int").alias("predicted"),
    )
