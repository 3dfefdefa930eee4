"""Quality score by Bradley-Terry pairwise ranking.

A document is described by frequencies of neighbouring byte classes and a few shape measures of its whole text. Weights
are learned from preference pairs (a text labelled 1 over a text labelled 0) by logistic loss on the difference of the
two feature rows. The threshold is a quantile of the training scores: the share of label 0 among the training rows.
Scores are the sigmoid of the distance to that threshold, moved so that the threshold is at ``CUT``.

Only training rows (at most ``MAX_TRAIN``, the least hashes of doc_id) come to the driver, as feature rows. All texts
are scored where they are read; the model is a few kilobytes.

Defined results: null is an empty text; empty and blank texts have zero features and get a score like any other;
repeated rows get equal scores; extra columns are ignored; an empty table gives an empty result; without both labels in
the training rows every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import flat, portions, range_hashes, small_batches, tidy, words_of

MAX_TRAIN, PAIRS, CUT, FOLDS = 6000, 4096, 0.3, 5

#: Byte classes, in order; what is in none of them is class 0.
CLASSES = [" ", "\n", "\t\r\x0b\x0c", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "'\"()[]{}", "|", "#*$%&", "<>=/\\+-_~^@`"]
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate(CLASSES, 1):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[128:] = len(CLASSES) + 1
KINDS = len(CLASSES) + 2
SHAPES = 8
WIDTH = KINDS * KINDS + SHAPES


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, WIDTH) for the texts of one buffer."""
    rows, size = len(off) - 1, np.diff(off)
    out = np.zeros((rows, WIDTH), np.float32)
    if not len(buf):
        return out
    row = np.repeat(np.arange(rows), size)
    kind = _CLASS[buf]
    pair = kind[:-1] * KINDS + kind[1:] + row[:-1] * (KINDS * KINDS)
    pair = pair[row[:-1] == row[1:]]
    table = np.bincount(pair, minlength=rows * KINDS * KINDS).reshape(rows, -1)
    out[:, : KINDS * KINDS] = np.sqrt(table / np.maximum(size, 1)[:, None])
    start, end, first = words_of(buf, off)
    n = np.diff(first)
    h = range_hashes(buf, start, end, 31)
    w = np.repeat(np.arange(rows), n)
    order = np.lexsort((h, w))
    hs, ws = h[order], w[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])
    distinct = np.bincount(ws[new], minlength=rows)
    at = np.flatnonzero(new)
    most = np.zeros(rows)
    np.maximum.at(most, ws[at], np.diff(np.append(at, len(hs))))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w[1:] == w[:-1])
    total = np.maximum(n, 1)
    length = np.bincount(w, end - start, rows) / total
    shape = [np.log1p(n), distinct / total, most / total, np.bincount(w[again], minlength=rows) / total, length, np.bincount(w, (end - start == 1), rows) / total, np.log1p(n) * (1 - distinct / total), np.minimum(n, 50) / 50]
    out[:, KINDS * KINDS :] = np.stack(shape, 1)
    return out


class Ranker:
    """A linear Bradley-Terry score over standardized features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, rounds: int = 400, seed: int = 3):
        self.mean, self.scale = x.mean(0) if len(x) else np.zeros(WIDTH), np.ones(WIDTH)
        self.w, self.cut = np.zeros(WIDTH), 0.0
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.fitted = bool(len(good) and len(bad))
        if not self.fitted:
            return
        self.scale = 1 / np.maximum(x.std(0), 1e-2)
        z = self._prepare(x)
        rng = np.random.default_rng(seed)
        m, v = np.zeros(WIDTH), np.zeros(WIDTH)
        for t in range(1, rounds + 1):
            d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
            p = 1 / (1 + np.exp(np.clip(d @ self.w, -30, 30)))  # 1 - P(good over bad)
            g = -(d * p[:, None]).mean(0) + 1e-3 * self.w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        s = np.sort(z @ self.w)
        k = min(len(s) - 1, max(1, round(len(s) * len(bad) / len(y))))
        self.cut = float((s[k - 1] + s[k]) / 2)

    def _prepare(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        s = self._prepare(x) @ self.w - self.cut
        return np.round(1 / (1 + np.exp(-np.clip(s + np.log(CUT / (1 - CUT)), -30, 30))), 12)


def held_out(doc_id: str = "doc_id", folds: int = FOLDS, rest: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == rest, F.lit(False))


def _features(batches):
    for batch in batches:
        buf, off = flat(batch.column(1))
        for i, j in portions(off):
            x = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["quality", "x"])


def _score(batches, model: Ranker):
    for batch in batches:
        buf, off = flat(batch.column(2))
        got = [model.score(features(buf[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in portions(off)]
        s = np.concatenate(got) if got else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = MAX_TRAIN) -> Ranker:
    """Fit on at most ``most`` labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    rows = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & ~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    known = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(rows), "doc_id").select(F.col("quality").cast("int").alias("quality"), "text")
    got = known.mapInArrow(lambda it: tidy(_features(it)), "quality int, x binary").limit(2 * most).collect()
    got.sort(key=lambda r: (r.quality, bytes(r.x)))
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(-1, WIDTH).astype(np.float64)
    return Ranker(x, np.array([r.quality for r in got]))


def score(docs: DataFrame, model: Ranker, text: str = "text") -> DataFrame:
    """A row a document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def task(batches):
        yield from tidy(_score(batches, shared.value))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col(text).alias("text")).mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")
