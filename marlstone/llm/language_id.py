"""Language identification by a bidirectional gated recurrent network over bytes.

The network (one byte embedded straight into the gates, ``HIDDEN`` units a direction) is trained in numpy by
backpropagation through time on windows of labelled texts. It labels every byte of every text: texts are cut into
segments of ``SEGMENT`` bytes that run side by side, forward and backward, and a softmax over both states gives
a distribution at each position. A document's probabilities are the normalized geometric mean over its letters.

Training windows (at most ``PER_LANGUAGE`` texts a language, ``WINDOW`` characters each) are all that comes to the
driver; the model is a few tens of kilobytes; texts are labelled where they are read.

Defined results: null, empty and letterless texts are ``und`` with score 0; ties go to the language that sorts first;
repeated rows get equal results; extra columns are ignored; an empty table gives an empty result; without labelled
rows every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import flat, small_batches, tidy

HIDDEN, SEGMENT, PER_LANGUAGE, WINDOW, FOLDS = 8, 96, 1500, 192, 3
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class BiGRU:
    """Gates r, z, n for both directions; tables hold the input's part of each gate for each byte."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        h = hidden
        self.labels, self.hidden = labels, h
        self.p = {"x": rng.normal(0, 0.3, (3, 2, 256, h)), "u": rng.normal(0, 0.4, (3, 2, h, h)), "c": np.zeros((2, 1, h)), "v": rng.normal(0, 0.3, (2 * h, len(labels))), "b": np.zeros(len(labels))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    # -- training --------------------------------------------------------
    def _forward(self, seq: np.ndarray):
        """seq (T, 2, B) bytes, the second direction reversed; keeps what backpropagation needs."""
        p, steps, (_, _, n) = self.p, [], seq.shape
        h = np.zeros((2, n, self.hidden), np.float32)
        side = np.arange(2)[:, None]
        for t in range(len(seq)):
            x = p["x"][:, side, seq[t]]
            r, z = _sigmoid(x[0] + h @ p["u"][0]), _sigmoid(x[1] + h @ p["u"][1])
            g = h @ p["u"][2] + p["c"]
            c = np.tanh(x[2] + r * g)
            steps.append((h, r, z, g, c))
            h = c + z * (h - c)
        return steps, h

    def loss(self, seq: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients. seq (T, B), y (B)."""
        p, (t_all, n), h = self.p, seq.shape, self.hidden
        both = np.stack([seq, seq[::-1]], 1)
        steps, last = self._forward(both)
        states = np.stack([s[0] for s in steps[1:]] + [last])  # after each byte
        joint = np.concatenate([states[:, 0], states[::-1, 1]], 2)
        o = joint @ p["v"] + p["b"]
        o -= o.max(2, keepdims=True)
        q = np.exp(o)
        q /= q.sum(2, keepdims=True)
        at = np.broadcast_to(y, (t_all, n))
        value = float(-np.log(np.maximum(np.take_along_axis(q, at[:, :, None], 2), 1e-9)).mean())
        q -= np.eye(len(self.labels), dtype=np.float32)[at]
        q /= t_all * n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["v"] = np.einsum("tbi,tbj->ij", joint, q)
        g["b"] = q.sum((0, 1))
        dj = q @ p["v"].T
        ds = np.stack([dj[:, :, :h], dj[::-1, :, h:]], 1)
        dh = np.zeros((2, n, h), np.float32)
        side = np.arange(2)[:, None]
        for t in range(t_all - 1, -1, -1):
            hp, r, z, gg, c = steps[t]
            dh = dh + ds[t]
            dz = dh * (hp - c) * z * (1 - z)
            dc = dh * (1 - z) * (1 - c * c)
            dr = dc * gg * r * (1 - r)
            dg = dc * r
            for k, d in enumerate((dr, dz, dc)):
                np.add.at(g["x"][k], (side, both[t]), d)
            hpt = hp.transpose(0, 2, 1)
            for k, d in enumerate((dr, dz, dg)):
                g["u"][k] += hpt @ d
            g["c"] += dg.sum(1, keepdims=True)
            dh = dh * z + dr @ p["u"][0].transpose(0, 2, 1) + dz @ p["u"][1].transpose(0, 2, 1) + dg @ p["u"][2].transpose(0, 2, 1)
        return value, g

    def fit(self, windows: list[bytes], y: np.ndarray, length: int = 48, batch: int = 192, rounds: int = 260, seed: int = 2) -> BiGRU:
        rng = np.random.default_rng(seed)
        windows = [np.frombuffer(w, np.uint8) for w in windows]
        usable = np.array([i for i, w in enumerate(windows) if len(w) >= length])
        if not len(usable):
            return self
        weight = 1 / np.bincount(y[usable], minlength=len(self.labels))[y[usable]]
        weight /= weight.sum()
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, rounds + 1):
            pick = rng.choice(usable, batch, p=weight)
            at = [int(rng.integers(0, len(windows[i]) - length + 1)) for i in pick]
            seq = np.stack([windows[i][a : a + length] for i, a in zip(pick, at, strict=True)], 1)
            _, g = self.loss(seq, y[pick])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate = 0.03 * min(1.0, 4 * (1 - t / (rounds + 1)))
            for k, x in g.items():
                x *= min(1.0, 1.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                s[k] = 0.99 * s[k] + 0.01 * x * x
                self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    # -- labelling -------------------------------------------------------
    def positions(self, seq: np.ndarray) -> np.ndarray:
        """(T, B, labels) log probabilities at every position of B segments, seq (T, B)."""
        p, (t_all, n), h = self.p, seq.shape, self.hidden
        # halved gates spare the sigmoid a pass; one table row a (direction, byte)
        x = [np.ascontiguousarray(np.concatenate(list(p["x"][k])) * (0.5 if k < 2 else 1)) for k in range(3)]
        u = [p["u"][0] * 0.5, p["u"][1] * 0.5, p["u"][2]]
        code = np.concatenate([seq, seq[::-1].astype(np.int64) + 256], 1)
        state = np.zeros((2, n, h), np.float32)
        out = np.empty((t_all, 2, n, h), np.float32)
        a, b, c = (np.empty((2 * n, h), np.float32) for _ in range(3))
        for t in range(t_all):
            for table, into in zip(x, (a, b, c), strict=True):
                np.take(table, code[t], axis=0, out=into, mode="clip")
            r, z, w = a.reshape(2, n, h), b.reshape(2, n, h), c.reshape(2, n, h)
            r += state @ u[0]
            z += state @ u[1]
            g = state @ u[2]
            g += p["c"]
            np.tanh(r, out=r)
            np.tanh(z, out=z)
            r += 1
            g *= r
            g *= 0.5
            w += g
            np.tanh(w, out=w)
            state -= w  # c + z (h - c), z from its tanh
            z += 1
            z *= 0.5
            state *= z
            state += w
            out[t] = state
        o = out[:, 0].reshape(-1, h) @ p["v"][:h]
        o += out[::-1, 1].reshape(-1, h) @ p["v"][h:]
        o += p["b"]
        o -= np.log(np.exp(o).sum(1, keepdims=True))
        return o.reshape(t_all, n, -1)

    def documents(self, buf: np.ndarray, off: np.ndarray, at_once: int = 2048) -> np.ndarray:
        """(rows, labels): the sum of log probabilities over the letters of each row, and their number last."""
        rows = len(off) - 1
        size = np.diff(off)
        segments = -(-size // SEGMENT)
        owner = np.repeat(np.arange(rows), segments)
        begin = off[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)) * SEGMENT
        total = np.zeros((rows, len(self.labels) + 1))
        padded = np.concatenate([buf, np.full(SEGMENT, 32, np.uint8)])
        for i in range(0, len(owner), at_once):
            own, at = owner[i : i + at_once], begin[i : i + at_once]
            place = at[None, :] + np.arange(SEGMENT)[:, None]
            inside = place < off[own + 1][None, :]
            seq = np.where(inside, padded[place], 32).astype(np.int64)
            use = inside & _LETTER[seq]
            log = self.positions(seq)
            log *= use[:, :, None]
            part = log.sum(0, dtype=np.float64)
            for k in range(len(self.labels)):
                total[:, k] += np.bincount(own, part[:, k], rows)
            total[:, -1] += np.bincount(own, use.sum(0), rows)
        return total


def held_out(doc_id: str = "doc_id", folds: int = FOLDS, rest: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == rest, F.lit(False))


def train(docs: DataFrame, text: str = "text", per_language: int = PER_LANGUAGE, window: int = WINDOW) -> BiGRU:
    """Fit on a window of at most ``per_language`` labelled texts a language, outside the held-out fold."""
    h = F.xxhash64("doc_id", text)
    rows = docs.where(F.col("lang").isNotNull() & F.col(text).isNotNull() & ~held_out())
    at = 1 + F.pmod(h, F.greatest(F.lit(1).cast("long"), F.length(text) - window)).cast("int")
    # one text a (language, hash bucket): a bounded, even sample by plain partial aggregation
    picked = rows.groupBy("lang", F.pmod(h, F.lit(per_language)).alias("slot")).agg(F.min_by(F.substring(F.col(text), at, F.lit(window)), F.struct(h, F.col("doc_id"))).alias("w"))
    got = sorted((r.lang, r.slot, r.w.encode()) for r in picked.collect())
    labels = sorted({lang for lang, _, _ in got})
    model = BiGRU(labels or [UNKNOWN])
    return model.fit([w for _, _, w in got], np.array([labels.index(lang) for lang, _, _ in got])) if labels else model


def _label(batches, model: BiGRU):
    from marlstone.llm.common import portions

    for batch in batches:
        buf, off = flat(batch.column(2))
        got = [model.documents(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in portions(off)]
        total = np.concatenate(got) if got else np.zeros((0, len(model.labels) + 1))
        n = total[:, -1]
        ascii_letters = np.zeros(len(n), bool)
        if len(buf):
            sums = np.concatenate([[0], np.cumsum(_LETTER[buf] & (buf < 128))])
            ascii_letters = sums[off[1:]] > sums[off[:-1]]
        texts = batch.column(2)
        letters = [bool(a) or (bool(k) and any(c.isalpha() for c in texts[i].as_py())) for i, (a, k) in enumerate(zip(ascii_letters, n, strict=True))]
        mean = total[:, :-1] / np.maximum(n, 1)[:, None]
        q = np.exp(mean - mean.max(1, keepdims=True)) if len(mean) else mean
        q /= np.maximum(q.sum(1, keepdims=True), 1e-12)
        best = q.argmax(1) if len(q) else np.zeros(0, int)
        lang = [model.labels[b] if k else UNKNOWN for b, k in zip(best, letters, strict=True)]
        score = np.where(letters, q[np.arange(len(q)), best], 0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, model: BiGRU, text: str = "text") -> DataFrame:
    """A row a document: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    shared = spark.sparkContext.broadcast(model)

    def task(batches):
        yield from tidy(_label(batches, shared.value))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col(text).alias("text")).mapInArrow(task, "doc_id long, held_out boolean, lang_pred string, score double")
