"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions; each of the 255 decision nodes has a context tree over the preceding ``DEPTH`` bytes.
Every tree node holds a Krichevsky-Trofimov estimator over its zeros and ones, and nodes mix with their subtrees by
one half, so a prediction is the mixture of all depths with weights that the training data set:
p(d) = w(d) KT(d) + (1 - w(d)) p(d+1), w(d) = KT block probability / (2 x weighted block probability). A context
never seen in training hands its part to the estimator above it (an empty estimator would say one half, whatever the
bit).

Counts and predictions travel as packed lists between blocks of documents and partitions of keys:

1. documents are dealt to blocks of about ``BLOCK_BYTES`` by hash; a block sends each key partition its distinct words
   and distinct (context, byte) strings with their training counts, sorted, delta-coded and compressed;
2. a key partition adds them up. Strings are parted by the two nearest context bytes, so trees are whole from depth 2
   down; the tops (at most 2**16 contexts x 255 nodes, whatever the corpus) are closed on the driver;
3. partitions answer every block in the order of its own sorted keys with values alone, and the block scores its texts.

So no table of the corpus is broadcast or collected, a frequent key is one entry a block, and work per block is constant.

Word keys are 56-bit fingerprints. Text ends are a token of the base and a zero byte of the model.

Defined results: null is an empty text (the end alone); documents without an id train; with no training text every
estimate is of no data; repeated rows count as often as they are there; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import LOWER, flat, portions, range_hashes, release, stage, words_of

DEPTH, BLOCK_BYTES, PORTION, FOLDS = 5, 16 << 20, 1_000_000, 10
WORD_BITS = 56
_HALF = np.log(0.5)


# -- packed lists ------------------------------------------------------------


def _pack(v: np.ndarray, deltas: bool = True) -> bytes:
    """Unsigned integers as compressed byte planes, of differences for sorted ones."""
    v = np.ascontiguousarray(v, np.uint64)
    if deltas and len(v):
        v = np.diff(v, prepend=np.uint64(0))
    planes = v.view(np.uint8).reshape(-1, 8).T
    used = 8 - next((k for k in range(8) if planes[7 - k].any()), 8)
    return bytes([used]) + (pa.compress(np.ascontiguousarray(planes[:used]).tobytes(), codec="zstd", asbytes=True) if used else b"")


def _unpack(raw: bytes, n: int, deltas: bool = True) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if used := raw[0]:
        out[:, :used] = np.frombuffer(pa.decompress(raw[1:], decompressed_size=n * used, codec="zstd"), np.uint8).reshape(used, n).T
    v = out.view(np.uint64).ravel()
    return np.cumsum(v, dtype=np.uint64) if deltas else v


# -- keys of texts -----------------------------------------------------------


def _strings(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The (context, byte) code at every position of every row, its end included: nearest context byte first."""
    rows = len(off) - 1
    put = off[:-1] + (DEPTH + 1) * np.arange(rows) + DEPTH
    size = np.diff(off)
    at = np.arange(len(buf)) + np.repeat(put - off[:-1], size)
    s = np.zeros(len(buf) + (DEPTH + 1) * rows, np.uint64)
    s[at] = buf
    code = np.zeros(len(s) - DEPTH, np.uint64)
    for k in range(1, DEPTH + 1):  # k back from the byte
        code |= s[DEPTH - k : len(s) - k] << np.uint64(8 * (DEPTH + 1 - k))
    code |= s[DEPTH:]
    own = np.repeat(put - DEPTH, size + 1) + np.arange(len(buf) + rows) - np.repeat(off[:-1] + np.arange(rows), size + 1)
    return code[own]


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = words_of(buf, off)
    return range_hashes(buf, start, end, 41) >> np.uint64(64 - WORD_BITS), first


def _distinct(keys: np.ndarray, train: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys sorted, how often each is among the first ``train``)."""
    d = pa.array(keys.view(np.int64)).dictionary_encode()
    count = np.bincount(d.indices.to_numpy()[:train], minlength=len(d.dictionary))
    u = d.dictionary.to_numpy().view(np.uint64)
    order = np.argsort(u)
    return u[order], count[order]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)) != 0) if len(keys) else np.zeros(0, int)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


def _partition(kind: int, keys: np.ndarray, parts: int) -> np.ndarray:
    h = keys >> np.uint64(WORD_BITS - 20) if kind == 0 else (keys >> np.uint64(8 * (DEPTH - 1))) * np.uint64(0x9E37) + np.uint64(77)
    return ((h * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(parts)).astype(np.int64)


def _requests(table: pa.Table, parts: int) -> pa.Table:
    """A block's distinct keys for each key partition, with their training counts."""
    table = table.take(pc.sort_indices(table, [("held_out", "ascending")]))
    buf, off = flat(table.column("text"))
    train_rows = table.num_rows - pc.sum(table.column("held_out").cast(pa.int64())).as_py()
    found: tuple[list, list] = ([], [])
    for i, j in portions(off, PORTION):
        b, o = LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
        t = min(max(train_rows - i, 0), j - i)
        w, first = _words(b, o)
        found[0].append(_distinct(w, int(first[t])))
        found[1].append(_distinct(_strings(b, o), int(o[t] + t)))
    block = table.column("block")[0].as_py()
    rows = []
    for kind in (0, 1):
        keys, counts = _merge(found[kind])
        part = _partition(kind, keys, parts)
        order = np.argsort(part, kind="stable")
        keys, counts = keys[order], counts[order]
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            a, z = ends[p], ends[p + 1]
            if z > a:
                rows.append((block, kind, p, int(z - a), _pack(keys[a:z]), _pack(counts[a:z].astype(np.uint64), False)))
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())], names=["block", "kind", "part", "n", "keys", "counts"])


_REQUEST = "block long, kind int, part long, n long, keys binary, counts binary"
_ANSWER = "block long, kind int, part long, n long, answer binary"


def _lists(table: pa.Table, *cols: str):
    for r in table.select(["block", "n", *cols]).to_pylist():
        yield r["block"], r["n"], *[r[c] for c in cols]


def _answers(rows: list[tuple], kind: int, part: int) -> pa.Table:
    block, n, raw = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"block": pa.array(block, pa.int64()), "kind": pa.array([kind] * len(rows), pa.int32()), "part": pa.array([part] * len(rows), pa.int64()), "n": pa.array(n, pa.int64()), "answer": pa.array(raw, pa.binary())})


def _add_words(table: pa.Table) -> pa.Table:
    """Counts of a partition's words for each block; block -1 gets (distinct, total)."""
    asked = [(b, _unpack(k, n), _unpack(c, n, False).astype(np.int64)) for b, n, k, c in _lists(table, "keys", "counts")]
    keys, counts = _merge([(k, c) for _, k, c in asked])
    part = table.column("part")[0].as_py()
    rows = [(b, len(k), _pack(counts[np.searchsorted(keys, k)].astype(np.uint64), False)) for b, k, _ in asked]
    rows.append((-1, 2, np.array([(counts > 0).sum(), counts.sum()], np.int64).tobytes()))
    return _answers(rows, 0, part)


# -- context trees -----------------------------------------------------------


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after shifting small arguments up."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _block_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log KT probability of a sequence with so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - np.log(np.pi)


def _nodes(codes: np.ndarray, counts: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decision nodes of bit ``j`` (most significant first) from sorted (context, byte) codes:
    (context with the bits before, zeros, ones)."""
    name = codes >> np.uint64(8 - j)
    at = np.flatnonzero(np.diff(name, prepend=name[:1] + np.uint64(1)) != 0)
    one = ((codes >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
    return name[at], np.add.reduceat(np.where(one, 0, counts), at), np.add.reduceat(np.where(one, counts, 0), at)


class Trees:
    """Levels ``top`` to DEPTH of the context trees of some nearest contexts, from (code, count) lists."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, top: int, bottom: int = DEPTH, below: dict[int, tuple] | None = None):
        seen = counts > 0
        codes, counts = codes[seen], counts[seen]
        self.top, self.bottom = top, bottom
        self.level: dict[int, list[tuple]] = {}
        under = below
        for d in range(bottom, top - 1, -1):
            mine = []
            if d < bottom:  # shorten contexts by their farthest byte
                short = ((codes >> np.uint64(16)) << np.uint64(8)) | (codes & np.uint64(255))
                codes, counts = _merge([(short, counts)])
            for j in range(8):
                if not len(codes):
                    mine.append((np.zeros(0, np.uint64), *[np.zeros(0)] * 4))
                    continue
                name, n0, n1 = _nodes(codes, counts, j)
                own = _block_kt(n0, n1)
                whole = own
                if under is not None:
                    child, weighted = under[j][0], under[j][4]
                    # a child's name is context, farthest byte, j bits
                    up = ((child >> np.uint64(8 + j)) << np.uint64(j)) | (child & np.uint64((1 << j) - 1))
                    total = np.zeros(len(name))
                    np.add.at(total, np.searchsorted(name, up), weighted)
                    whole = np.logaddexp(_HALF + own, _HALF + total)
                mine.append((name, n0, n1, own, whole))
            self.level[d] = under = mine

    def summary(self) -> tuple[np.ndarray, ...]:
        """Names, bits, counts and weighted log probabilities of the top level's nodes."""
        parts = self.level[self.top]
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(5)) + (np.repeat(np.arange(8), [len(p[0]) for p in parts]),)


def _mix(level: list[tuple], j: int, name: np.ndarray, bit: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
    """Probability of ``bit`` at nodes of one depth, given the deeper levels' (NaN: never seen)."""
    names, n0, n1, own, whole = level[j]
    out = np.full(len(name), np.nan)
    if not len(names):
        return out
    at = np.searchsorted(names, name)
    at[at == len(names)] = 0
    hit = names[at] == name
    at = at[hit]
    kt = (np.where(bit[hit], n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1.0)
    if deeper is None:
        out[hit] = kt
        return out
    share = np.exp(np.minimum(0.0, _HALF + own[at] - whole[at]))
    d = deeper[hit]
    out[hit] = np.where(np.isnan(d), kt, share * kt + (1 - share) * d)
    return out


def _predict(codes: np.ndarray, trees: Trees, tops: Trees) -> np.ndarray:
    """Log10 probability of each code's byte after its context."""
    total = np.zeros(len(codes))
    byte = codes & np.uint64(255)
    for j in range(8):
        bit = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
        before = byte >> np.uint64(8 - j)
        p = None
        for d in range(DEPTH, -1, -1):
            context = codes >> np.uint64(8 * (DEPTH - d + 1))
            p = _mix((trees if d >= trees.top else tops).level[d], j, (context << np.uint64(j)) | before, bit, p)
        total += np.log10(np.where(np.isnan(p), 0.5, p))
    return total


def _add_strings(table: pa.Table) -> pa.Table:
    """A partition's counts, and its trees' tops at depth 2."""
    codes, counts = _merge([(_unpack(k, n), _unpack(c, n, False).astype(np.int64)) for _, n, k, c in _lists(table, "keys", "counts")])
    some = counts > 0
    codes, counts = codes[some], counts[some]
    name, n0, n1, _, whole, bit = Trees(codes, counts, 2).summary()
    top = np.concatenate([x.astype(np.float64) for x in (name, n0, n1, whole, bit)]).tobytes()
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "m": pa.array([len(codes)], pa.int64()), "codes": pa.array([_pack(codes)], pa.binary()), "total": pa.array([_pack(counts.astype(np.uint64), False)], pa.binary()), "top": pa.array([top], pa.binary())})


def _close(tops: list[bytes]) -> Trees:
    """Depths 0 and 1 from the partitions' depth-2 nodes."""
    cols = [np.frombuffer(t, np.float64).reshape(5, -1) for t in tops]
    name, n0, n1, whole, bit = np.concatenate(cols, axis=1) if cols else np.zeros((5, 0))
    name, bit = name.astype(np.uint64), bit.astype(int)
    below = []
    for j in range(8):
        mine = bit == j
        order = np.argsort(name[mine])
        below.append(tuple(x[mine][order] for x in (name, n0, n1, whole, whole)))
    # single (context, byte) counts of depth 2 are the last bit's zeros and ones
    last = below[7]
    codes = np.concatenate([last[0] << np.uint64(1), (last[0] << np.uint64(1)) | np.uint64(1)])
    counts = np.concatenate([last[1], last[2]]).astype(np.int64)
    short = ((codes >> np.uint64(16)) << np.uint64(8)) | (codes & np.uint64(255))
    codes, counts = _merge([(short, counts)]) if len(short) else (codes, counts)
    return Trees(codes, counts, 0, 1, below)


def _answer_strings(requests: pa.Table, model: pa.Table, tops: Trees) -> pa.Table:
    if not requests.num_rows:
        return _answers([], 1, 0)
    m = model.to_pylist()
    codes, counts = (_unpack(m[0]["codes"], m[0]["m"]), _unpack(m[0]["total"], m[0]["m"], False).astype(np.int64)) if m else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    asked = [(b, _unpack(k, n)) for b, n, k in _lists(requests, "keys")]
    every, _ = _merge([(k, np.zeros(len(k), np.int64)) for _, k in asked])
    trees = Trees(codes, counts, 2)
    value = np.concatenate([_predict(every[i : i + 200_000], trees, tops) for i in range(0, len(every), 200_000)]).astype(np.float32)
    return _answers([(b, len(k), value[np.searchsorted(every, k)].tobytes()) for b, k in asked], 1, requests.column("part")[0].as_py())


# -- scores ------------------------------------------------------------------


def _score(docs: pa.Table, answers: pa.Table, parts: int, vocabulary: int, total: int, ends: int) -> pa.Table:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    if not docs.num_rows:
        return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
    got: dict[int, list] = {0: [], 1: []}
    for r in answers.sort_by("part").to_pylist():
        got[r["kind"]].append(_unpack(r["answer"], r["n"], False).astype(np.int64) if r["kind"] == 0 else np.frombuffer(r["answer"], np.float32))
    buf, off = flat(docs.column("text"))
    found: tuple[list, list] = ([], [])
    for i, j in portions(off, PORTION):
        b, o = LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
        found[0].append(_distinct(_words(b, o)[0], 0))
        found[1].append(_distinct(_strings(b, o), 0))
    sets, values = [], []
    for kind in (0, 1):
        keys, _ = _merge(found[kind])
        keys = keys[np.argsort(_partition(kind, keys, parts), kind="stable")]
        value = np.concatenate(got[kind]) if got[kind] else np.zeros(0)
        if len(value) != len(keys):
            raise ValueError("a block was answered for other keys")
        sets.append(pa.array(keys.view(np.int64)))
        values.append(value)
    scale = np.log10(total + 0.1 * (vocabulary + 1))
    out: list[list[np.ndarray]] = [[], [], [], []]
    end_log = np.log10(ends + 0.1) - scale
    for i, j in portions(off, PORTION):
        b, o = LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
        rows = j - i
        w, first = _words(b, o)
        c = values[0][pc.index_in(pa.array(w.view(np.int64)), value_set=sets[0]).to_numpy()] if len(w) else np.zeros(0)
        n = np.diff(first)
        row = np.repeat(np.arange(rows), n)
        out[0].append(n + 1)
        out[1].append(np.bincount(row, c > 0, rows).astype(np.int64) + (ends > 0))
        out[2].append(np.bincount(row, np.log10(c + 0.1) - scale, rows) + end_log)
        s = _strings(b, o)
        v = values[1][pc.index_in(pa.array(s.view(np.int64)), value_set=sets[1]).to_numpy()]
        out[3].append(np.bincount(np.repeat(np.arange(rows), np.diff(o) + 1), v, rows))
    a = [np.concatenate(x) for x in out]
    n = docs.num_rows
    return pa.Table.from_arrays([docs.column("doc_id"), docs.column("held_out"), pa.array(a[0], pa.int64()), pa.array(a[1], pa.int64()), pa.array(np.full(n, total), pa.int64()), pa.array(a[2]), pa.array(a[3])], names=names)


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def score(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size, ends = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    parts = max(1, -(-size // block_bytes))
    blocked = slim.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "doc_id", F.substring("text", 1, 32)), F.lit(parts)))

    def requests(table: pa.Table) -> pa.Table:
        release()  # of the block before
        return _requests(table, parts)

    def add_words(table: pa.Table) -> pa.Table:
        return _add_words(table)

    def add_strings(table: pa.Table) -> pa.Table:
        return _add_strings(table)

    asked = stage(blocked.groupBy("block").applyInArrow(requests, _REQUEST), "lm-requests")
    words = stage(asked.where("kind = 0").groupBy("part").applyInArrow(add_words, _ANSWER), "lm-words")
    vocabulary, total = 0, 0
    for r in words.where("block = -1").select("answer").toLocalIterator():
        v, t = np.frombuffer(bytes(r.answer), np.int64)
        vocabulary, total = vocabulary + int(v), total + int(t)
    vocabulary, total = vocabulary + (ends > 0), total + ends
    strings = asked.where("kind = 1")
    model = stage(strings.groupBy("part").applyInArrow(add_strings, "part long, m long, codes binary, total binary, top binary"), "lm-model")
    tops = _close([bytes(r.top) for r in model.select("top").toLocalIterator()])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        return _answer_strings(left, right, tops)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        return _score(left, right, parts, vocabulary, total, ends)

    answers = words.where("block >= 0").union(strings.groupBy("part").cogroup(model.groupBy("part")).applyInArrow(answer, _ANSWER))
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
