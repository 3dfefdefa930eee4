"""Exact removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

Two equal strings of ``LENGTH`` bytes choose the same anchor in them (the least fingerprint among their ``K``-byte
substrings), so only suffixes at anchors are indexed, about one in 75. An entry is (lead, key, run, n): the suffix's
first eight bytes, a fingerprint of its first ``K``, and a fingerprint of the whole stretch of text whose strings choose
that anchor. A suffix array is a table of entries in the order of the suffixes' leading bytes, then their keys and runs;
equal entries are added up.

A new batch gets an array of its own, which is merge-scanned (a sort-merge join of two sorted tables) against every
level of the family: keys that both hold, or that stand twice in the batch, are matches. Then the batch becomes a level;
as long as the last level has no more than twice its suffixes the two are merged. ``matches`` gathers the entries of all
matching keys from the levels.

Stretches whose run occurs twice are repeated as a whole. Where a key recurs with different runs (the ends of matches)
one text of each run is taken and all its strings of LENGTH bytes are fingerprinted; those that occur twice under their
key are repeated. Keys of up to ``HOT`` runs are done in a task each; keys with more spread their strings over all
tasks. The test is the same, and nothing pairs the members of a group.

Equality: runs by a 64-bit fingerprint beside the 64 bits of their key, strings by 62 bits beside theirs; so two
different texts under one key (which share K bytes as a rule) pass for equal once in 2**62 pairs.

Sizes: entries are pre-added in each task; ids are broadcast only after being counted (``BROADCAST_IDS``), else joined;
texts are shuffled only for documents with repeats.

Defined results: null is an empty text; texts under LENGTH bytes have nothing to remove; strings never cross documents;
identical rows (id and text) repeat each other; overlapping repeats within a document count; a removed run is maximal;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Rolling, flat, mix, portions, range_hashes, small_batches, stage, string_hashes, tidy

LENGTH, K = 200, 48
BATCHES, HOT, BROADCAST_IDS, PIECE, CHUNK, PORTION = 3, 20_000, 2_000_000, 8 << 20, 3 << 20, 1 << 19
_PLACE = np.uint64((1 << 24) - 1)


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = K):
    """(row, low, high, lead, key, run): stretches of string starts low..high (in the row) that choose one anchor."""
    out = []
    for i, j in portions(off, PORTION):
        # a very long row is taken in pieces that share length - 1 bytes, so no string is missed
        for base in range(int(off[i]), max(int(off[j]) - length + 1, int(off[i]) + 1), PIECE) if j - i == 1 and off[j] - off[i] > PIECE else [int(off[i])]:
            stop = min(base + PIECE + length - 1, int(off[j])) if j - i == 1 and off[j] - off[i] > PIECE else int(off[j])
            out.append(_anchors(buf[base:stop], np.clip(off[i : j + 1] - base, 0, stop - base), i, base - off[i], length, k))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2


def _anchors(buf: np.ndarray, off: np.ndarray, first_row: int, shift: int, length: int, k: int):
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    width = length - k + 1
    if len(buf) < length:
        return none
    h = Rolling(buf, 61).of(k)
    m = len(h)
    a = np.full(-(-m // width) * width, np.iinfo(np.uint64).max, np.uint64)
    a[:m] = (h & ~_PLACE) | np.arange(m, dtype=np.uint64)
    grid = a.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: m - width + 1], ahead[width - 1 : m])
    size = np.diff(off)
    count = np.maximum(size - length + 1, 0)
    row = np.repeat(np.arange(len(size)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + off[row]
    if not len(start):
        return none
    anchor = (least[start] & _PLACE).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor, prepend=-1) != 0)
    low, high = start[cut], start[np.append(cut[1:], len(start)) - 1]
    anchor, row = anchor[cut], row[cut]
    lead = np.ndarray((len(buf) - 7,), ">u8", np.ascontiguousarray(buf).data, 0, (1,))[anchor].astype(np.uint64)
    run = mix(range_hashes(buf, low, high + length, 61) + (anchor - low).astype(np.uint64))
    base = off[row] - shift
    # signed numbers in the order of the bytes
    return [row + first_row, low - base, high - base, (lead ^ np.uint64(1 << 63)).view(np.int64), h[anchor], run]


def _entries(batches):
    """A task's entries, equal ones added up; the second column is the batch of a row."""
    for batch in batches:
        buf, off = flat(batch.column(0))
        row, _, _, lead, key, run = anchors(buf, off)
        part = batch.column(1).to_numpy()[row] if len(row) else np.zeros(0, np.int32)
        order = np.lexsort((run, key, part))
        lead, key, run, part = lead[order], key[order], run[order], part[order]
        at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (run[1:] != run[:-1]) | (part[1:] != part[:-1]))) if len(key) else np.zeros(0, np.int64)
        cols = {"lead": lead[at], "key": key[at].view(np.int64), "run": run[at].view(np.int64), "n": np.diff(np.append(at, len(key)))}
        yield pa.RecordBatch.from_pydict({**{c: pa.array(v, pa.int64()) for c, v in cols.items()}, "part": pa.array(part[at], pa.int32())})


def index(texts: DataFrame, text: str = "text", part=None) -> DataFrame:
    """Entries (lead, key, run, n, part) of the texts; ``part`` tells the batch of a row."""
    small_batches(texts.sparkSession, 1024)
    part = F.lit(0) if part is None else part
    return texts.select(F.col(text).alias("text"), part.cast("int").alias("part")).mapInArrow(lambda it: tidy(_entries(it)), "lead long, key long, run long, n long, part int")


ORDER = ("lead", "key", "run")


class SuffixFamily:
    """Levels of suffix arrays; ``add`` batches of texts or entries, read ``matches``."""

    def __init__(self, text: str = "text"):
        self.text = text
        self.levels: list[tuple[int, DataFrame]] = []  # suffixes, array; the largest first
        self.hits: list[DataFrame] = []

    @staticmethod
    def _array(entries: DataFrame, name: str) -> tuple[int, DataFrame]:
        """Entries added up, in order, and how many suffixes they stand for."""
        out = stage(entries.groupBy(*ORDER).agg(F.sum("n").alias("n")).sortWithinPartitions(*ORDER), name)
        return out.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], out

    def add(self, texts: DataFrame) -> None:
        self.add_entries(index(texts, self.text))

    def add_entries(self, entries: DataFrame) -> None:
        """A new batch: its array, the merge-scan against every level, and merges of levels of about equal size."""
        size, array = self._array(entries.select(*ORDER, "n"), "suffixes")
        if not size:
            return
        keys = array.groupBy("lead", "key").agg(F.sum("n").alias("places"))
        found = keys.where("places > 1").select("lead", "key")
        for _, level in self.levels:
            found = found.union(self._scan(keys.select("lead", "key"), level))
        self.hits.append(stage(found.distinct(), "hits"))
        while self.levels and self.levels[-1][0] < 2 * size:
            size, array = self._array(self.levels.pop()[1].union(array), "level")
        self.levels.append((size, array))

    @staticmethod
    def _scan(keys: DataFrame, level: DataFrame) -> DataFrame:
        return keys.join(level.select("lead", "key").hint("merge"), ["lead", "key"], "left_semi")

    def scan(self, texts: DataFrame) -> DataFrame:
        """Entries of a new batch whose key some level holds: lead, key, run, n, and whether the whole run is there."""
        _, mine = self._array(index(texts, self.text).select(*ORDER, "n"), "suffixes")
        out = None
        for _, level in self.levels:
            part = mine.join(self._scan(mine.select("lead", "key").distinct(), level), ["lead", "key"]).join(level.select(*ORDER, F.lit(True).alias("whole")), list(ORDER), "left")
            out = part if out is None else out.union(part)
        return out.groupBy(*ORDER, "n").agg(F.coalesce(F.bool_or("whole"), F.lit(False)).alias("whole"))

    def matches(self) -> DataFrame | None:
        """Entries whose key stands in more than one place: key, run, n (places of the run), runs (of the key)."""
        keys = every = None
        for hits in self.hits:
            keys = hits if keys is None else keys.union(hits)
        if keys is None:
            return None
        keys = keys.distinct()
        for _, level in self.levels:
            part = level.join(keys, ["lead", "key"])
            every = part if every is None else every.union(part)
        every = every.groupBy(*ORDER).agg(F.sum("n").alias("n"))
        runs = every.groupBy("lead", "key").agg(F.count(F.lit(1)).alias("runs"))
        return every.join(runs, ["lead", "key"]).select("key", "run", "n", "runs")


def _places(batches, wanted: np.ndarray | None):
    for batch in batches:
        buf, off = flat(batch.column(1))
        row, low, high, _, key, run = anchors(buf, off)
        if wanted is not None and len(wanted):
            at = np.searchsorted(wanted, key)
            at[at == len(wanted)] = 0
            ok = wanted[at] == key
            row, low, high, key, run = row[ok], low[ok], high[ok], key[ok], run[ok]
        yield pa.RecordBatch.from_pydict({"rid": batch.column(0).take(pa.array(row, pa.int64())), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64()), "key": pa.array(key.view(np.int64)), "run": pa.array(run.view(np.int64))})


def _stretches(batches, length: int = LENGTH):
    """The bytes of each wanted stretch."""
    for batch in batches:
        rids, texts, lists = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
        rows = []
        for i, (rid, wanted) in enumerate(zip(rids, lists, strict=True)):
            raw = texts[i].as_buffer().to_pybytes()
            rows += [(w["key"], w["n"], w["runs"], rid, w["low"], raw[w["low"] : w["high"] + length]) for w in wanted]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.binary()], strict=True)], names=["key", "n", "runs", "rid", "low", "bytes"])


def _starts(off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.maximum(np.diff(off) - length + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + off[row]


def repeated(buf: np.ndarray, off: np.ndarray, key: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, whether repeated under the row's key) of all strings of the rows."""
    row, start = _starts(off, length)
    twice = np.zeros(len(start), bool)
    if len(start) > 1:
        h = mix(string_hashes(buf, length, 67)[start] + mix(key.view(np.uint64))[row])
        order = np.argsort(h)
        h = h[order]
        near = np.flatnonzero(h[1:] == h[:-1])
        twice[order[near]] = twice[order[near + 1]] = True
    return row, start, twice


def _spans(table: pa.Table, length: int) -> pa.RecordBatch:
    buf, off = flat(table.column("bytes"))
    row, start, twice = repeated(buf, off, table.column("key").to_numpy(), length)
    once = table.column("n").to_numpy() == 1
    keep = np.flatnonzero(twice & once[row])
    row, start = row[keep], start[keep]
    new = np.flatnonzero((np.diff(start, prepend=-9) != 1) | (np.diff(row, prepend=-1) != 0))
    last = np.append(new[1:], len(row)) - 1 if len(new) else new
    low = table.column("low").to_numpy()[row[new]] - off[row[new]] if len(new) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_pydict({"rid": pa.array(table.column("rid").to_numpy()[row[new]], pa.int64()), "start": pa.array(start[new] + low, pa.int64()), "end": pa.array(start[last] + low + length, pa.int64())})


def _compare(batches, length: int = LENGTH):
    """Strings of all stretches of a key side by side; batches are sorted by key, groups are never cut."""
    held, size = [], 0

    def ready(final: bool):
        nonlocal held, size
        table = pa.Table.from_batches(held)
        key = table.column("key").to_numpy()
        cut = len(key) if final else int(np.searchsorted(key, key[-1]))
        if cut:
            yield _spans(table.slice(0, cut), length)
        held = table.slice(cut).combine_chunks().to_batches()
        size = sum(b.nbytes for b in held)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > CHUNK:
            yield from ready(False)
    if held:
        yield from ready(True)


def _hashes(batches, length: int = LENGTH):
    for batch in batches:
        buf, off = flat(batch.column("bytes"))
        row, start = _starts(off, length)
        h = string_hashes(buf, length, 67)[start] if len(start) else np.zeros(0, np.uint64)
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_pydict({"key": batch.column("key").take(at), "h": pa.array(h.view(np.int64)), "n": batch.column("n").take(at), "rid": batch.column("rid").take(at), "start": pa.array(batch.column("low").to_numpy()[row] + start - off[row] if len(row) else [], pa.int64())})


def _cut(batches):
    """Documents without their marked bytes."""
    for batch in batches:
        ids, texts, lists = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        rows = []
        for i, marks in enumerate(lists):
            raw = texts[i].as_buffer().to_pybytes()
            merged: list[list[int]] = []
            for a, b in sorted((m["start"], m["end"]) for m in marks):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            sha, at = hashlib.sha256(), 0
            for a, b in merged:
                sha.update(raw[at:a])
                at = b
            sha.update(raw[at:])
            rows.append((len(raw), sum(b - a for a, b in merged), len(merged), sha.hexdigest(), [x for ab in merged for x in ab]))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _side(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def marks(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(rid, start, end) byte ranges to remove; ``docs`` has rid and text."""
    spark = docs.sparkSession
    family = SuffixFamily()
    entries = stage(index(docs, "text", F.pmod("rid", F.lit(batches))), "entries")
    for b in range(batches):
        family.add_entries(entries.where(F.col("part") == b))
    found = family.matches()
    if found is None:
        return spark.createDataFrame([], "rid long, start long, end long")
    found = stage(found, "matches")
    keys = found.select("key").distinct()
    wanted = None
    if keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        got = keys.toArrow().column(0).to_numpy()
        wanted = spark.sparkContext.broadcast(np.sort(got.view(np.uint64)))

    def places(it):
        yield from tidy(_places(it, wanted.value if wanted else None))

    at = docs.select("rid", "text").mapInArrow(places, "rid long, low long, high long, key long, run long")
    at = stage(at.join(found, ["key", "run"]), "places")
    whole = at.where("n > 1").select("rid", F.col("low").alias("start"), (F.col("high") + LENGTH).alias("end"))
    one = at.where("runs > 1").groupBy("key", "run").agg(F.first("n").alias("n"), F.first("runs").alias("runs"), F.min(F.struct("rid", "low", "high")).alias("p"))
    lists = stage(one.groupBy(F.col("p.rid").alias("rid")).agg(F.collect_list(F.struct("key", "n", "runs", F.col("p.low").alias("low"), F.col("p.high").alias("high"))).alias("wanted")), "wanted")
    texts = docs.join(_side(lists.select("rid")), "rid", "left_semi").dropDuplicates(["rid"])
    texts = texts.join(lists, "rid").select("rid", "text", "wanted").mapInArrow(lambda it: tidy(_stretches(it)), "key long, n long, runs long, rid long, low long, bytes binary")
    texts = stage(texts, "stretches")
    ends = texts.where(F.col("runs") <= HOT).repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: tidy(_compare(it)), "rid long, start long, end long")
    out = whole.union(ends)
    if not texts.where(F.col("runs") > HOT).isEmpty():
        h = texts.where(F.col("runs") > HOT).mapInArrow(lambda it: tidy(_hashes(it)), "key long, h long, n long, rid long, start long")
        twice = h.groupBy("key", "h").agg(F.sum("n").alias("t")).where("t > 1").select("key", "h")
        out = out.union(h.where("n = 1").join(twice, ["key", "h"]).select("rid", "start", (F.col("start") + LENGTH).alias("end")))
    return out


def digest(docs: DataFrame, text: str = "text", batches: int = BATCHES) -> DataFrame:
    """A row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (starts and ends in turn)."""
    small_batches(docs.sparkSession, 1024)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = slim.withColumn("rid", F.xxhash64("doc_id", "text"))
    by = stage(marks(slim, batches).groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("marks")), "marks")
    ids = _side(by.select("rid"))
    clean = slim.join(ids, "rid", "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.array().cast("array<long>").alias("spans"))
    cut = slim.join(ids, "rid", "left_semi").join(by, "rid").select("doc_id", "text", "marks").mapInArrow(lambda it: tidy(_cut(it)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    return clean.unionByName(cut)
