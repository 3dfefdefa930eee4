"""Token ids as binary shards: a concatenated id array and Elias-Fano document boundaries.

Documents are dealt by ranges of doc_id and sorted inside a range, so shards in order are the ids in ascending doc_id
order. A task streams its documents: ids go to the file as they come; boundaries and document ids follow as Elias-Fano
lists, then a footer. A file is written under a name of the attempt and then renamed, so a lost executor's task is
simply run again. One row a shard (path, counts) tells where each begins.

File: ids (16 bits each where the vocabulary allows, else 32) | boundaries | doc ids | footer.

Defined results: null text is an empty text and holds the end id alone; null doc_ids come first; rows with equal doc_id
lie together, ordered by a hash of the text and the text; negative doc_ids are stored with an offset; an empty table writes no file and reads as
an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import flat, release, shared_dir, small_batches, stage, tidy
from marlstone.llm.elias_fano import EliasFano

_FOOT = struct.Struct("<QQQQqBB6s")  # ids, documents, null doc ids, bytes of boundaries, least doc id, bytes an id, version, mark
MARK = b"ELFTOK"
END_ID = 2
def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Kinds of bytes, for cutting a text where byte-level BPE always cuts it. Bytes of one character share its kind.
WHITE, LETTER, DIGIT, OTHER, UNSURE, QUOTE, SOLID = range(7)
_ONE = re.compile(r" ?[^\s\x1c-\x1f\x85]+\Z")
_SLAB = 4 << 20


def _kinds_of_bytes() -> np.ndarray:
    """By first byte of a character: SOLID is surely no white space, UNSURE may be."""
    k = np.full(256, OTHER, np.uint8)
    k[[9, 10, 11, 12, 13, 32]] = WHITE
    k[0x1C:0x20] = UNSURE
    k[[*range(65, 91), *range(97, 123)]] = LETTER
    k[48:58] = DIGIT
    k[39] = QUOTE
    k[128:] = SOLID
    k[0xC3:0xCA] = LETTER  # Latin
    k[0xD0:0xD2] = LETTER  # Cyrillic; U+0482 stands behind them
    return k


_KIND = _kinds_of_bytes()


def kinds(buf: np.ndarray) -> np.ndarray:
    """The kind of each byte of whole characters."""
    k = _KIND[buf]
    if len(buf) and buf.max() >= 128:
        nxt = np.append(buf[1:], np.uint8(0))
        # the characters that are white space beyond ASCII, and the two Latin signs among letters
        for lead, second, kind in ((0xC2, (0x85, 0xA0), UNSURE), (0xE1, (0x9A,), UNSURE), (0xE2, (0x80, 0x81), UNSURE), (0xE3, (0x80,), UNSURE), (0xC3, (0x97, 0xB7), OTHER)):
            at = np.flatnonzero(buf == lead)
            k[at[np.isin(nxt[at], second)]] = kind
        inner = (buf & 0xC0) == 0x80
        first = np.maximum.accumulate(np.where(inner, 0, np.arange(len(buf))))
        k = k[first]
    return k


def cuts(buf: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces may begin: at ``begins`` (starts of rows), between letters, digits and signs, at runs of white space,
    before the last of several white spaces, and after one that is no blank."""
    k = kinds(buf)
    n = len(buf)
    row = np.zeros(n + 1, bool)
    row[begins[begins < n]] = True
    solid = (k != WHITE) & (k != UNSURE)
    plain = (k == LETTER) | (k == DIGIT) | (k == OTHER)
    white = k == WHITE
    out = row[:n].copy()
    if n > 1:
        out[1:] |= plain[1:] & plain[:-1] & (k[1:] != k[:-1])
        out[1:] |= white[1:] & solid[:-1]
        out[1:] |= solid[1:] & white[:-1] & (buf[:-1] != 32)
        out[1:-1] |= white[1:-1] & white[:-2] & solid[2:] & ~row[2:n]
    return out


class Encoder:
    """Texts through the tokenizers library. Byte-level BPE never joins what its pattern parts, so a batch is cut at
    places where the pattern always parts (``cuts``), distinct pieces are told apart by Arrow's dictionary, and each
    new one goes through the library once, many in a call. A text that holds a special token, and any text of a
    vocabulary of another kind, goes through the library as it is."""

    def __init__(self, vocabulary: str, most: int = 400_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(vocabulary)
        self.most = most
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.simple = self._is_byte_level()
        line = self._ids("\n")
        self.line = line[0] if len(line) == 1 else -1
        self._clear()

    def _is_byte_level(self) -> bool:
        import json

        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        bare = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or [])
        return bare and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0
        self.at, self.size, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Keep the ids of some pieces; their first number."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(sizes) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[self.n : self.n + len(sizes)] = sizes
        self.at[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.n += len(sizes)
        return self.n - len(sizes)

    def _learn(self, pieces: list[bytes]) -> None:
        texts = [p.decode() for p in pieces]
        joined = [i for i, t in enumerate(texts) if _ONE.match(t)] if self.line >= 0 else []
        alone = sorted(set(range(len(texts))).difference(joined))
        for i in range(0, len(joined), 8192):
            own = joined[i : i + 8192]
            groups = [own[j : j + 256] for j in range(0, len(own), 256)]
            # pieces on lines of their own: a line end is a piece by itself
            for g, e in zip(groups, self.tok.encode_batch_fast(["\n".join([texts[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.int64)
                ends = np.append(np.flatnonzero(ids == self.line), len(ids))
                if len(ends) != len(g):
                    alone += g
                    continue
                first = self._store(ids[ids != self.line], np.diff(ends, prepend=-1) - 1)
                self.known.update((pieces[k], first + j) for j, k in enumerate(g))
        for k in alone:
            ids = self._ids(texts[k])
            self.known[pieces[k]] = self._store(np.array(ids, np.int64), np.array([len(ids)]))

    def _pieces(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, place) of each piece of a buffer of rows, in slabs of bounded size."""
        numbers, places = [], []
        begin, n, width = 0, len(buf), _SLAB
        while begin < n:
            stop = min(n, begin + width)
            inside = np.append(0, off[np.searchsorted(off, begin) : np.searchsorted(off, stop, "right")] - begin)
            start = np.flatnonzero(cuts(buf[begin:stop], inside))
            if stop < n:  # the last bytes may be half a character, or lack what follows them
                start = start[start <= stop - begin - 8]
                if len(start) < 2:
                    width *= 2
                    continue
                stop = begin + int(start[-1])
                start = start[:-1]
            width = _SLAB
            ends = np.append(start[1:], stop - begin).astype(np.int32)
            offsets = np.concatenate([start[:1].astype(np.int32), ends])
            found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf[begin:stop]))]).dictionary_encode()
            words = found.dictionary.to_numpy(zero_copy_only=False).tolist()
            code = np.array(list(map(self.known.get, words, repeat(-1))), np.int64)
            if len(new := np.flatnonzero(code < 0)):
                self._learn([words[k] for k in new])
                code[new] = [self.known[words[k]] for k in new]
            numbers.append(code[found.indices.to_numpy()].astype(np.int32))
            places.append(start + begin)
            begin = stop
        return (np.concatenate(numbers), np.concatenate(places)) if numbers else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def rows(self, col: pa.Array, end_id: int):
        """Ids of the rows of a column, each with the end id: first the places of their ends, then the ids in parts."""
        if self.n > self.most:
            self._clear()
        buf, off = flat(col)
        n = len(off) - 1
        whole = np.full(n, not self.simple)
        if self.simple and self.special:
            raw = buf.tobytes()
            for word in self.special:
                hit = raw.find(word)
                while hit >= 0:
                    whole[np.searchsorted(off, hit, "right") - 1] = True
                    hit = raw.find(word, hit + 1)
            del raw
        if whole.any():
            keep = ~whole
            size = np.diff(off)
            rest = np.concatenate([[0], np.cumsum(np.where(keep, size, 0))])
            number, place = self._pieces(buf[np.repeat(keep, size)], rest)
            row = np.searchsorted(rest, place, "right") - 1
            own = np.flatnonzero(whole)
            extra = []
            for i in own:
                ids = self._ids(buf[off[i] : off[i + 1]].tobytes().decode())
                extra.append(self._store(np.array(ids, np.int64), np.array([len(ids)])))
            order = np.argsort(np.concatenate([row, own]), kind="stable")
            number, row = np.concatenate([number, np.array(extra, np.int32)])[order], np.concatenate([row, own])[order]
        else:
            number, place = self._pieces(buf, off)
            row = np.searchsorted(off, place, "right") - 1
        last = self._store(np.array([end_id]), np.array([1]))
        at = np.searchsorted(row, np.arange(n), "right")
        number = np.insert(number, at, last)
        size = self.size[number]
        yield np.cumsum(size)[at + np.arange(n)]
        for i in range(0, len(number), 500_000):
            s = size[i : i + 500_000]
            begin = self.at[number[i : i + 500_000]] - (np.cumsum(s) - s)
            yield self.ids[np.repeat(begin, s) + np.arange(s.sum())]


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _gathered(batches, most: int):
    """Batches put together to about ``most`` bytes: the larger they are, the fewer distinct pieces are told apart."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _write_shard(batches, folder: str, vocabulary: str, end_id: int):
    from pyspark import TaskContext

    ctx = TaskContext.get()
    enc = encoder(vocabulary)
    store, root = _store(folder)
    name, out, ends, own, total, nulls, n_docs = f"{root}/shard-{ctx.partitionId():06d}.bin", None, [], [], 0, 0, 0
    spare = f"{root}/.{ctx.taskAttemptId()}-{uuid.uuid4().hex}"
    for batch in _gathered(batches, _SLAB):
        if out is None:
            store.create_dir(root, recursive=True)
            out = store.open_output_stream(spare)
        nulls += batch.column(0).null_count
        own.append(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        n_docs += batch.num_rows
        places, *parts = enc.rows(batch.column(1), end_id)
        ends.append(places + total)
        for ids in parts:
            out.write(ids.tobytes())
        total = int(ends[-1][-1])
    if out is None:
        return
    own = np.concatenate(own)
    least = int(own[0]) if len(own) else 0
    bounds = EliasFano.encode(np.concatenate(ends)).to_bytes()
    out.write(bounds)
    out.write(EliasFano.encode(own - least).to_bytes())
    out.write(_FOOT.pack(total, n_docs, nulls, len(bounds), least, enc.kind.itemsize, 1, MARK))
    out.close()
    store.move(spare, name)
    yield pa.RecordBatch.from_pydict({"shard": pa.array([ctx.partitionId()], pa.int64()), "path": [f"{folder}/shard-{ctx.partitionId():06d}.bin"], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([total], pa.int64())})


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """Write the shards under ``folder`` (a shared one); a row a shard: shard, path, n_docs, n_ids, start (ids before it)."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # rows of one id, or of none, are still many ranges: ties are parted by text
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def task(batches):
        yield from tidy(_write_shard(batches, folder, vocabulary, end_id))

    shards = stage(rows.mapInArrow(task, "shard long, path string, n_docs long, n_ids long"), "token-shards")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return shards.withColumn("start", F.coalesce(before, F.lit(0)))


class Shard:
    """Random access to one file: documents by place, their ids by the boundaries' select."""

    def __init__(self, path: str):
        store, at = _store(path)
        self.file = store.open_input_file(at)
        size = self.file.size()
        foot = self.file.read_at(_FOOT.size, size - _FOOT.size)
        self.n_ids, self.n_docs, self.nulls, bounds, self.least, self.width, _, mark = _FOOT.unpack(foot)
        if mark != MARK:
            raise ValueError(f"{path} is no token shard")
        at = self.n_ids * self.width
        self.ends = EliasFano.from_bytes(self.file.read_at(bounds, at))
        self.docs = EliasFano.from_bytes(self.file.read_at(size - _FOOT.size - at - bounds, at + bounds))

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        n = self.nulls
        return [None] * (min(j, n) - min(i, n)) + (self.docs.slice(max(i - n, 0), max(j - n, 0)) + self.least).tolist()

    def bounds(self, i: int, j: int) -> np.ndarray:
        """The starts of documents i to j-1, and the last one's end."""
        ends = self.ends.slice(max(i - 1, 0), j)
        return ends if i else np.concatenate([[0], ends])

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, start * self.width), f"<u{self.width}")


def _read_shards(batches, portion: int):
    _encoders.clear()  # what writing has cached is of no use from here on
    release()
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = Shard(path)
            for i in range(0, s.n_docs, portion):
                j = min(i + portion, s.n_docs)
                b = s.bounds(i, j)
                ids = s.ids(int(b[0]), int(b[-1])).astype("<u4")
                at = b - b[0]
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(s.doc_ids(i, j), pa.int64()), "start": pa.array(b[:-1] + start, pa.int64()), "n_tokens": pa.array(np.diff(b), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})


def read(shards: DataFrame, portion: int = 256) -> DataFrame:
    """From the files: a row a document with doc_id, start, n_tokens and ids_crc32."""

    def task(batches):
        yield from tidy(_read_shards(batches, portion))

    n = min(max(shards.count(), 1), 4096)  # a task a shard
    return shards.select("path", "start", "shard").repartitionByRange(n, "shard").select("path", "start").mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
