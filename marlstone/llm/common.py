"""Helpers shared by the corpus operators: shared storage, byte-level numpy text tools."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of anything but ASCII white space, in Java, RE2 and Python alike.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of whole texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release() -> None:
    """Hand freed memory back to the system: Python workers outlive their tasks and share an executor's limit."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(batches):
    """A task's batches; its memory is released at the end."""
    try:
        yield from batches
    finally:
        release()


# -- flat byte buffers -------------------------------------------------------

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _lut(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for i, base in enumerate((_B, _BINV)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _pow[i] = np.cumprod(p)
    return _pow[0][:n], _pow[1][:n]


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 7, most: int = 1 << 20) -> np.ndarray:
    """64-bit fingerprints of byte ranges: each run of eight bytes is mixed with a key of its place, the results are
    added and mixed with the length. Ranges of up to eight bytes and equal length never collide; longer ones do by
    chance alone (no polynomial, so no string has a partner that collides under every key)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(16, np.uint8)]).tobytes(), 0, (1,))
    size = (end - start).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = eight[start]
        x &= _KEEP[np.minimum(size, np.uint64(8)).astype(np.intp)]
        out = mix(x ^ _place(np.uint64(0), seed))
        long = np.flatnonzero(size > np.uint64(8))
        begin, left = start[long] + 8, size[long].astype(np.int64) - 8
        blocks = (left + 7) >> 3
        ends = np.concatenate([[0], np.cumsum(blocks)])
        for i, j in portions(ends, most) if len(long) else ():
            n = blocks[i:j]
            first = np.cumsum(n) - n
            k = np.arange(n.sum()) - np.repeat(first, n)
            x = eight[np.repeat(begin[i:j], n) + (k << 3)]
            x[first + n - 1] &= _KEEP[left[i:j] - ((n - 1) << 3)]
            x = mix(x ^ _place((k + 1).astype(np.uint64), seed))
            out[long[i:j]] += np.add.reduceat(x, first)
        return mix(out + size * _B)


#: The lowest n bytes of eight.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _place(k: np.ndarray, seed: int) -> np.ndarray:
    return mix(k * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))


class Rolling:
    """Cheap fingerprints of every range of a width, to choose places by; they decide no equality."""

    def __init__(self, buf: np.ndarray, seed: int = 7):
        p, self._inv = _powers(len(buf) + 1)
        self._sum = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_lut(seed)[buf] * p[:-1], out=self._sum[1:])

    def of(self, width: int) -> np.ndarray:
        if len(self._sum) <= width:
            return np.zeros(0, np.uint64)
        return mix((self._sum[width:] - self._sum[:-width]) * self._inv[: len(self._sum) - width])


_P31 = np.uint64((1 << 31) - 1)


def _fold(x: np.ndarray) -> np.ndarray:
    """Less bits of the same residue."""
    return (x & _P31) + (x >> np.uint64(31))


def _mod31(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(_fold(x)))
    x[x >= _P31] -= _P31
    return x


@lru_cache(maxsize=16)
def _powers31(base: int, n: int) -> np.ndarray:
    out, have = np.ones(n, np.uint64), 1
    step = base
    while have < n:  # twice as many at a time
        more = min(have, n - have)
        out[have : have + more] = _mod31(out[:more] * np.uint64(step))
        have += more
        step = step * step % int(_P31)
    return out


def string_hashes(buf: np.ndarray, width: int, seed: int = 7, at_once: int = 1 << 15) -> np.ndarray:
    """62-bit fingerprints of every range of ``width`` bytes: polynomials at two random places modulo the prime 2**31 - 1."""
    n = max(len(buf) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    rng = np.random.default_rng(seed)
    prime, size = int(_P31), at_once + width
    for _ in range(2):
        base, table = int(rng.integers(1 << 20, prime - 1)), rng.integers(1, prime, 256, dtype=np.uint64)
        up, down = _powers31(base, size), _powers31(pow(base, -1, prime), size)
        for i in range(0, n, at_once):  # arrays that stay in the cache
            own = buf[i : i + at_once + width - 1]
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(_fold(table[own] * up[: len(own)]), out=sums[1:])
            value = _fold(_fold(sums[width:] - sums[:-width]))
            value *= down[: len(value)]  # every range brought to the first one's power
            out[i : i + at_once] <<= np.uint64(31)
            out[i : i + at_once] |= _mod31(value)
    return out


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def portions(off: np.ndarray, most: int = 2_000_000):
    """Row ranges of at most ``most`` bytes (or a single row), so that work arrays stay bounded."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each row): the words of each row of a buffer."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~_WS[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)
