"""Elias-Fano coding of monotone integers, with a select structure over the upper bits."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQBQQ")  # values, universe, lower bits, bytes of lower bits, bytes of upper bits
SAMPLE = 256


class EliasFano:
    """About 2 + log2(universe / n) bits a value, and one 32-bit sample every ``SAMPLE`` values for select."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray | None = None):
        self.n, self.universe, self.low_bits, self.low, self.high = n, universe, low_bits, low, high
        if samples is None:
            ones = np.flatnonzero(np.unpackbits(high, bitorder="little"))[:: SAMPLE]
            samples = ones.astype(np.uint32)
        self.samples = samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        if len(v) and (v[0] < 0 or (np.diff(v) < 0).any()):
            raise ValueError("values must be monotone and not negative")
        n, universe = len(v), int(v[-1]) + 1 if len(v) else 0
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = np.packbits((((v[:, None] >> np.arange(bits)) & 1).astype(np.uint8)).ravel(), bitorder="little") if bits else np.zeros(0, np.uint8)
        high = np.zeros((n + (universe >> bits) + 8) // 8, np.uint8)
        at = (v >> bits) + np.arange(n)
        np.bitwise_or.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return cls(n, universe, bits, low, high)

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.universe, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, universe, bits, a, b = _HEAD.unpack_from(raw)
        at = _HEAD.size
        take = lambda start, count, kind: np.frombuffer(raw, kind, count, start)
        return cls(n, universe, bits, take(at, a, np.uint8), take(at + a, b, np.uint8), take(at + a + b, -(-n // SAMPLE), np.uint32))

    def slice(self, i: int, j: int) -> np.ndarray:
        """Values i to j-1: from the sample before i, over the upper bits that hold them alone."""
        j = min(j, self.n)
        if i >= j:
            return np.zeros(0, np.int64)
        s = i // SAMPLE
        first = int(self.samples[s]) >> 3
        e = -(-j // SAMPLE)
        last = (int(self.samples[e]) >> 3) + 1 if e < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little")) + 8 * first
        ones = ones[np.searchsorted(ones, self.samples[s]) :][i - s * SAMPLE : j - s * SAMPLE]
        v = (ones - np.arange(i, j)).astype(np.int64) << self.low_bits
        if self.low_bits:
            a, b = i * self.low_bits, j * self.low_bits
            raw = np.unpackbits(self.low[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a]
            v |= raw.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return v

    def select(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def __len__(self) -> int:
        return self.n
