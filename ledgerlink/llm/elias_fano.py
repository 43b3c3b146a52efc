"""Elias-Fano code for a non-decreasing sequence, with sampled select."""

from __future__ import annotations

import struct

import numpy as np

#: After so many ones of the high bits, a select sample holds the position of the next.
SAMPLE = 512
_HEAD = struct.Struct("<qQQB")  # first value, count, universe, low bits


def encode(values: np.ndarray) -> bytes:
    """Code of non-decreasing int64 values: about 2 + log2(range / count) bits each."""
    v = np.asarray(values, np.int64)
    n = len(v)
    if n == 0:
        return _HEAD.pack(0, 0, 0, 0)
    if (np.diff(v) < 0).any():
        raise ValueError("values must not decrease")
    u = (v - v[0]).astype(np.uint64)
    universe = int(u[-1]) + 1
    low = max(0, (universe // n).bit_length() - 1)
    ones = (u >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    lows = ((u[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    packed_low, packed_high = np.packbits(lows, bitorder="little"), np.packbits(high, bitorder="little")
    samples = ones[::SAMPLE].astype("<u4")
    return b"".join((_HEAD.pack(int(v[0]), n, universe, low), samples.tobytes(), packed_low.tobytes(), packed_high.tobytes()))


class EliasFano:
    def __init__(self, data: bytes):
        self.first, self.n, self.universe, self.low = _HEAD.unpack_from(data)
        at = _HEAD.size
        n_samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", n_samples, at)
        at += 4 * n_samples
        n_low = -(-self.n * self.low // 8)
        self.lows = np.frombuffer(data, np.uint8, n_low, at)
        self.high = np.frombuffer(data, np.uint8, -1, at + n_low)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.select_run(i, 1)[0])

    def select_run(self, i: int, n: int) -> np.ndarray:
        """The n values from the i-th on (fewer at the end), from one sample and the bits up to the sample after them."""
        n = max(0, min(n, self.n - i))
        if not n:
            return np.zeros(0, np.int64)
        at, after = int(self.samples[i // SAMPLE]), (i + n - 1) // SAMPLE + 1
        stop = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        bits = np.unpackbits(self.high[at // 8 : stop], bitorder="little")
        bits[: at % 8] = 0
        skip = i % SAMPLE
        out = np.flatnonzero(bits)[skip : skip + n] + (at // 8 * 8 - i) - np.arange(n) << self.low
        if self.low:
            start = i * self.low
            bits = np.unpackbits(self.lows[start // 8 : (start + n * self.low + 7) // 8], bitorder="little")[start % 8 :][: n * self.low]
            out += bits.reshape(n, self.low).astype(np.int64) @ (np.int64(1) << np.arange(self.low, dtype=np.int64))
        return out + self.first
