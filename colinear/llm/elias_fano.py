"""Elias-Fano sequences in plain byte blobs, read through memory maps by vectorised numpy."""

from __future__ import annotations

import json

import numpy as np

_ONE = np.uint64(1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _low_bits(v: np.ndarray, low: int) -> np.ndarray:
    """The low bits of every value, one value's after another: 64 values fill `low` words, and the k-th of each 64 is laid at once."""
    rows = -(-len(v) // 64)
    values, words = np.zeros(rows * 64, np.uint64), np.zeros((low, rows), np.uint64)
    values[: len(v)] = v & np.uint64((1 << low) - 1)
    values = np.ascontiguousarray(values.reshape(rows, 64).T)
    for k in range(64 if low else 0):
        word, shift = divmod(k * low, 64)
        words[word] |= values[k] << np.uint64(shift)
        if shift + low > 64:
            words[word + 1] |= values[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).view(np.uint8).ravel()[: (len(v) * low + 7) // 8]


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one blob, each at a multiple of 8 bytes."""
    head, at, parts = {}, 0, []
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x).tobytes()
        head[name] = (x.dtype.str, len(x), at)
        raw += b"\0" * (-len(raw) % 8)
        parts.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def unpack(raw: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a blob as views into raw (uint8)."""
    n = int(raw[:8].view(np.uint64)[0])
    body = raw[8 + n :]
    return {k: body[at : at + size * np.dtype(kind).itemsize].view(kind) for k, (kind, size, at) in json.loads(raw[8 : 8 + n].tobytes()).items()}


def encode(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence below universe: low bits packed, high bits in unary, zeros counted by word."""
    n = len(values)
    low = max(0, min(57, (max(1, universe) // max(1, n)).bit_length() - 1))
    v = values.astype(np.uint64)
    lows = np.concatenate([_low_bits(v, low), np.zeros(16, np.uint8)])
    high = (v >> np.uint64(low)).astype(np.int64)
    size = n + (max(0, universe - 1) >> low) + 1
    unary = np.zeros(size + -size % 64, np.uint8)
    unary[high + np.arange(n)] = 1
    words = np.packbits(unary, bitorder="little").view(np.uint64)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
    return {f"{name}.low": lows, f"{name}.high": words, f"{name}.ones": ones.astype(np.uint32 if n < 1 << 32 else np.uint64), f"{name}.meta": np.array([n, low, max(0, universe - 1)], np.uint64)}


class Sequence:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.width, self.last = (int(x) for x in arrays[f"{name}.meta"])
        low = arrays[f"{name}.low"]
        self.low = np.ndarray((len(low) - 7,), np.uint64, buffer=low, strides=(1,))  # the 8 bytes from each byte on
        self.high, self.ones = arrays[f"{name}.high"], arrays[f"{name}.ones"]
        self.mask = np.uint64((1 << self.width) - 1)
        self._zeros: np.ndarray | None = None

    def _lows(self, i: np.ndarray) -> np.ndarray:
        bit = i.astype(np.int64) * self.width
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    @staticmethod
    def _in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 1) set bit."""
        at = np.zeros(len(word), np.uint64)
        left = k.astype(np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count((word >> at) & np.uint64((1 << width) - 1)).astype(np.int64)
            on = left > c
            left -= c * on
            at += np.uint64(width) * on.astype(np.uint64)
        return at.astype(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        if not len(i):
            return np.zeros(0, np.uint64)
        k = i.astype(np.int64) + 1
        word = np.searchsorted(self.ones, k.astype(self.ones.dtype), "left") - 1
        place = word * 64 + self._in_word(self.high[word], k - self.ones[word].astype(np.int64))
        return ((place - i).astype(np.uint64) << np.uint64(self.width)) | self._lows(i)

    def _before(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have high bits below bucket: ones before the bucket-th zero."""
        if self._zeros is None:
            self._zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones.astype(np.int64)
        zeros = self._zeros
        k = np.maximum(bucket, 1)
        word = np.searchsorted(zeros, k, "left") - 1
        place = word * 64 + self._in_word(self.high[word] ^ _FULL, k - zeros[word])
        return np.where(bucket == 0, 0, place - (k - 1))

    def _bucket(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first index, end) of the values with these high bits: between the bucket-th zero and the next one."""
        if self._zeros is None:
            self._zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones.astype(np.int64)
        k = np.maximum(bucket, 1)
        word = np.searchsorted(self._zeros, k, "left") - 1
        off = self._in_word(self.high[word] ^ _FULL, k - self._zeros[word]) + 1
        some = bucket > 0
        word, off = np.where(some, word, 0), np.where(some, off, 0)
        lo = word * 64 + off - bucket
        # the next zero is in the same word more often than not
        rest = np.where(off < 64, (self.high[word] ^ _FULL) >> np.minimum(off, 63).astype(np.uint64), 0).astype(np.uint64)
        run = np.bitwise_count((rest & (~rest + _ONE)) - _ONE).astype(np.int64)
        end = lo + run
        far = np.flatnonzero(rest == 0)
        if len(far):
            end[far] = self._before(bucket[far] + 1)
        return lo, end

    def _reach(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first value at x or above among those of the same high bits, or of the next bucket; that bucket's end)."""
        lo, end = self._bucket(np.minimum((x >> np.uint64(self.width)).astype(np.int64), self.last >> self.width))
        want, hi = x & self.mask, end.copy()
        at = np.flatnonzero(lo < hi)
        while len(at):  # binary search among the low bits of the bucket
            mid = (lo[at] + hi[at]) >> 1
            less = self._lows(mid) < want[at]
            lo[at[less]] = mid[less] + 1
            hi[at[~less]] = mid[~less]
            at = at[lo[at] < hi[at]]
        return lo, end

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value at x or above, n if there is none."""
        if not len(x) or not self.n:
            return np.zeros(len(x), np.int64)
        return np.where(x > np.uint64(self.last), self.n, self._reach(x)[0])

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, present) of values."""
        if not len(x) or not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        i, end = self._reach(x)
        return i, (i < end) & (x <= np.uint64(self.last)) & (self._lows(np.minimum(i, self.n - 1)) == x & self.mask)
