"""Words of UTF-8 bytes. bytes.lower() folds A-Z only and bytes.split() cuts at space and 09-0D only, as the contracts ask."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: ASCII except digits and letters becomes a space, A-Z becomes a-z, all other bytes stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(text: bytes | None) -> list[bytes]:
    """Lower-cased words between white space; null has none."""
    return text.lower().split() if text else []


def alnum(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII digits, ASCII letters and non-ASCII characters; null has none."""
    return text.translate(FOLD).split() if text else []


def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of k words joined by a space; fewer words: of all of them; none: empty."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= k:
        return np.array([digest(joined, seed)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: n - k + 1].tolist(), end[k - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last)), np.uint64, n - k + 1)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte at each place of a word (places repeat from 256 on, with another factor).
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256 * 256, np.uint64)
_BLOCK = 1_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers with their bits spread (uint64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of plain(), one text's after another, how many each text has): tabulation hashing of whole texts at once."""
    hashes, counts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(texts):
        start, size = at, 0
        while at < len(texts) and size < _BLOCK:
            size, at = size + len(texts[at] or b""), at + 1
        own = [t or b"" for t in texts[start:at]]
        data = np.frombuffer((b" ".join(own) + b" ").lower(), np.uint8)
        inside = ~_SPACES[data]
        begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        sizes = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) - begins + 1
        counts.append(np.diff(np.searchsorted(begins, np.cumsum([len(t) + 1 for t in own])), prepend=0))
        if not len(begins):
            continue
        offsets = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(offsets, sizes)
        values = _TABLE[(place & 255) << 8 | data[inside]]
        if sizes.max() > 256:
            values = values * ((place >> 8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C14) + np.uint64(1))
        hashes.append(mixed(np.add.reduceat(values, offsets) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(hashes), np.concatenate(counts)


def hashed_shingles(words: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the 64-bit hash of every run of k of its words; fewer words: of all of them; none: empty."""
    factors = mixed(np.arange(1, k + 1, dtype=np.uint64))
    n = max(0, len(words) - k + 1)
    sums = np.zeros(n, np.uint64)
    for i in range(k):
        sums += words[i : i + n] * (factors[i] | np.uint64(1))
    sums = mixed(sums)
    ends = np.cumsum(counts)
    out = []
    for begin, end in zip((ends - counts).tolist(), ends.tolist()):
        size = end - begin
        out.append(sums[begin : end - k + 1] if size >= k else mixed((words[begin:end] * (factors[:size] | np.uint64(1))).sum(keepdims=True, dtype=np.uint64) + np.uint64(size)) if size else sums[:0])
    return out
