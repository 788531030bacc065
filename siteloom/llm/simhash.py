"""SimHash bits from whole texts, vectorised over numpy arrays.

Two fingerprints live here. :func:`weighted_fingerprint` is the general one: terms
are word 3-grams, each term votes with a whole-number weight that grows with the
logarithm of its count, on 128 signed bits. :func:`majority_fingerprint` is the
plain 64-bit one: every word shingle, repeats included, votes once with its XXH64.
"""

from __future__ import annotations

import numpy as np
import xxhash

_BLOCK = 4096
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_TABLE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0x5851F42D4C957F2D
_GRAM = np.array([1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(9, 14)]] = True


class _Powers:
    """Powers of an odd step and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            inverse = pow(_STEP, -1, 1 << 64)
            for name, step in (("up", _STEP), ("down", inverse)):
                steps = np.full(size, step, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word of UTF-8 ``data``, in order, without a Python loop."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~_SPACE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _POWERS.to(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[:-1], out=total[1:])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values and where each begins in the sorted array; faster than ``np.unique`` on few."""
    h = np.sort(h)
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[first], first


def terms(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word 3-grams as hashes, and their weights 16 * (1 + ln count), rounded.

    A text of one or two words has one term, the whole sequence; an empty one none.
    """
    w = word_hashes(data)
    if not len(w):
        return w, np.empty(0, np.int64)
    k = min(3, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h += w[i : len(w) - k + 1 + i] * _GRAM[i]
    total = len(h)
    h, first = distinct(h)
    n = np.diff(np.r_[first, total])
    return h, np.rint(16 * (1 + np.log(n))).astype(np.int64)


def _sums(rows: np.ndarray) -> np.ndarray:
    """For each bit, how many of ``rows`` have it minus how many do not."""
    n, words = rows.shape
    total = np.zeros(words * 64, np.int64)
    for at in range(0, n, _BLOCK):
        part = rows[at : at + _BLOCK]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), words * 8), axis=1)
        for k in range(0, len(part), 255):  # so many ones at most fit a byte
            total += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return 2 * total - n


def vote(rows: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Signed vote on each bit of ``rows`` (uint64, one line a term, one column a word of bits).

    Whole weights are added up by groups of like weight, so the sum is exact in any order.
    """
    if weights is None:
        return _sums(rows)
    total = np.zeros(rows.shape[1] * 64, np.int64)
    for w in np.unique(weights):
        total += int(w) * _sums(rows[weights == w])
    return total


def weighted_fingerprint(data: bytes) -> bytes:
    """16 bytes: the signs of the weighted votes; all zero without a word."""
    h, weights = terms(data)
    if not len(h):
        return bytes(16)
    rows = np.stack([_mix(h), _mix(h ^ np.uint64(0xD6E8FEB86659FD93))], axis=1)
    return np.packbits(vote(rows, weights) > 0).tobytes()


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``width``-word shingle, A-Z in lower case, joined by spaces.

    Fewer words than ``width``: one shingle, the whole sequence. None: no shingle.
    """
    words = data.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends[: len(words) - width + 1] - np.fromiter(map(len, words[: len(words) - width + 1]), np.int64)) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist())], np.uint64)


def majority_fingerprint(data: bytes, width: int = 4) -> int:
    """A bit is 1 if more than half of the shingle hashes have it; zero without a word."""
    h = shingle_hashes(data, width)
    if not len(h):
        return 0
    return int.from_bytes(np.packbits(vote(h.reshape(-1, 1)) > 0).tobytes(), "big")


def hamming(a: bytes, b: bytes) -> int:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
