"""Vantage-point trees over fingerprints of 64 bits a word.

A node has a vantage point and a threshold m on the distance within its bit range:
fingerprints up to m go left, larger ones right. A pair within ``r`` of each other can
only straddle it if the right one is at most m + r away, so that overlap also goes left;
nothing else is copied, nothing is lost. Leaves are shards.

A tree is planned from a bounded sample (``SAMPLE``); the sample moves thresholds, that
is balance, and never decides which pairs meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Distinct fingerprints that trees are planned on; the shard size that planning aims at.
SAMPLE, SHARD = 8192, 2048
_LEAST = 48  # below so many sampled fingerprints, shares come from the binomial law instead


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits over the last axis, word by word."""
    n = x.shape[-1]
    total = np.bitwise_count(x[..., 0] ^ y[..., 0])
    if n > 3:
        total = total.astype(np.int16)
    for k in range(1, n):
        total = total + np.bitwise_count(x[..., k] ^ y[..., k])
    return total


class Forest:
    """Vantage-point trees on bit ranges; ``route`` gives the shards of each fingerprint.

    ``r``, the bound within a range, is ``radius // parts`` unless given.
    """

    def __init__(self, sample: np.ndarray, count: int, radius: int, parts: int, shard: int = SHARD, seed: int = 7, r: int | None = None) -> None:
        self.words, self.radius, self.r = sample.shape[1], radius, radius // parts if r is None else r
        bits = 64 * self.words
        edges = [bits * i // parts for i in range(parts + 1)]
        self.nodes: list[tuple] = []  # (vantage, mask, m, left, right), or (shard number,)
        self.ranges: list[tuple[np.ndarray, int]] = []  # of each shard: mask and width of its bit range
        rng = np.random.default_rng(seed)
        self.roots = []
        for a, b in zip(edges, edges[1:], strict=False):
            mask = np.packbits((np.arange(bits) >= a) & (np.arange(bits) < b)).view(">u8").astype(np.uint64)
            self.roots.append(self._grow(sample, float(count), mask, b - a, shard, rng))

    @classmethod
    def within(cls, x: np.ndarray, mask: np.ndarray, width: int, r: int, shard: int) -> Forest:
        """A tree over the rows of one shard, which goes on in the shard's bit range."""
        tree = cls.__new__(cls)
        tree.words, tree.r, tree.nodes, tree.ranges = x.shape[1], r, [], []
        rng = np.random.default_rng(len(x))
        some = x[rng.choice(len(x), min(len(x), SAMPLE), replace=False)]
        tree.roots = [tree._grow(some, float(len(x)), mask, width, shard, rng)]
        return tree

    @property
    def leaves(self) -> int:
        return len(self.ranges)

    def _grow(self, sample: np.ndarray, count: float, mask: np.ndarray, width: int, shard: int, rng: np.random.Generator, depth: int = 0) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        cut = None
        if count > shard and depth < 3 * width:
            if len(sample) >= _LEAST:
                tries = sample[rng.choice(len(sample), 3, replace=False)]
            else:
                tries = rng.integers(0, 1 << 63, (3, self.words), dtype=np.uint64) << np.uint64(1)
            for v in tries:
                if len(sample) >= _LEAST:
                    d = apart(sample & mask, v & mask)
                else:
                    d = rng.binomial(width, 0.5, 512)
                for m in {int(np.median(d)), int(np.median(d)) - 1}:
                    left, right = float(np.mean(d <= m + self.r)), float(np.mean(d > m))
                    worst = max(left, right)
                    if right > 0 and (cut is None or worst < cut[0]):
                        cut = (worst, v, m, left, right)
            if cut and cut[0] > 0.93:  # a dense spot: more levels would copy, not part
                cut = None
        if cut is None:
            self.nodes[at] = (self.leaves,)
            self.ranges.append((mask, width))
            return at
        _, v, m, left, right = cut
        inside = apart(sample & mask, v & mask)
        lower = self._grow(sample[inside <= m + self.r], count * left, mask, width, shard, rng, depth + 1)
        upper = self._grow(sample[inside > m], count * right, mask, width, shard, rng, depth + 1)
        self.nodes[at] = (v & mask, mask, m, lower, upper)
        return at

    def route(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, rows of ``x``) over all trees."""
        waiting = [(root, np.arange(len(x))) for root in self.roots]
        while waiting:
            at, rows = waiting.pop()
            if not len(rows):
                continue
            node = self.nodes[at]
            if len(node) == 1:
                yield node[0], rows
                continue
            v, mask, m, lower, upper = node
            d = apart(x[rows] & mask, v)
            waiting += [(lower, rows[d <= m + self.r]), (upper, rows[d > m])]
