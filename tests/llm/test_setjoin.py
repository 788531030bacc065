"""The pipeline's near-dedup against brute-force Jaccard over all pairs."""

import random

import numpy as np
import pytest
from test_neardup import classes

from siteloom.llm import neardup, setjoin


def shingled(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(x, y):
    return x == y or (bool(x | y) and 5 * len(x & y) >= 4 * len(x | y))


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    line = rng.choices(words, k=30)
    docs = [rng.choices(words, k=rng.choice([3, 60, 150, 400])) for _ in range(60)]
    docs += [[*line, *rng.choices(words, k=rng.choice([5, 12, 40, 90]))] for _ in range(60)]  # long lists
    for _ in range(300):  # similarity about 0.65 to 1, also over chains
        t = list(rng.choice(docs))
        for _ in range(rng.randint(0, max(1, len(t) // 24))):
            t[rng.randrange(len(t))] = rng.choice(words)
        docs.append(t)
    dense = rng.choices(words, k=200)
    for _ in range(60):
        t = list(dense)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(200)] = rng.choice(words)
        docs.append(t)
    return [" ".join(t) for t in docs] + ["", None, "  ", "one two"]


def test_keep_one_equals_brute_force(spark):
    docs = corpus()
    ids = [3 * i + 1 for i in range(len(docs))]
    random.Random(2).shuffle(ids)
    sets = [shingled(t) for t in docs]
    linked = [(i, j) for i in range(len(docs)) for j in range(i) if near(sets[i], sets[j])]
    edge = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(docs)) for j in range(i) if sets[i] & sets[j]]
    assert sum(0.7 < s < 0.8 for s in edge) > 20 and sum(0.8 <= s < 0.85 for s in edge) > 20
    of = classes(len(docs), linked)
    least = {}
    for i, c in enumerate(of):
        least[c] = min(least.get(c, ids[i]), ids[i])
    df = spark.createDataFrame(list(zip(ids, docs, strict=True)), "doc_id long, text string")
    assert {r.id: r.class_id for r in setjoin.near_copies(df).collect()} == {ids[i]: least[of[i]] for i in range(len(docs))}
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == sorted(least.values())


@pytest.mark.parametrize("count", [10**3, 10**6, 10**9])
def test_search_keeps_pairs_at_the_bound(count):
    """Bits that differ as at similarity 4/5: nearly all pairs share a range and stay within the radius."""
    search = setjoin.Search.over(count)
    rng = np.random.default_rng(count)
    bits = rng.random((20_000, 64 * search.words)) < setjoin.FLIP
    edges = [64 * search.words * i // search.parts for i in range(search.parts + 1)]
    met = np.logical_or.reduce([bits[:, a:b].sum(axis=1) <= 1 for a, b in zip(edges, edges[1:], strict=False)])
    kept = met & (bits.sum(axis=1) <= search.radius) & (bits[:, :64].sum(axis=1) <= search.first)
    assert kept.mean() > 0.995 and search.radius < 64 * search.words / 2 - 4 * (16 * search.words) ** 0.5


def test_dense_shards(monkeypatch):
    """Stars, pairs left out and pairs between components together reach every pair within the radius."""
    monkeypatch.setattr(setjoin, "LARGE", 100)
    search = setjoin.Search.over(1000)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (3, search.words), dtype=np.uint64)
    rows = []
    for i in range(500):
        y = base[i % 3].copy() if i % 5 else rng.integers(0, 1 << 63, search.words, dtype=np.uint64)
        for b in rng.choice(64 * search.words, rng.integers(0, 30), replace=False):
            y[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        rows.append(y)
    x, no, size = np.array(rows), rng.permutation(500).astype(np.int64), rng.integers(90, 110, 500)
    a, b, left = setjoin.shard_pairs(no, x, size, search)
    at = np.argsort(no)
    fits = lambda i, j: 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j])
    want = {(int(no[i]), int(no[j])) for i in range(500) for j in range(500) if no[i] < no[j] and int(np.bitwise_count(x[i] ^ x[j]).sum()) <= search.radius and int(np.bitwise_count(x[i, 0] ^ x[j, 0])) <= search.first and fits(i, j)}
    first = {(int(min(p)), int(max(p))) for p in zip(a, b, strict=True)}
    rows = at[left]
    more = set()
    for center in (left, left % 7, left * 0):  # nothing linked yet, then a few components
        found = setjoin.pairs_between(left, center, x[rows], size[rows], np.zeros((len(rows), 16), np.uint64), search)
        more = {(int(min(p)), int(max(p))) for c, d in found for p in zip(c, d, strict=True)}
        apart = dict(zip(left.tolist(), center.tolist(), strict=True))
        assert more == {(i, j) for i, j in want if i in apart and j in apart and apart[i] != apart[j]}
        if center is left:
            assert want <= first | more and len(first) < len(want)
