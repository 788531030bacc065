"""Near duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest

from siteloom.llm import neardup
from siteloom.llm.graph import components
from siteloom.llm.simhash import majority_fingerprint


def classes(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def corpus(seed=5, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = [" ".join(rng.choices(words, k=rng.choice([1, 3, 8, 60, 200]))) for _ in range(n)]
    for _ in range(n):
        t = rng.choice(docs).split()
        t[rng.randrange(len(t))] = rng.choice(words)
        docs.append(rng.choice([" ".join(t), rng.choice(docs)]))
    return docs


@pytest.mark.parametrize("words,radius,parts", [(1, 4, 3), (1, 4, 1), (2, 19, 10)])
def test_forest_loses_no_link(words, radius, parts):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (150, words), dtype=np.uint64)
    rows = [*base]
    for i in range(400):
        y = rows[i % 40 if i % 2 else -1].copy()  # chains and stars
        for b in rng.choice(64 * words, rng.integers(1, radius + 3), replace=False):
            y[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        rows.append(y)
    x = np.unique(np.array(rows), axis=0)
    rng.shuffle(x)
    forest = neardup.Forest(x[:200], len(x), radius, parts, shard=40)
    found = [(int(at[a]), int(at[b])) for _, at in forest.route(x) for a, b in neardup.shard_links(x[at], radius)]
    want = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(np.bitwise_count(x[i] ^ x[j]).sum()) <= radius]
    coarse = neardup.Forest(x[:200], len(x), radius, parts, shard=400)
    large = [(int(at[a]), int(at[b])) for n, at in coarse.route(x) for a, b in neardup.large_shard_links(x[at], radius, coarse.ranges[n], coarse.r, 20)]
    assert classes(len(x), large) == classes(len(x), want)
    assert forest.leaves > parts and set(map(lambda p: tuple(sorted(p)), found)) <= set(want)
    assert classes(len(x), found) == classes(len(x), want)


def test_documents(spark):
    docs = [*corpus(), "", "  ", None, "same same", "same same"]
    ids = [3 * i + 1 for i in range(len(docs))]
    random.Random(2).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, docs, ["clash"] * len(docs), strict=True)), "doc_id long, text string, mark string")
    marks = [majority_fingerprint((t or "").encode()) for t in docs]
    linked = [(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if (marks[i] ^ marks[j]).bit_count() <= 4]
    of = classes(len(docs), linked)
    least = {}
    for i, c in enumerate(of):
        least[c] = min(least.get(c, ids[i]), ids[i])
    for kw in ({}, {"parts": 2}):
        got = {r.id: (r.mark.hex(), r.class_id) for r in neardup.near_duplicates(df, **kw).collect()}
        assert got == {ids[i]: (f"{marks[i]:016x}", least[of[i]]) for i in range(len(docs))}
    for most in (512, 2):  # trees of the driver, or of the tasks
        small = neardup.near_classes(neardup.text_fingerprints(df), shard=8, sample=64, most=most)
        assert {r.id: r.class_id for r in small.collect()} == {ids[i]: least[of[i]] for i in range(len(docs))}


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "other words here now")], "doc_id long, text string")
    assert sorted(((r.id, r.class_id) for r in neardup.near_duplicates(df).collect()), key=str) == [(4, 4), (4, 4), (None, 4), (None, None)]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert sorted((r.doc_id for r in neardup.keep_one(df).collect()), key=str) == [4, 4, None, None]


def test_keep_one_keeps_the_clean(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choices(words, k=200) for _ in range(30)]
    docs = [" ".join(b) for b in base]
    for b in base[:10]:
        c = list(b)
        c[100] = "changed"
        docs += [" ".join(b), " ".join(c)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == list(range(30))


def test_components_of_chains(spark):
    n = 60
    edges = [(i, i + 1) for i in range(n) if i % 20 != 19] + [(100, 100), (7, 3)]
    random.Random(1).shuffle(edges)
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: i // 20 * 20 for i in range(n + 1) if i % 20 and i <= n} 
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_clean_text_outlives_its_ids_other_text(spark):
    """An id with two texts of which one is a near copy of a smaller id: only that row goes."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    base, clean = rng.choices(words, k=150), rng.choices(words, k=150)
    near = [*base[:100], "changed", *base[101:]]
    rows = [(1, " ".join(base), 0), (7, " ".join(near), 1), (7, " ".join(clean), 2), (7, " ".join(clean), 2), (8, " ".join(clean), 3), (9, None, 4), (9, "", 5), (10, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int")
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and sorted(r.id for r in kept.collect()) == [0, 2, 2, 4, 5]
