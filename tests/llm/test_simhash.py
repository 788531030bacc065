"""Fingerprints against brute force."""

import math
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siteloom.llm import fingerprints, simhash

TEXTS = st.text("ab é\n\t A", max_size=60)


def shingles(text, width):
    words = text.encode().lower().split()
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_majority_bits(text):
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, 4)]
    want = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0
    assert simhash.majority_fingerprint(text.encode()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(1, 50)), min_size=1, max_size=30))
def test_weighted_votes(rows):
    import numpy as np

    votes = simhash.vote(np.array([[h] for h, _ in rows], np.uint64), np.array([w for _, w in rows]))
    for k in range(64):
        assert votes[k] == sum(w if h >> (63 - k) & 1 else -w for h, w in rows)


def test_terms_weigh_by_count():
    h, w = simhash.terms(b"a b c a b c a b c")
    assert sorted(w) == sorted(round(16 * (1 + math.log(n))) for n in Counter([(0, 1, 2)] * 3 + [(1, 2, 0)] * 2 + [(2, 0, 1)] * 2).values())
    assert simhash.weighted_fingerprint(b" \n") == bytes(16)
    assert simhash.weighted_fingerprint(b"a  b") == simhash.weighted_fingerprint(b"\ta b\n")


def test_word_hashes_depend_on_words_only():
    a, b = simhash.word_hashes("x foo bar".encode()), simhash.word_hashes("longer start  bar\nfoo".encode())
    assert a[1] == b[3] and a[2] == b[2] and len(set(a.tolist())) == 3


ROWS = [(5, "one two three four"), (3, None), (9, ""), (3, None), (7, "äöü x" * 50), (None, "no id"), (8, "one two three four")]


@pytest.mark.parametrize("n", [1, 3, 16])
def test_neighbours_in_descending_id(spark, n):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("bucket", F.lit("clash"))
        got = sorted((r.id is None, -(r.id or 0), r.edited) for r in fingerprints.edited_fingerprints(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = sorted((k is None, -(k or 0), fingerprints.edit(t or "", order[(i + 1) % len(order)][1] or "")) for i, (k, t) in enumerate(order))
    assert got == want


def test_one_row_and_none(spark):
    one = fingerprints.edited_digests(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].n_chars == 4 and one[0].near_next == 1.0
    assert fingerprints.edited_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("radius,blocks", [(3, 4), (3, 6), (1, 3)])
def test_block_tables_find_all(spark, radius, blocks):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(20)]
    marks = {b for b in base}
    for b in base:
        for flips in range(1, radius + 3):
            marks.add(b ^ sum(1 << i for i in rng.sample(range(128), flips)))
    marks = sorted(f"{m:032x}" for m in marks)
    df = spark.createDataFrame([(m,) for m in marks], "fingerprint string")
    asked = df.where(F.col("fingerprint").isin(marks[::3]))
    got = {(r.asked, r.fingerprint, r.distance) for r in fingerprints.near_matches(df, asked, radius, blocks).collect()}
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    want = {(a, b, apart(a, b)) for a in marks[::3] for b in marks if a != b and apart(a, b) <= radius}
    assert got == want and want


def test_near_counts_count_copies(spark):
    rows = [(0, "0" * 32), (1, "0" * 32), (2, "0" * 31 + "1"), (3, "f" * 32)]
    df = spark.createDataFrame(rows, "id long, fingerprint string")
    assert dict(fingerprints.near_counts(df, F.col("id") % 3 == 0).collect()) == {"0" * 32: 2, "f" * 32: 0}
