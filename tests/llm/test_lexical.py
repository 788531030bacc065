"""Ranked lexical search against a plain count of everything."""

import random
import re
from collections import Counter
from math import floor, log

import pytest
from conftest import TABLES, same_rows

from siteloom.llm import lexical
from siteloom.llm.queries import QUERIES
from siteloom.llm.sql import ORACLES

WORDS = [f"w{i}" for i in range(60)] + ["É", "é", "日本", "a_b", "A-b", "x" * 40, "\U0001f600"]


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(lexical.TERM, low)


def ranked(docs, items, k):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    big_n, big_l = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in found:
            m = 50 + 50 * n * big_n // big_l
            s = sum(floor(1000 * log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) & set(c))
            if s:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(WORDS[: rng.choice([8, 67])], k=rng.choice([0, 1, 5, 40, 300]))) for _ in range(150)]
    texts += [texts[7]] * 60 + [None, "", " \n-", "W1 w1 É", "very long w2 " * 5000]
    ids = rng.sample(range(1000), len(texts) - 2)
    docs = [*zip(ids, texts[:-2], strict=True), (None, "w3 w3 w4"), (5000, texts[-1]), (5000, texts[-1])]
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([1, 3, 30])))) for i in range(12)] + [(50, None), (51, ""), (52, "unknown"), (53, texts[7]), (53, "w1"), (None, "w2 W2")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, terms string")
    return d, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")


@pytest.mark.parametrize("k,block,at_once", [(50, 1 << 20, 1024), (3, 900, 1024), (1, 1, 5), (1000, 5000, 1)])
def test_ranks_equal_plain_scores(spark, corpus, monkeypatch, k, block, at_once):
    monkeypatch.setattr(lexical, "BLOCK_CHARS", block)
    monkeypatch.setattr(lexical, "MOST_ITEMS", at_once)
    docs, items = frames(spark, *corpus)
    index = lexical.build_index(docs)
    got = [tuple(r) for r in lexical.search(index, items, k=k).collect()]
    assert sorted(got, key=str) == ranked(*corpus, k)


def test_empty_tables(spark, corpus):
    docs, items = frames(spark, *corpus)
    none = lexical.build_index(docs.limit(0))
    assert (none.documents, none.words) == (0, 0) and lexical.search(none, items).count() == 0
    assert lexical.search(lexical.build_index(docs), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    blank = docs.where("text IS NULL OR text = ''")
    assert lexical.search(lexical.build_index(blank), items).count() == 0


def test_bytes_bound_impacts():
    import numpy as np

    rng = np.random.default_rng(2)
    tf, scale = rng.integers(1, 5000, 10_000), rng.integers(50, 10_000_000, 10_000)
    exact = lexical.gain(tf, scale)
    byte = -(-exact * lexical.BYTE // lexical.TOP)
    assert byte.max() <= 255 and (byte * lexical.TOP >= exact * lexical.BYTE).all() and ((byte - 1) * lexical.TOP <= exact * lexical.BYTE).all()


def test_twin(spark, duck):
    path = "/root/testdata/sf0.001"
    assert "documents" in TABLES
    mine, theirs = same_rows(QUERIES["op13_lexical_search"](spark, path), duck.sql(ORACLES["op13_lexical_search"]))
    assert mine == theirs
