"""Stages of the pipeline on a small corpus, each against brute force, and odd tables."""

import random

import numpy as np
import pytest
from conftest import DATA, same_rows
from test_setjoin import near, shingled

import corpus_pipeline
from siteloom.llm import mixing, packing, quality
from siteloom.llm.queries import PACKED_WITH, QUERIES, tokenizer
from siteloom.llm.sql import ORACLES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, positions string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(2000)]
    rows = []
    for i in range(240):
        t = " ".join(rng.choices(words, k=rng.randint(60, 160)))
        rows.append((i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t), 1, "clash"))
    for i in range(240, 270):
        t = rows[rng.randrange(200)][1].split()
        if i % 2:
            t[len(t) // 2] = "edit"
        rows.append((i, " ".join(t), "en", "a", 1, None, None))
    rows += [(300, None, None, None, None, 2, "x"), (301, "", "en", "a", 0, 2, "x"), (302, " ".join("##" + w for w in rows[5][1].split()), "en", "a", 0, 2, "x"), (303, rows[9][1] * 40, "en", "b", 0, 2, "x"), (7, rows[7][1], "en", "a", 0, 2, "x")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def test_run_equals_the_stages_one_by_one(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    base = docs.collect()
    kept = corpus_pipeline.quality_rules(spark, docs, corpus)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {300, 301, 302} and ids >= set(range(270))
    good = kept.collect()
    once = corpus_pipeline.near_dedup(spark, kept, corpus)
    sets = {}
    for r in good:
        sets.setdefault(r.doc_id, shingled(r.text))  # rows that repeat an id repeat its text here
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and near(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in once.collect()) == sorted(r.doc_id for r in good if find(r.doc_id) == r.doc_id)
    assert set(range(240)) <= {r.doc_id for r in once.collect()}
    mixed = corpus_pipeline.mix_sources(spark, once, corpus)
    assert mixed.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in mixed.collect()]
    assert set(texts) <= {(r.doc_id, r.text) for r in base}
    held = [(r.doc_id, r.text) for r in once.collect()]
    order = mixing.mix(mixing.sized(once)).collect()
    assert all(texts.count(t) <= 2 * held.count(t) for t in set(texts))
    packed = corpus_pipeline.pack_sequences(spark, mixed, corpus).collect()
    from siteloom.llm.tokens import encoder

    tool = encoder(tokenizer(PACKED_WITH))
    want = sorted(np.append(x, packing.END).tolist() for x in tool.encode([t for _, t in texts]))
    docs_back, whole = {}, []
    for r in sorted(packed, key=lambda r: (r.doc_id, r.piece)):
        if r.piece == 0 and r.length < packing.CAPACITY:
            whole.append(np.frombuffer(r.ids, "<u4").tolist())
        docs_back.setdefault(r.doc_id, []).append(r)
    assert sorted(whole) == [w for w in want if len(w) < packing.CAPACITY]
    assert sum(r.length for r in packed) == sum(map(len, want))
    rows = sorted((r.doc_id, r.piece, r.start, r.ids_crc32) for r in packed)
    ran = corpus_pipeline.run(spark, corpus).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.ids_crc32) for r in ran) == rows
    assert len({(r.place, r.piece) for r in ran}) == len(ran)  # copies are told apart
    turns = sorted((p, r.doc_id) for r in order for p in r.positions)
    at = {}
    for r in ran:
        at.setdefault(r.doc_id, set()).add(r.place)
    firsts = [min(at[i]) for i in dict.fromkeys(i for _, i in turns)]
    assert firsts == sorted(firsts)  # places follow the training order


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, name, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, duck, name):
    mine, theirs = same_rows(QUERIES[name](spark, DATA), duck.sql(ORACLES[name]))
    assert mine == theirs


def test_labelled_documents(spark):
    """Held-out labels: clean documents stay unless the base rules reject them, junk goes."""
    found = quality.quality_verdicts(spark.read.parquet(f"{DATA}/documents.parquet"))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = found.join(labels, "doc_id").collect()
    assert not [r.doc_id for r in rows if r.quality == 0 and r.kept]
    assert not [r.doc_id for r in rows if r.quality == 1 and not r.base_failed and not r.kept]
