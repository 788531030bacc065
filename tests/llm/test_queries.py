"""The registered queries that SQL cannot express, over a small table against brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_neardup import classes
from test_tokens import one_by_one, placed_well
from tokenizers import Tokenizer

from siteloom.llm.queries import PACKED_WITH, QUERIES, WRITTEN_WITH
from siteloom.llm.simhash import majority_fingerprint, weighted_fingerprint


def documents():
    rng = random.Random(21)
    words = [f"w{i}" for i in range(300)] + ["é", "日本", "a\u3000b", "<|endoftext|>"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 40, 300]))) for _ in range(60)]
    for i in range(40):  # copies, and texts with one word changed
        t = rng.choice(texts[:60]).split(" ")
        if i % 2:
            t[rng.randrange(len(t))] = "edit"
        texts.append(" ".join(t))
    texts += [None, "", " \n", "odd \u3000 \xa0 space", "very long " * 30_000, "b" * 50_000, "\U0001f600 é " * 9]
    ids = rng.sample(range(400), len(texts))
    return dict(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    docs = documents()
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t or ""), "clash") for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string").write.parquet(f"{path}/documents.parquet")
    return docs, path


def bits(x):
    return int(x, 16) if isinstance(x, str) else int.from_bytes(x, "big")


def test_op1(spark, table):
    docs, path = table
    got = {r.doc_id: r for r in QUERIES["op1_document_fingerprints"](spark, path).collect()}
    assert set(got) == set(docs)
    order = sorted(docs, reverse=True)
    own = {i: bits(weighted_fingerprint((docs[i] or "").encode())) for i in docs}
    for k, i in enumerate(order):
        text, after = docs[i] or "", order[(k + 1) % len(order)]
        other, n = docs[after] or "", len(text) // 2
        edited = text[: len(text) - n] + other[:n]
        mark = bits(weighted_fingerprint(edited.encode()))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (bits(r.fingerprint), bits(r.edited_fingerprint)) == (own[i], mark)
        assert r.near_edited == 1 - (own[i] ^ mark).bit_count() / 128 and r.near_next == 1 - (own[i] ^ own[after]).bit_count() / 128
        near = sum((own[i] ^ own[j]).bit_count() <= 3 for j in docs) - 1
        assert r.n_near == (near if i % 20 == 0 else None)


def test_op2(spark, table):
    docs, path = table
    plain = Tokenizer.from_file(public_tokenizers.path(PACKED_WITH))
    want = []
    for i, t in docs.items():
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    rows = QUERIES["op2_best_fit_packing"](spark, path).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert placed_well([(r.sequence_id, r.offset, r.length) for r in rows], 4096) == one_by_one([w[3] for w in want], 4096)


def test_op3(spark, table):
    docs, path = table
    ids = list(docs)
    marks = [majority_fingerprint((docs[i] or "").encode()) for i in ids]
    of = classes(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 4])
    least = {}
    for i, c in zip(ids, of, strict=True):
        least[c] = min(least.get(c, i), i)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op3_simhash_near_dedup"](spark, path).collect()}
    assert got == {(i, f"{m:016x}", least[c]) for i, m, c in zip(ids, marks, of, strict=True)}


def test_op5(spark, table):
    docs, path = table
    plain = Tokenizer.from_file(public_tokenizers.path(WRITTEN_WITH))
    start, want = 0, set()
    for i in sorted(docs):
        ids = [*plain.encode(docs[i] or "", add_special_tokens=False).ids, 0]
        want.add((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op5_token_files"](spark, path).collect()} == want
