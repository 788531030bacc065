"""Tokens, packing and token files."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siteloom.llm import packing, tokenfile
from siteloom.llm.tokens import Encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TOOLS = {n: Encoder(public_tokenizers.path(n), cached=50) for n in FILES}
PLAIN = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in FILES}  # never altered
ODD = ["", " ", "\n", "a\nb", "a\n\nb", " x ", "it's we'll 's", "İstanbul ΣΑΣ", "Á ́b", "a\tb c\r\nd", "\x00 a", "<|endoftext|> a", "日本 語\n1 23", "x" * 3000]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("aeéΣ .,'s1<|>\n\t 日"), max_size=40), max_size=8))
def test_encoder_equals_the_tokenizer(name, texts):
    tool = TOOLS[name]
    texts = texts + ODD
    assert [x.tolist() for x in tool.encode(texts)] == [PLAIN[name].encode(t, add_special_tokens=False).ids for t in texts]


WHITE = " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2007\u200a\u200b\u2028\u2029\u202f\u205f\u3000"


@pytest.mark.parametrize("name", FILES)
def test_odd_white_space_and_added_tokens(name):
    rng = random.Random(11)
    tool = Encoder(public_tokenizers.path(name))
    atoms = [*WHITE, *"  \n\n", *"aaeÉΣ日١1.,'s!", "<|endoftext|>", "<|startoftext|>", "word", "'ll", "e\u0301"]
    texts = ["".join(rng.choices(atoms, [2] * len(WHITE) + [20] * 4 + [5] * (len(atoms) - len(WHITE) - 4), k=rng.randint(1, 24))) for _ in range(20_000)]
    want = PLAIN[name].encode_batch_fast(texts, add_special_tokens=False)
    wrong = [t for t, x, y in zip(texts, tool.encode(texts), want, strict=True) if x.tolist() != y.ids]
    assert not wrong
    literal = Encoder(public_tokenizers.path(name), literal=True)
    marked = "foo <|endoftext|> bar"
    assert len(literal.encode([marked])[0]) > len(tool.encode([marked])[0])


def one_by_one(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(s, i) for i, s in enumerate(left) if s >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
    return len(left)


def placed_well(rows, capacity):
    """Gapless from 0 in each sequence and within the capacity."""
    by = {}
    for seq, offset, length in rows:
        by.setdefault(seq, []).append((offset, length))
    for found in by.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@settings(max_examples=150, deadline=None)
@given(st.integers(5, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_plan_equals_best_fit_decreasing(case):
    capacity, lengths = case
    runs = packing.best_fit_plan({n: lengths.count(n) for n in set(lengths)}, capacity)
    rows = [(r.sequence + k // r.each, r.offset + k % r.each * r.length, r.length) for r in runs for k in range(r.bins * r.each)]
    assert sorted(n for *_, n in rows) == sorted(lengths)
    assert placed_well(rows, capacity) == one_by_one(lengths, capacity)


def test_plan_is_small():
    runs = packing.best_fit_plan({n: 10**9 + n for n in range(1, 257)}, 256)
    assert len(runs) < 3000 and sum(r.bins * r.each for r in runs) == sum(10**9 + n for n in range(1, 257))


def fixture(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta the of".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 200])))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "the " * 700), (203, "a <|endoftext|> b"), (204, "a.a\u3000 \xa0 \xa0\r"), (205, "long line " * 30_000), (7, "alpha"), (7, "alpha"), (None, "no id")]
    return docs, spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, length int")


def test_packing_round_trip(spark):
    docs, df = fixture(spark)
    path, tool = public_tokenizers.path(FILES[1]), PLAIN[FILES[1]]
    rows = packing.pack_documents(df, path, capacity=128).collect()
    want = []
    for i, t in docs:
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k // 128, k, ids[k : k + 128]) for k in range(0, len(ids), 128)]
    got = [(r.id, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 for r in rows)
    assert placed_well([(r.sequence_id, r.offset, r.length) for r in rows], 128) == one_by_one([len(x[3]) for x in want], 128)
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_token_files(spark):
    docs, df = fixture(spark)
    path, tool = public_tokenizers.path(FILES[0]), PLAIN[FILES[0]]
    manifest = tokenfile.write_token_files(df, path)
    rows = tokenfile.read_token_files(spark, manifest).collect()
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    start, want = 0, []
    for i, t in order:
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, ids))
        start += len(ids)
    got = sorted(((r.id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows), key=lambda r: r[1])
    assert got == want
    assert manifest.selectExpr("sum(tokens)").first()[0] == start
    first = manifest.orderBy("part").first()
    data = open(first.path.removeprefix("file://"), "rb").read()
    reader = tokenfile.Reader(io.BytesIO(data), len(data))
    assert reader.document(3).tolist() == want[3][2]
    plain = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
    assert len(plain) == int(reader.table[:, 1].sum())  # any reader of the format gets the frames in order
    broken = bytearray(data)
    broken[-12] ^= 1  # the index frame's checksum in the table
    with pytest.raises(ValueError, match="checksum"):
        tokenfile.Reader(io.BytesIO(bytes(broken)), len(broken))
    assert tokenfile.read_token_files(spark, tokenfile.write_token_files(df.limit(0), path)).count() == 0
