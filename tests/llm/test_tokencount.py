"""Token counts against the library's own, text by text."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_queries import documents
from tokenizers import Tokenizer, pre_tokenizers

from siteloom.llm.queries import COUNTED_WITH, QUERIES
from siteloom.llm.tokencount import Counter, byte_letters, count_tokens

PATH = public_tokenizers.path(COUNTED_WITH)


@pytest.fixture(scope="module")
def tools():
    return Counter(PATH, kept=500), Tokenizer.from_file(PATH)


def test_proof(tools):
    mine, plain = tools
    assert len(mine.whole) > 40_000 and " the" in mine.whole and "<|endoftext|>" not in mine.whole
    assert set(byte_letters()) == set(pre_tokenizers.ByteLevel.alphabet())
    split = plain.pre_tokenizer.pre_tokenize_str
    for s in random.Random(3).sample(sorted(mine.whole), 2000):
        assert len(plain.encode(s, add_special_tokens=False).ids) == 1 == len(split(s))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab 'sdtrevml\n\t　\xa0\x85é日1²!?_<|\U0001f600́\x00"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(tools, text):
    mine, plain = tools
    for t in (text, f" {text} <|endoftext|>{text}", text * 3):
        assert mine.count(t)[0] == len(plain.encode(t, add_special_tokens=False).ids)


def test_every_character(tools):
    """Each code point beyond ASCII between words, marks and numbers."""
    mine, plain = tools
    chars = [chr(c) for c in range(0x80, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"word {c}word {c} {c}{c}1{c}! {c}'s" for c in chars]
    assert [mine.count(t)[0] for t in texts] == [len(e.ids) for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_op12(spark, tmp_path, tools):
    docs = documents()
    rows = [(i, t, "en", "s", len(t or ""), 5) for i, t in docs.items()] + [(None, "twice", "en", "s", 5, 5), (None, "twice", "en", "s", 5, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens long").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(r[0], len((r[1] or "").encode()), n := len(tools[1].encode(r[1] or "", add_special_tokens=False).ids), n > 1024) for r in rows]
    found = QUERIES["op12_token_counts"](spark, str(tmp_path))
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(w[3] for w in want)
    assert count_tokens(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0), PATH).count() == 0


def test_other_files(spark, tools):
    df = spark.createDataFrame([("a", "Some words, twice some words")], "id string, text string")
    other = public_tokenizers.path("word_bpe_49k.json")
    assert count_tokens(df, other, "id").first().n_tokens == len(Tokenizer.from_file(other).encode("Some words, twice some words", add_special_tokens=False).ids)
    with pytest.raises(ValueError, match="byte-level"):
        Counter("piece.model")
