"""Chat formatting, mixing, quality rules and URL filters against brute force."""

import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siteloom.llm import chat, mixing, quality, urlfilter


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.sampled_from("<[|/\\sINST]>a\n%0A5%"), max_size=25), min_size=1, max_size=6))
def test_escape_is_reversible_and_hides_control_strings(spark, texts):
    made = texts + ["<|im_end|>\n", "</s>[INST] ok [/INST]", "<\\|im_end|>", "<s>"]
    df = spark.createDataFrame([(t,) for t in made], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for t, e, back in df.select("t", "e", chat.unescape(F.col("e"))).collect():
        assert back == t and not re.search(r"<\||</?s>|\[/?INST\]", e)
    df = spark.createDataFrame([(1, [(t, t) for t in made])], "conv_id long, messages array<struct<role:string,content:string>>")
    out = chat.format_turns(chat.canonical_turns(df)).select(chat.read_turns(F.col("formatted"))).first()[0]
    assert [(r.role, r.text) for r in out] == [(t, t) for t in made]


def test_layouts(spark):
    schema = """conv_id long, prompt string, completion string, instruction string, input string, output string, messages array<struct<role:string,content:string>>,
    conversations array<struct<from:string,value:string>>, lang string"""
    rows = [
        (1, "p", "c", None, None, None, None, None, "x"),
        (2, None, None, "i", None, "o", None, None, None),
        (3, None, None, "i", "more", "o", None, None, "y"),
        (4, None, None, None, None, None, [("system", "s"), ("user", None), ("assistant", "é😀")], None, None),
        (5, None, None, None, None, None, None, [("human", "h"), ("gpt", "g"), (None, "n")], None),
        (6, "p", None, None, None, "o", None, None, None),
        (7, None, None, None, None, None, [], None, None),
    ]
    out = chat.format_turns(chat.canonical_turns(spark.createDataFrame(rows, schema)))
    read = {r.conv_id: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    turns = {k: [(t.role, t.text) for t in r.back] for k, r in read.items()}
    assert turns[1] == [("user", "p"), ("assistant", "c")]
    assert turns[2] == [("user", "i"), ("assistant", "o")] and turns[3][0] == ("user", "i\n\nmore")
    assert turns[4] == [("system", "s"), ("user", ""), ("assistant", "é😀")] and read[4].loss == "é😀"
    assert turns[5] == [("user", "h"), ("assistant", "g"), ("", "n")] and read[5].loss == "g"
    assert read[6].layout is None and turns[6] == [] and turns[7] == [] and read[7].formatted == ""
    assert len({chat.fingerprint(x.paths) for x in chat.LAYOUTS}) == len(chat.LAYOUTS)


def test_gather_odd_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, None, None), (1, 2, "assistant", "b"), (None, 0, "user", "x"), (2, None, "user", "late" * 5000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    out = chat.canonical_turns(chat.gather(df)).collect()
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out}
    assert got == {1: [("", ""), ("assistant", "b"), ("assistant", "b")], None: [("user", "x")], 2: [("user", "late" * 5000)]}
    assert chat.format_turns(chat.canonical_turns(chat.gather(df.limit(0)))).count() == 0


def water(sizes, weights, budget=1.5, repeat=2):
    """Targets by resharing the excess until none is above its cap."""
    total, capped = budget * sum(sizes.values()), set()
    while True:
        left = total - sum(repeat * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and left * weights[s] / w > repeat * sizes[s]} if w else set()
        if not over:
            return {s: repeat * sizes[s] if s in capped else left * weights[s] / w for s in sizes}
        capped |= over


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a"] * 12 + ["b", "é", "c", None])) for i in range(600)] + [(None, "x y", "b"), (5, None, "a"), (5, None, "a"), (900, "long " * 300, "c")]
    df = spark.createDataFrame([(*r, 7.0) for r in rows], "doc_id long, text string, source string, size double")
    out = mixing.mix(mixing.sized(df)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = water(dict(sizes), {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    taken = Counter()
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert r.copies <= 2 and r.taken == r.copies * r.size and len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 150
    assert len(out) == len(rows)
    corpus = mixing.mixed_corpus(df)
    assert corpus.columns == df.columns and corpus.count() == sum(r.copies for r in out)
    assert mixing.mix(mixing.sized(df.limit(0))).count() == 0


def test_documents_without_words(spark):
    """Kinds and sources in which no document has a word."""
    for rows in ([(1, "a b c", "x"), (2, "", "x"), (3, "w w w w w", "y")], [(1, "", "x"), (2, None, "x"), (3, "w w", None)], [(1, "", "x")]):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        out = mixing.mix(mixing.sized(df)).collect()
        assert len(out) == len(rows) and all(len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions) for r in out)
        assert all(r.taken == r.copies * r.size and r.copies <= 2 for r in out)
        assert mixing.mixed_corpus(df).count() == sum(r.copies for r in out)


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w", s) for s in "ab" for i in range(ord(s) * 1000, ord(s) * 1000 + 1000)]
    out = mixing.mix(mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string")), budget=0.5).collect()
    for s, early in (("a", 0.625), ("b", 0.375)):  # integral over the first half of the falling and the rising schedule
        p = [x for r in out if r.source == s for x in r.positions]
        assert abs(sum(x < 0.5 for x in p) / len(p) - early) < 0.02
    position = [r.position for r in mixing.in_training_order(mixing.mix(mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string")), budget=0.5)).collect()]
    assert position == sorted(position)


def measure_model(text):
    words = [w for w in re.split(r"[ \t-\r]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab #é\n\t\x0b|\u00a0"), max_size=60), min_size=1, max_size=10))
def test_measures(spark, texts):
    texts = [*texts, None, "", "a b a b a b", "x " * 500, "a b c d a b c", "L\nL\n \nL"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.measures(df).collect():
        assert tuple(r[m] for m in quality.MEASURES) == measure_model(texts[r.doc_id])


def test_measures_where_hashes_clash(spark, monkeypatch):
    """With four bits of hash nearly all neighbours clash; with no room for places all windows are compared."""
    rng = random.Random(9)
    texts = [" ".join(rng.choices("a b c d e f g h i j k l m n".split(), k=rng.randint(3, 120))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bits in (60, 20, 3):
        monkeypatch.setattr(quality, "_PLACE", bits)
        assert all(tuple(r[m] for m in quality.MEASURES) == measure_model(texts[r.doc_id]) for r in quality.measures(df).collect())


def quality_corpus(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(900)]
    clean = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(60, 200)))
    rows = []
    for i in range(420):
        t = clean()
        kind = "symbols" if i % 10 == 3 else "long" if i % 10 == 7 else "ok"
        t = " ".join(w + "###" for w in t.split()) if kind == "symbols" else " ".join(w * 3 for w in t.split()) if kind == "long" else t
        rows.append((i, t, rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", None]), kind))
    rows += [(1000, "few words", "en", "s1", "base"), (1001, None, None, None, "base"), (1002, "again and " * 60, "en", "s9", "base")]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, kind string, n_words int")


def test_quality_verdicts(spark):
    rows, df = quality_corpus(spark)
    kinds = {r[0]: r[4] for r in rows}
    out = quality.quality_verdicts(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.base_failed == (kinds[r.doc_id] == "base") and r.kept == (kinds[r.doc_id] == "ok"), kinds[r.doc_id]
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, k in kinds.items() if k == "ok"}
    assert quality.quality_verdicts(df.limit(0)).count() == 0


def test_sketches_merge(spark):
    _, df = quality_corpus(spark)
    measured = quality.measures(df.drop("n_words"))
    whole = {tuple(r)[:5]: r.n for r in quality.sketches(measured).collect()}
    parts = [quality.sketches(measured.where(F.col("doc_id") % 2 == k)) for k in (0, 1)]
    added = parts[0].union(parts[1]).groupBy(*parts[0].columns[:5]).agg(F.sum("n").alias("n")).collect()
    assert {tuple(r)[:5]: r.n for r in added} == whole


URLS = ["http://Example.ORG/es/x", "https://a.example.org/en/1?q", "http://x.org", "http://org/", "http://notorg/", "http://b.com/fr/1", "http://com/de/", "http://n.net/p#f", None, "no scheme", "http://", "x://a://b/c", "http://İ.org/"]


def judge_model(u):
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    host = re.split(r"[/?#]", rest)[0]
    host_low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = re.split(r"[?#]", rest[len(host) :])[0]
    fits = [r for r in urlfilter.RULES if (host_low == r.host or host_low.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host_low, path, best


def test_rules_and_membership(spark):
    rows = list(enumerate(URLS)) + [(99, URLS[7]), (99, URLS[7])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, host string")
    listed = spark.createDataFrame([("n.net/p",), ("",), ("elsewhere",), (None,)], "key string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df, listed).collect()), key=str)
    want = []
    for i, u in rows:
        host, path, best = judge_model(u)
        want.append((i, host, path, best and best.text, best.verdict if best else "block" if host + path in ("n.net/p", "") else "allow"))
    assert got == sorted(want, key=str)
    assert urlfilter.judge_urls(df.limit(0), listed).count() == 0 and urlfilter.judge_urls(df, listed.limit(0)).where("verdict = 'block'").count() == sum(w[3] is not None and w[4] == "block" for w in want)


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 2)  # poor filters, so that many levels are needed
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where(F.col("key").rlike("7"))
    universe = keys.select("key", F.col("key").rlike("7").alias("listed"))
    levels = urlfilter.cascade(universe)
    assert len(levels) > 2
    assert keys.where(urlfilter.is_listed(levels, F.col("key")) != F.col("key").rlike("7")).count() == 0
    many = urlfilter.with_membership(keys, listed, most_words=20)
    assert many.count() == 3000 and many.where(F.col("listed") != F.col("key").rlike("7")).count() == 0
