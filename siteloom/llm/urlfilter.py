"""URL filters: path rules and a Bloom filter cascade for listed keys.

Plain DataFrame expressions throughout. The cascade knows every key of the corpus, so it
can be exact: level 1 is a Bloom filter of the listed keys, level 2 one of the other keys
that level 1 lets pass, level 3 one of the listed keys that level 2 lets pass, and so on
until none is left. A key is listed if the first level that rejects it has an even
number, or if all levels let it pass and their number is odd. Filters are arrays of
64-bit words that tasks read as scalar subqueries; no key is joined.

A filter has at most ``MOST_WORDS`` words. More keys are dealt by hash over several
cascades; keys and rows are shuffled by share once and stored in a folder for each, so a
cascade reads its own share alone and the tables are read once, whatever the number.

Defined cases: a null URL or one without ``://`` has an empty host and path and, like any
key, a listed or unlisted one; repeated rows are judged alike; very long URLs are keys like others; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from math import log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import materialize, release

#: Bits a key, most 64-bit words of a filter (8 MB), most levels.
BITS_PER_KEY, MOST_WORDS, MOST_LEVELS = 12, 1 << 20, 64
#: Tasks that the rows of a share are dealt over at most.
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def url_host(url: str = "url") -> Column:
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def url_path(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(rules: tuple[Rule, ...] = RULES, host: str = "host", path: str = "path") -> Column:
    """Struct ``(rule, verdict)`` of the longest rule that fits, null if none; ties go to the first given."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((F.col(host) == r.host) | F.col(host).endswith("." + r.host)) & F.col(path).startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def hashes() -> int:
    """As many hash functions as let the fewest other keys pass at that number of bits a key."""
    return max(1, round(log(2) * BITS_PER_KEY))


def _places(key: Column, level: int, size: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * hashes() + i), key), F.lit(size)) for i in range(hashes())]


class Filter(NamedTuple):
    """One level: its stored words and its size in bits."""

    words: DataFrame
    level: int
    size: int

    def passes(self, key: Column) -> Column:
        words = self.words.select("words").scalar()
        ok = F.lit(True)
        for place in _places(key, self.level, self.size):
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
            ok = ok & (F.get(words, (F.call_function("shiftright", place, F.lit(6))).cast("int")).bitwiseAND(bit) != 0)
        return ok


def bloom_filter(keys: DataFrame, count: int, level: int) -> Filter:
    """A filter of the column ``key``: bits are or-ed map-side first, then by word."""
    spark = keys.sparkSession
    words = max(1, -(-count * BITS_PER_KEY // 64))
    place = F.explode(F.array(*_places(F.col("key"), level, words * 64)))
    bits = keys.select(place.alias("at")).select(F.expr("shiftright(at, 6)").alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bits"))
    full = bits.union(spark.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    packed = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
    return Filter(materialize(packed, "bloom"), level, words * 64)


def cascade(keys: DataFrame) -> list[Filter]:
    """Levels for ``keys (key, listed)``, which holds each key of the universe once."""
    levels: list[Filter] = []
    inside, outside = keys.where("listed").select("key"), keys.where(~F.col("listed")).select("key")
    count, mine = inside.count(), None
    while count:
        if len(levels) == MOST_LEVELS:
            raise ValueError("keys that no level parts")
        levels.append(bloom_filter(inside, count, len(levels) + 1))
        passed = materialize(outside.where(levels[-1].passes(F.col("key"))), "passed")
        inside, outside, old, mine = passed, inside, mine, passed
        count = passed.count()
        if old is not None and not count:
            release(keys.sparkSession, old)
    return levels


def is_listed(levels: list[Filter], key: Column) -> Column:
    verdict = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels, 1))):
        verdict = F.when(level.passes(key), verdict).otherwise(F.lit(i % 2 == 0))
    return verdict


def with_membership(rows: DataFrame, listed: DataFrame, key: str = "key", most_words: int = MOST_WORDS) -> DataFrame:
    """``rows`` with ``listed``: whether their ``key`` is among those of ``listed``. Exact for every key of ``rows``."""
    found = rows.select(F.col(key).alias("key"), F.lit(False).alias("listed")).union(listed.select(F.col(key).alias("key"), F.lit(True).alias("listed")))
    universe = materialize(found.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("listed").alias("listed")), "universe")
    most = universe.agg(F.count_if("listed").alias("a"), F.count_if(~F.col("listed")).alias("b")).first()
    shares = max(1, -(-max(most) * BITS_PER_KEY // (64 * most_words)))
    if shares == 1:
        return rows.withColumn("listed", _listed(cascade(universe), key))
    share = lambda c: F.pmod(F.xxhash64(F.lit(-1), F.coalesce(c, F.lit(""))), F.lit(shares)).cast("int")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))  # a frequent key is one share, but many tasks
    keys = materialize(universe.withColumn("_share", share("key")).repartition("_share"), "shares", "_share")
    dealt = materialize(rows.withColumn("_share", share(key)).withColumn("_salt", salt).repartition("_share", "_salt").drop("_salt"), "dealt", "_share")
    out = None
    for i in range(shares):
        levels = cascade(keys.where(F.col("_share") == i).drop("_share"))
        some = dealt.where(F.col("_share") == i).select(*rows.columns, _listed(levels, key).alias("listed"))
        out = some if out is None else out.union(some)
    return out


def _listed(levels: list[Filter], key: str) -> Column:
    return F.coalesce(F.col(key).isNotNull() & is_listed(levels, F.col(key)), F.lit(False))


def judge_urls(df: DataFrame, listed: DataFrame, id_col: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every row of ``df``, the id under its own name.

    The longest fitting rule decides; where none fits, a URL is blocked if its key, host
    and path, is among ``listed (key)``.
    """
    rows = df.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path")).withColumn("key", F.concat("host", "path"))
    judged = with_membership(rows, listed).withColumn("_rule", matching_rule(rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))
