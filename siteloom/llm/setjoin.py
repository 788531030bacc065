"""Near copies: SimHash candidates through vantage-point trees, confirmed by exact Jaccard similarity.

Two texts are near copies if their sets of word shingles have a Jaccard similarity of 4/5
or more. How they are found:

* Each distinct set has a SimHash of its shingles. A pair at similarity 4/5 has a cosine of
  8/9, so each bit differs with probability ``FLIP``; bits, ranges and radius follow from it
  by :class:`Search`, so that a pair right at the bound is lost with a probability of at
  most ``LOSS`` for each of the two, and any closer pair with less.
* A forest of trees, one on each range of bits with triangle bound 1, deals fingerprints to
  shards; boundary rows go to both sides. A shard's task gives the pairs within the radius:
  all of a row with few, the first few of a row with many, and in dense spots stars.
* Parity bits bound the difference of a pair from below; what they leave is held against
  the shingles themselves before it is a link.
* Links make components. Shards in which pairs were left out then give those pairs whose
  ends are in different components, so a group of near copies is never all its pairs, and
  no link within the radius is lost.

Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, floor, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import forget, materialize, partitions
from siteloom.llm.graph import components
from siteloom.llm.simhash import _mix, distinct, vote, word_hashes
from siteloom.llm.vptree import SAMPLE, Forest, apart

#: Probability that a bit differs at similarity 4/5, and what a pair there may be lost with.
FLIP, LOSS = acos(8 / 9) / pi, 0.001
#: Parity bits a set; pairs that a row of a shard gives at once.
BITS, STARS = 1024, 4
#: Rows that planning aims at for a shard.
SHARD = 4096
#: Rows of a shard above which dense spots are looked for, and rows that are tried for it.
LARGE, PROBES = 4 * SHARD, 256
_GRAM = _mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class Search:
    """Ranges of ``width`` bits, 64 * ``words`` bits in all, and the radius over them.

    The width grows with the logarithm of the number of sets, so that shards of a range
    stay small as the corpus grows; the number of ranges then keeps the loss.
    """

    width: float
    parts: int
    words: int
    radius: int
    first: int  # largest distance in the first 64 bits

    @classmethod
    def over(cls, count: int) -> Search:
        width = max(12.8, log2(max(2, count)) - 5)
        hit = (1 - FLIP) ** width + width * FLIP * (1 - FLIP) ** (width - 1)  # at most one bit of a range
        words = ceil(ceil(log(LOSS) / log(1 - hit)) * width / 64)
        parts = floor(64 * words / width)
        spread = sqrt(64 * words * FLIP * (1 - FLIP))
        return cls(width, parts, words, ceil(64 * words * FLIP + 3.1 * spread), ceil(64 * FLIP + 3.8 * sqrt(64 * FLIP * (1 - FLIP))))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Distinct shingles of ``width`` words, A-Z in lower case, ascending; fewer words: one, the whole sequence."""
    w = word_hashes((text or b"").lower())
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h += w[i : len(w) - k + 1 + i] * _GRAM[i]
    return distinct(_mix(h))[0]


def set_fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """64 * ``words`` majority bits of a set; zero for the empty one."""
    if not len(h):
        return np.zeros(words, np.uint64)
    rows = np.stack([_mix(h + np.uint64(i + 1)) for i in range(words)], axis=1)
    return np.packbits(vote(rows) > 0).view(">u8").astype(np.uint64)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Jaccard similarity of two ascending sets of 4/5 or more."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 9 * both >= 4 * (len(x) + len(y))


def _parity(h: np.ndarray) -> bytes:
    return np.packbits(np.bincount((h % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def _words(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, n)


def _described(texts: DataFrame, width: int, words: int) -> DataFrame:
    """``(id, row, mark, size, parity, print)`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            marks, sizes, parities, prints = [], [], [], []
            for t in b.column(2).to_pylist():
                h = shingle_set(t, width)
                marks.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                sizes.append(len(h))
                parities.append(_parity(h))
                prints.append(set_fingerprint(h, words).tobytes())
            ends = [b.column(0), b.column(1), pa.array(marks, pa.binary()), pa.array(sizes, pa.int32()), pa.array(parities, pa.binary()), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays(ends, names=["id", "row", "mark", "size", "parity", "print"])

    return texts.mapInArrow(run, "id long, row long, mark binary, size int, parity binary, print binary")


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches sorted by their first column, as one batch a value."""
    now, held = None, []
    for b in batches:
        numbers = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for at, stop in zip(cuts, cuts[1:], strict=False):
            if at == stop:
                continue
            if held and numbers[at] != now:
                yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            now = int(numbers[at])
            held.append(b.slice(at, stop - at))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(x, y) >= 4 * np.maximum(x, y)


class _Near:
    """Pairs of a shard whose first words differ in few bits, in blocks that reuse their memory."""

    def __init__(self, x: np.ndarray, most: int) -> None:
        self.first, self.most, self.block = np.ascontiguousarray(x[:, 0]), np.uint8(most), max(8, (1 << 17) // max(1, len(x)))
        self.apart, self.count, self.hit = (np.empty(self.block * len(x), t) for t in (np.uint64, np.uint8, bool))

    def pairs(self, at: int, stop: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """Of rows ``at`` to ``stop`` with those before ``upto``."""
        if not upto:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = (stop - at) * upto
        x, y, hit = self.apart[:n].reshape(-1, upto), self.count[:n].reshape(-1, upto), self.hit[:n].reshape(-1, upto)
        np.bitwise_xor(self.first[at:stop, None], self.first[None, :upto], out=x)
        np.bitwise_count(x, out=y)
        np.less_equal(y, self.most, out=hit)
        found = np.flatnonzero(self.hit[:n])
        i = found // upto
        return at + i, found - i * upto


def near_pairs(x: np.ndarray, size: np.ndarray, begin: int, search: Search) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the radius and of fitting sizes, in blocks: each row from ``begin`` on with all before it."""
    near = _Near(x, search.first)
    for at in range(begin, len(x), near.block):
        stop = min(at + near.block, len(x))
        i, j = near.pairs(at, stop, stop)
        keep = j < i
        i, j = i[keep], j[keep]
        keep = (apart(x[i], x[j]) <= search.radius) & _fits(size[i], size[j])
        yield i[keep], j[keep]


def dense_stars(x: np.ndarray, search: Search) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Which rows of a large shard lie in a dense spot, and the stars ``(pivot, rows)`` that cover them."""
    dense = np.zeros(len(x), bool)
    stars = []
    if len(x) > LARGE:
        for p in np.linspace(0, len(x) - 1, PROBES).astype(np.int64).tolist():
            if dense[p]:
                continue
            near = apart(x, x[p]) <= search.radius
            if near.sum() > len(x) // 64:
                stars.append((p, np.flatnonzero(near)))
                dense |= near
    return dense, stars


def shard_pairs(no: np.ndarray, x: np.ndarray, size: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs ``a``, ``b`` of a shard, and those of its rows that may have pairs left out."""
    dense, stars = dense_stars(x, search)
    order = np.lexsort((no, ~dense))
    no, x, size = no[order], x[order], size[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    a, b, left = [], [], np.zeros(len(no), bool)
    for p, rows in stars:
        rows = place[rows]
        rows = rows[_fits(size[rows], size[place[p]]) & (rows != place[p])]
        a.append(no[rows])
        b.append(np.full(len(rows), no[place[p]]))
    count = int(dense.sum())
    left[:count] = True
    for i, j in near_pairs(x, size, count, search):
        at = np.lexsort((j, i))
        i, j = i[at], j[at]
        new = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
        nth = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
        keep = nth < STARS
        left[i[~keep]] = left[j[~keep]] = True
        a.append(no[i[keep]])
        b.append(no[j[keep]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b]), no[left]


def pairs_between(no: np.ndarray, center: np.ndarray, x: np.ndarray, size: np.ndarray, parity: np.ndarray, search: Search) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The possible pairs of a shard within the radius whose ends have different centers."""
    order = np.lexsort((no, center))
    no, center, x, size, parity = no[order], center[order], x[order], size[order], parity[order]
    begin = np.flatnonzero(np.r_[True, center[1:] != center[:-1]])
    begin = begin[np.searchsorted(begin, np.arange(len(no)), "right") - 1]  # where a row's center begins: all before it have others
    near = _Near(x, search.first)
    for at in range(0, len(no), near.block):
        stop = min(at + near.block, len(no))
        i, j = near.pairs(at, stop, int(begin[stop - 1]))
        keep = (j < begin[i]) & _fits(size[i], size[j])
        i, j = i[keep], j[keep]
        keep = (apart(x[i], x[j]) <= search.radius) & (9 * apart(parity[i], parity[j]) <= size[i] + size[j])
        if keep.any():
            yield no[i[keep]], no[j[keep]]


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parity bits differ in no more places than the bound on similarity allows."""
    for b in batches:
        x, y = _words(b.column(3), BITS // 64), _words(b.column(5), BITS // 64)
        sizes = b.column(2).to_numpy().astype(np.int64) + b.column(4).to_numpy()
        yield b.select(["a", "b"]).filter(pa.array(9 * apart(x, y) <= sizes))


def _links(pairs: DataFrame, sets: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``(a, b)`` of those of ``pairs (a, b)`` that are alike."""
    x = sets.select(F.col("no").alias("a"), F.col("size").alias("size_a"), F.col("parity").alias("parity_a"))
    y = sets.select(F.col("no").alias("b"), F.col("size").alias("size_b"), F.col("parity").alias("parity_b"))
    bounded = pairs.join(x, "a").join(y, "b").select("a", "b", "size_a", "parity_a", "size_b", "parity_b")
    asked = materialize(bounded.mapInArrow(_possible, "a long, b long"), "asked")
    wanted = asked.select(F.col("a").alias("no")).union(asked.select("b")).distinct()
    least = sets.join(wanted, "no").select("no", F.col("some.id").alias("some_id"), F.col("some.row").alias("some_row"))
    held = texts.join(least, texts["id"].eqNullSafe(least["some_id"]) & (texts["row"] == least["some_row"])).select("no", "text")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t, width).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["no", "h"])

    held = materialize(held.mapInArrow(shingles, "no long, h binary"), "sets")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            kept = [alike(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) for s, t in zip(x, y, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    both = asked.join(held.select(F.col("no").alias("a"), F.col("h").alias("x")), "a").join(held.select(F.col("no").alias("b"), F.col("h").alias("y")), "b")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long"), "links")


def candidates(sets: DataFrame, search: Search) -> tuple[DataFrame, DataFrame]:
    """``(a, b)`` pairs, and ``(shard, no)`` rows whose pairs are not all among them, of ``sets (no, size, print)``."""
    spark, words = sets.sparkSession, search.words
    rows = sets.where("size > 0").select("no", "size", "print")
    planned = rows.orderBy(F.xxhash64("print"), "no").select("print").limit(SAMPLE).toArrow().column(0)
    forest = Forest(_words(planned, words), rows.count(), 1, search.parts, shard=SHARD, r=1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                routed = list(forest.route(_words(some.column(2), words)))
                numbers = np.repeat(np.array([n for n, _ in routed], np.int32), [len(r) for _, r in routed])
                part = some.take(pa.array(np.concatenate([r for _, r in routed])))
                yield pa.RecordBatch.from_arrays([pa.array(numbers), *part.columns], names=["shard", "no", "size", "print"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for number, b in by_shard(batches):
            a, c, left = shard_pairs(b.column(1).to_numpy(), _words(b.column(3), words), b.column(2).to_numpy().astype(np.int64), search)
            found = _batch(a, c)
            yield pa.RecordBatch.from_arrays([pa.nulls(found.num_rows, pa.int32()), *found.columns], names=["shard", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(left), number, np.int32)), pa.array(left), pa.nulls(len(left), pa.int64())], names=["shard", "a", "b"])

    dealt = rows.mapInArrow(deal, "shard int, no long, size int, print binary")
    found = materialize(dealt.repartition(partitions(spark), "shard").sortWithinPartitions("shard").mapInArrow(link, "shard int, a long, b long"), "candidates")
    return found.where("shard IS NULL").select("a", "b").distinct(), found.where("shard IS NOT NULL").select("shard", F.col("a").alias("no"))


def _rest(left: DataFrame, stars: DataFrame, sets: DataFrame, search: Search) -> DataFrame:
    """Pairs ``(a, b)`` of different components among rows ``left (shard, no)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in by_shard(batches):
            cols = [b.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3)]
            for a, c in pairs_between(cols[0], cols[1], _words(b.column(4), search.words), cols[2], _words(b.column(5), BITS // 64), search):
                yield _batch(a, c)

    rows = left.join(sets.select("no", "size", "print", "parity"), "no").join(stars, "no", "left")
    rows = rows.select("shard", "no", F.coalesce("center", "no").alias("center"), "size", "print", "parity")
    return rows.repartition(partitions(sets.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long").distinct()


def _components(links: DataFrame, sets: DataFrame) -> DataFrame:
    """``(no, center, class_id)`` of each linked set but the centers.

    A set is named by (no id, least id, number), so the least name of a component gives its
    class and nothing is joined by component, of which one may hold a third of all sets.
    """
    name = F.struct(F.isnull("least").alias("none"), F.coalesce("least", F.lit(0)).alias("least"), F.col("no").alias("no"))
    named = sets.select("no", name.alias("name"))
    ends = links.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return components(ends).select(F.col("node.no").alias("no"), F.col("center.no").alias("center"), F.when(~F.col("center.none"), F.col("center.least")).alias("class_id"))


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``(id, row, class_id)`` of each row of ``df``: ``row`` is XXH64 of its text, ``class_id`` the least id that its links reach."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("binary").alias("text"))
    search = Search.over(df.count())
    rows = materialize(_described(texts, width, search.words), "described")
    one = rows.groupBy("mark").agg(F.min("id").alias("least"), F.min(F.struct("id", "row")).alias("some"), *(F.first(c).alias(c) for c in ("size", "parity", "print")))
    sets = materialize(one.withColumn("no", F.monotonically_increasing_id()), "distinct")
    pairs, left = candidates(sets, search)
    links = _links(pairs, sets, texts, width)
    stars = _components(links, sets)
    if not left.isEmpty():
        more = _rest(left, stars.select("no", "center"), sets, search).join(pairs, ["a", "b"], "left_anti")
        more = _links(materialize(more, "pairs"), sets, texts, width)
        if not more.isEmpty():
            stars = _components(links.union(more), sets)
    linked = stars.select("no", F.struct("class_id").alias("of"))
    classes = sets.join(linked, "no", "left").select("mark", F.when(F.col("of").isNull(), F.col("least")).otherwise(F.col("of.class_id")).alias("class_id"))
    return rows.select("id", "row", "mark").join(classes, "mark").select("id", "row", "class_id")
