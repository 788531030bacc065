"""SimHash near-duplicates through a forest of vantage-point trees.

Fingerprints within ``radius`` differing bits are linked, exactly, and every document
gets the class of all it reaches over links. How pairs are found:

* Bits are cut into ``parts`` ranges. A linked pair differs in at most
  ``r = radius // parts`` bits of some range, and the distance within a range obeys
  the triangle inequality, so each range has its own vantage-point tree with bound r.
* A node of a tree has a vantage point and a threshold m: distances up to m go left,
  larger ones right. A pair within r can only straddle it if the right one is at most
  m + r away, so that overlap also goes left; nothing else is copied, nothing is lost.
* The leaves are shards. A task reads a shard's fingerprints and links them around
  pivots (again with triangle bounds, in full bits), giving a spanning set of links,
  never all pairs of a group.

A tree is planned on the driver from a bounded sample of distinct fingerprints
(``SAMPLE``) and is bounded in size (``MOST``); every fingerprint is routed through it. The sample moves thresholds, that
is balance, and never decides which pairs are found.

Defined cases: null text counts as empty; no words give fingerprint zero, linked like
any other; equal texts share a class; repeated rows are kept; the class id is the least
id reached, null only if no reached row has an id; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import materialize, partitions
from siteloom.llm.graph import components
from siteloom.llm.setjoin import by_shard, near_copies
from siteloom.llm.simhash import _mix, shingle_hashes, vote
from siteloom.llm.vptree import SAMPLE, SHARD, Forest, apart

#: Into how many shards, overlaps aside, the driver's tree of a range may go at most.
MOST = 512
_NAME = 9  # bytes of a key before the fingerprint


def text_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, words: int = 1) -> DataFrame:
    """``(id, mark)``: 64 * ``words`` majority bits over all ``width``-word shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(1).to_pylist():
                h = shingle_hashes(t or b"", width)
                rows = np.stack([h, *(_mix(h + np.uint64(i)) for i in range(1, words))], axis=1)
                found.append(np.packbits(vote(rows) > 0).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["id", "mark"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, mark binary")


def _array(marks: list[bytes], words: int) -> np.ndarray:
    return np.frombuffer(b"".join(marks), ">u8").astype(np.uint64).reshape(-1, words)


def _linked(x: np.ndarray, radius: int, block: int = 128) -> np.ndarray:
    """The rows of ``x`` that any other row links to, in blocks of rows against all later ones."""
    active = np.zeros(len(x), bool)
    for at in range(0, len(x), block):
        near = apart(x[at : at + block][:, None, :], x[at:][None, :, :]) <= radius
        some = np.arange(near.shape[0])
        near[some, some] = False  # of itself
        active[at : at + block] |= near.any(axis=1)
        active[at:] |= near.any(axis=0)
    return np.flatnonzero(active)


def shard_links(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning set of the links within ``radius`` among the rows of ``x``.

    Rows without any link go first, which are most. Then pivots: each takes the rows left within the radius, so pivots are further
    apart than it. A link between two stars then has an end that is no pivot and lies
    within twice the radius of the other star's pivot; only those are compared.
    """
    links: list[tuple[int, int]] = []
    stars: list[np.ndarray] = []
    left = _linked(x, radius)
    y = x[left]
    while len(left):
        near = apart(y, y[0]) <= radius
        star = left[near]
        stars.append(star)
        links += [(int(star[0]), int(i)) for i in star[1:]]
        left, y = left[~near], y[~near]
    if len(stars) < 2 or all(len(s) == 1 for s in stars):
        return links
    pivots = x[[s[0] for s in stars]]
    root = list(range(len(stars)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, star in enumerate(stars):
        members = star[1:]
        found: dict[int, list[np.ndarray]] = {}
        for k in range(0, len(members), 256):
            part = members[k : k + 256]
            d = apart(x[part][:, None, :], pivots[None, :, :])
            rows, cols = np.nonzero(d <= 2 * radius)
            for j in np.unique(cols):
                if find(int(j)) != find(i):
                    found.setdefault(int(j), []).append(part[rows[cols == j]])
        for j, groups in found.items():
            if find(i) == find(j):
                continue
            mine, other = np.concatenate(groups), stars[j]
            other = other[apart(x[other], x[star[0]]) <= 2 * radius]
            for k in range(0, len(mine), 256):
                d = apart(x[mine[k : k + 256]][:, None, :], x[other][None, :, :]) <= radius
                if d.any():
                    a, b = np.argwhere(d)[0]
                    links.append((int(mine[k + a]), int(other[b])))
                    root[find(i)] = find(j)
                    break
    return links


def large_shard_links(x: np.ndarray, radius: int, bit_range: tuple[np.ndarray, int], r: int, shard: int) -> list[tuple[int, int]]:
    """:func:`shard_links` of a shard of any size: a large one is parted by a tree of its own first."""
    if len(x) <= 4 * shard:
        return shard_links(x, radius)
    tree = Forest.within(x, *bit_range, r, shard)
    return [(int(rows[a]), int(rows[b])) for _, rows in tree.route(x) for a, b in shard_links(x[rows], radius)]


def _key() -> Column:
    """A node: null flag, the least id so that bytes sort like numbers, and the fingerprint ``mark``."""
    least = F.lpad(F.hex(F.coalesce("least", F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.unhex(F.when(F.isnull("least"), "01").otherwise("00")), F.unhex(least), F.col("mark"))


def _key_id(key: Column) -> Column:
    number = F.conv(F.hex(F.substring(key, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(F.hex(F.substring(key, 1, 1)) == "00", number)


def fingerprint_links(nodes: DataFrame, radius: int, parts: int, words: int = 1, shard: int = SHARD, sample: int = SAMPLE, most: int = MOST) -> DataFrame:
    """``(a, b)`` links of ``nodes (key)`` that span all pairs within ``radius``.

    A key is any nine bytes and a fingerprint. The driver's trees stop at ``most`` shards'
    worth of parting, whatever the number of fingerprints; past it shards grow, and tasks
    go on parting theirs.
    """
    spark: SparkSession = nodes.sparkSession
    planned = [bytes(r[0])[_NAME:] for r in nodes.orderBy(F.xxhash64("key"), "key").select("key").limit(sample).collect()]
    count = nodes.count()
    forest = Forest(_array(planned, words), count, radius, parts, max(shard, count // most))
    wide = _NAME + 8 * words

    def keys(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, wide)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = keys(b.column(0))
            marks = np.ascontiguousarray(raw[:, _NAME:]).view(">u8").astype(np.uint64)
            for number, rows in forest.route(marks):
                kept = pa.FixedSizeBinaryArray.from_buffers(pa.binary(wide), len(rows), [None, pa.py_buffer(raw[rows].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number, np.int32)), kept.cast(pa.binary())], names=["shard", "key"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in by_shard(batches):
            raw = keys(b.column(1))
            x = np.ascontiguousarray(raw[:, _NAME:]).view(">u8").astype(np.uint64)
            found = large_shard_links(x, radius, forest.ranges[number], forest.r, shard)
            ends = [pa.array([raw[i].tobytes() for i in side], pa.binary()) for side in ([i for i, _ in found], [j for _, j in found])]
            yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    dealt = nodes.select("key").mapInArrow(deal, "shard int, key binary")
    return dealt.repartition(partitions(spark), "shard").sortWithinPartitions("shard").mapInArrow(link, "a binary, b binary")


def near_classes(marks: DataFrame, radius: int = 4, parts: int = 3, words: int = 1, shard: int = SHARD, sample: int = SAMPLE, most: int = MOST) -> DataFrame:
    """``(id, mark, class_id)`` for each row of ``marks (id, mark)``: the least id its links reach.

    A node's name sorts by its least id, so the center of a component names its class and
    nothing is joined by component, of which one may hold a third of all nodes.
    """
    marks = materialize(marks, "marks")
    distinct = materialize(marks.groupBy("mark").agg(F.min("id").alias("least")).select("mark", _key().alias("key")), "distinct")
    stars = components(fingerprint_links(distinct, radius, parts, words, shard, sample, most))
    placed = distinct.join(stars.withColumnRenamed("node", "key"), "key", "left")
    classes = placed.select("mark", _key_id(F.coalesce("center", "key")).alias("class_id"))
    return marks.join(classes, "mark", "left")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, parts: int = 3, words: int = 1) -> DataFrame:
    """``(id, mark, class_id)`` of every row of ``df``."""
    return near_classes(text_fingerprints(df, id_col, text_col, width, words), radius, parts, words)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The rows of ``df`` whose id is the least of their class.

    A document is an id with a text: rows that repeat a kept one stay with it, an id's other
    text is judged for itself, rows without an id stay. Candidates come from SimHash
    fingerprints through vantage-point trees; a link is a Jaccard similarity of
    ``width``-word shingle sets of 0.8 or more.
    """
    classes = near_copies(df, id_col, text_col, width)
    lost = classes.where(F.col("id") > F.col("class_id")).select("id", F.col("row").alias("text")).distinct()
    keyed = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text"))
    return keyed.join(lost, ["id", "text"], "left_anti").select("row.*")
