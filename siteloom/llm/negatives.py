"""Hard negatives through a vector-approximation file.

Every dimension is cut into cells whose edges come from one mergeable quantile sketch a
dimension, with the exact least and largest value at the ends. The file has a byte a
dimension and row, the cell, beside the exact vector. The edges of a row's cells are looked
up in the table of edges; with an anchor's components, by sign, they bound the row's score
from both sides. Only rows whose bounds may enter what is asked, the best of a label or the
best inside a window of scores, are scored exactly.

Anchors are taken in groups of bounded size, which go to all rows in turn; a task holds as
many rows an anchor as are asked for, whatever it reads, and its lists are merged by anchor.

Defined cases: rows with a null label, a null vector or a null component take no part; a
null id is least; ties go by id, then by stored row; repeated rows are rows of their own,
so one is another's positive; shorter vectors count as padded with zeros; scores below 2^53
are exact; an empty table, or one without anchors, gives an empty result; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import materialize, release

#: Cells a dimension; anchors and rows that meet at once; positives, negatives and the window in percent of the positive's score.
CELLS, ANCHORS, ROWS, POSITIVES, NEGATIVES, WINDOW = 256, 512, 2048, 5, 5, (80, 100)
_NO_ID = np.iinfo(np.int64).min
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_components(vector: str, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, null if the vector is null or a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(fine, F.transform(vector, lambda x: F.floor(scale * x.cast("double"))))


class VectorFile(NamedTuple):
    """Stored rows ``(row, id, label, anchor, cells, vector)`` and the edges of cells, a row a dimension."""

    rows: DataFrame
    edges: np.ndarray

    def bounds(self, anchors: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each anchor (down) with each row (across)."""
        return score_bounds(self.edges, anchors, cells)


def score_bounds(edges: np.ndarray, anchors: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(cells.shape[1])
    low, high = edges[at, cells].astype(float).T, edges[at, cells.astype(np.int64) + 1].astype(float).T
    up, down = np.maximum(anchors, 0).astype(float), np.minimum(anchors, 0).astype(float)
    return up @ low + down @ high, up @ high + down @ low


def cells_of(edges: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The cell of each component: between two edges, both included."""
    out = np.empty(vectors.shape, np.uint8)
    for d, inner in enumerate(edges[:, 1:-1]):
        out[:, d] = np.searchsorted(inner, vectors[:, d], side="right")
    return out


def build_file(df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector") -> VectorFile | None:
    """Approximate every row of ``df``, whose vectors are arrays of whole numbers; None without any row."""
    some = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<bigint>").alias("vector"))
    some = some.where(F.col("label").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False)))
    rows = materialize(some.withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = rows.agg(F.max(F.size("vector"))).first()[0]
    if not size:
        return None
    padded = rows.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("vector"))))
    inner = F.percentile_approx("x", [i / CELLS for i in range(1, CELLS)], 10 * CELLS)
    found = padded.select(F.posexplode("vector").alias("d", "x")).groupBy("d").agg(F.min("x").alias("a"), inner.alias("q"), F.max("x").alias("b"))
    edges = np.array([[r.a, *r.q, r.b] for r in sorted(found.collect(), key=lambda r: r.d)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = cells_of(edges, _vectors(batch, size))
            packed = pa.array([c.tobytes() for c in cells], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], [*batch.schema.names, "cells"])

    stored = materialize(padded.mapInArrow(run, "id long, label string, anchor boolean, vector array<bigint>, row long, cells binary"), "approximations")
    release(df.sparkSession, rows)
    return VectorFile(stored, edges)


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch["vector"].flatten().to_numpy().reshape(batch.num_rows, size)


class _Some(NamedTuple):
    """Rows of a file as arrays."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    cells: np.ndarray | None


def _parts(batches: Iterator[pa.RecordBatch], size: int, numbers: dict[str, int]) -> Iterator[_Some]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            label = np.array([numbers.get(x, -1) for x in part["label"].to_pylist()], np.int64)
            cells = np.frombuffer(b"".join(part["cells"].to_pylist()), np.uint8).reshape(part.num_rows, size)
            yield _Some(part["row"].to_numpy(), pc.fill_null(part["id"], int(_NO_ID)).to_numpy(), label, _vectors(part, size), cells)


class _Best:
    """The ``k`` best rows of each key so far: by score, then id, then row."""

    def __init__(self, keys: int, k: int) -> None:
        self.k, self.bar = k, np.full(keys, -np.inf)
        self.key, self.score, self.id, self.row = (np.empty(0, np.int64) for _ in range(4))

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        key, score, ids, rows = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score, key))
        key, score, ids, rows = key[order], score[order], ids[order], rows[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        top = place < self.k
        self.key, self.score, self.id, self.row = key[top], score[top], ids[top], rows[top]
        last = place[top] == self.k - 1
        self.bar[self.key[last]] = self.score[last]

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(self.key, pa.int64()), pa.array(self.score, pa.int64()), pa.array(self.id, pa.int64(), mask=self.id == _NO_ID), pa.array(self.row, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["key", "score", "id", "row"])


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each line, minus infinity if it is shorter."""
    return np.partition(values, -k, axis=1)[:, -k] if values.shape[1] >= k else np.full(len(values), -np.inf)


def _exact(anchors: np.ndarray, vectors: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 1 << 16):
        s = slice(at, at + (1 << 16))
        out[s] = np.einsum("ij,ij->i", anchors[a[s]], vectors[b[s]])
    return out


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


_FOUND = "key long, score long, id long, row long"


def _positives(file: VectorFile, anchors: _Some, numbers: dict[str, int], k: int) -> DataFrame:
    """``(key, score, id, row, rank)``: the best other rows of each anchor's label, the anchor's place in the group as key."""
    size = anchors.vector.shape[1]
    edges = file.edges
    shared = file.rows.sparkSession.sparkContext.broadcast((anchors, numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, labels = shared.value
        best = _Best(len(asked.row), k)
        for part in _parts(batches, size, labels):
            low, high = score_bounds(edges, asked.vector, part.cells)
            mine = (asked.label[:, None] == part.label) & (asked.row[:, None] != part.row)
            bar = np.maximum(best.bar, _kth(np.where(mine, low, -np.inf), k))
            a, b = np.nonzero(mine & (high >= bar[:, None]))
            best.add(a, _exact(asked.vector, part.vector, a, b), part.id[b], part.row[b])
        yield best.batch()

    return _top(file.rows.select("row", "id", "label", "cells", "vector").mapInArrow(run, _FOUND), k)


def _negatives(file: VectorFile, anchors: _Some, numbers: dict[str, int], low_score: np.ndarray, high_score: np.ndarray, k: int) -> DataFrame:
    """The best rows of other labels inside each window; its key is the anchor's place times the windows an anchor, plus the window's."""
    size, slots = anchors.vector.shape[1], low_score.shape[1]
    edges = file.edges
    shared = file.rows.sparkSession.sparkContext.broadcast((anchors, numbers, low_score, high_score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, labels, least, most = shared.value
        best = _Best(len(asked.row) * slots, k)
        for part in _parts(batches, size, labels):
            low, high = score_bounds(edges, asked.vector, part.cells)
            other = asked.label[:, None] != part.label
            for slot in range(slots):
                start, stop = least[:, slot, None], most[:, slot, None]
                inside = np.where(other & (low >= start) & (high <= stop), low, -np.inf)
                bar = np.maximum(start[:, 0], np.maximum(best.bar[slot::slots], _kth(inside, k)))
                a, b = np.nonzero(other & (low <= stop) & (high >= bar[:, None]))
                score = _exact(asked.vector, part.vector, a, b)
                fits = (score >= least[a, slot]) & (score <= most[a, slot])
                best.add(a[fits] * slots + slot, score[fits], part.id[b[fits]], part.row[b[fits]])
        yield best.batch()

    return _top(file.rows.select("row", "id", "label", "cells", "vector").mapInArrow(run, _FOUND), k)


def _groups(file: VectorFile) -> Iterator[tuple[_Some, dict[str, int]]]:
    """Anchors in groups, with numbers for the labels that they have."""
    group: list = []

    def made() -> tuple[_Some, dict[str, int]]:
        numbers: dict[str, int] = {}
        label = np.array([numbers.setdefault(r.label, len(numbers)) for r in group], np.int64)
        ids = np.array([_NO_ID if r.id is None else r.id for r in group], np.int64)
        return _Some(np.array([r.row for r in group], np.int64), ids, label, np.array([r.vector for r in group], np.int64), None), numbers

    for row in file.rows.where("anchor").select("row", "id", "label", "vector").toLocalIterator():
        group.append(row)
        if len(group) == ANCHORS:
            yield made()
            group = []
    if group:
        yield made()


def mine(file: VectorFile, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Positives are an anchor's best other rows of its label. For each, negatives are the best
    rows of other labels whose score lies within ``window`` percent of the positive's.
    """
    spark = file.rows.sparkSession
    none = np.iinfo(np.int64)
    out = []
    for anchors, numbers in _groups(file):
        found = _positives(file, anchors, numbers, positives).collect()
        least, most = np.full((len(anchors.row), positives), none.max), np.full((len(anchors.row), positives), none.min)
        pairs = []
        for r in found:
            least[r.key, r.rank - 1], most[r.key, r.rank - 1] = -(-window[0] * r.score // 100), window[1] * r.score // 100
            name = int(anchors.id[r.key])
            pairs.append((r.key * positives + r.rank - 1, None if name == _NO_ID else name, r.id, r.score))
        if not pairs:
            continue
        near = _negatives(file, anchors, numbers, least, most, negatives).select("key", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        known = spark.createDataFrame(pairs, "key long, anchor_id long, positive_id long, positive_score long")
        joined = near.join(known, "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out.append(materialize(joined, "negatives"))
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], _RESULT)


def hard_negatives(df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector", **asked) -> DataFrame:
    """File and search in one call, see :func:`mine`."""
    file = build_file(df, anchor, id_col, label_col, vector_col)
    return mine(file, **asked) if file else df.sparkSession.createDataFrame([], _RESULT)
