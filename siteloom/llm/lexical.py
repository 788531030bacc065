"""Ranked lexical search over a two-level quantised index.

The index is a table with one row for each block of documents, so it is written and read
without a shuffle. Its first level holds, for every term of the block, the documents that
have it and a byte each: the term's impact, rounded up. Sums of weights and bytes bound a
document's score from above, and from below if each byte is taken one lower. The second
level holds occurrences and lengths, from which scores are whole numbers.

A search looks at the first level of every block. The k-th largest lower bound of a block,
or the k-th best score that the task has seen if that is more, is what a document's upper
bound has to reach; every document that reaches it is scored from the second level. Tasks
hold k documents an item, whatever they read; their lists are merged by item. Items are
searched in groups of bounded size, so what is sent to the tasks does not grow with them.

Defined cases: null text has no terms; documents without terms are in no list and not
counted; a null document id is least; equal scores go by ascending id; repeated rows are
documents, and items, of their own; very long texts count whole; an item of unknown terms
or none has no rows; empty tables give empty results; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import materialize

#: Terms are runs of other characters than these; only A to Z change case.
TERM, BREAK = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest impact before weights, and its byte.
TOP, BYTE = 1_000_000, 255
#: Results an item; documents and characters of a block; items and terms that are searched at once.
K, BLOCK_DOCS, BLOCK_CHARS, MOST_ITEMS, MOST_TERMS = 50, 4096, 1 << 20, 1024, 100_000
_NO_ID = np.iinfo(np.int64).min
_BLOCK = "ids array<bigint>, scale array<bigint>, terms array<string>, starts binary, docs binary, impacts binary, counts binary"


class Index(NamedTuple):
    """Stored blocks, documents that have terms, terms of them all with repeats."""

    blocks: DataFrame
    documents: int
    words: int


def gain(tf: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * scale)


def _indexed(ids: pa.Array, texts: pa.Array, documents: int, words: int) -> pa.RecordBatch:
    """The row of one block."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts.cast(pa.large_string())), BREAK)
    terms, doc = parts.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(terms), 0)
    terms, doc = terms.filter(real), doc[real.to_numpy(zero_copy_only=False)]
    coded = pc.dictionary_encode(terms)
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(texts) + doc, return_counts=True)
    term, doc_of = key // len(texts), key % len(texts)
    scale = 50 + (50 * np.bincount(doc, minlength=len(texts)).astype(np.int64) * documents) // words
    impact = -(-gain(tf, scale[doc_of]) * BYTE // TOP)
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(coded.dictionary)))])
    cells = [starts.astype("<i4"), doc_of.astype("<u2" if len(texts) <= 1 << 16 else "<u4"), impact.astype("u1"), tf.astype("<i4")]
    columns = [pa.array([ids.cast(pa.int64()).to_pylist()], pa.list_(pa.int64())), pa.array([scale.tolist()], pa.list_(pa.int64())), pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns + [pa.array([c.tobytes()], pa.binary()) for c in cells], ["ids", "scale", "terms", "starts", "docs", "impacts", "counts"])


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Two passes over the texts: one counts terms, one writes blocks."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.regexp_count("text", F.lit(TERM))
    total = rows.select(n.cast("long").alias("n")).agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    documents, words = total["documents"], total["words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def full() -> pa.RecordBatch:
            return _indexed(pa.concat_arrays(ids), pa.concat_arrays(texts), documents, words)

        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                stop = int(np.searchsorted(sizes, before + BLOCK_CHARS - size))  # a row that does not fit is the last of its block
                stop = min(stop + 1, batch.num_rows, at + BLOCK_DOCS - sum(map(len, ids)))
                ids.append(batch["id"].slice(at, stop - at))
                texts.append(batch["text"].slice(at, stop - at))
                size += int(sizes[stop - 1] - before)
                at = stop
                if size >= BLOCK_CHARS or sum(map(len, ids)) >= BLOCK_DOCS:
                    yield full()
                    ids, texts, size = [], [], 0
        if size:
            yield full()

    return Index(materialize(rows.where("text <> ''").mapInArrow(run, _BLOCK), "lexical"), documents, words)


class _Items(NamedTuple):
    """Some items: their ids, their distinct terms, and each item's terms by number."""

    ids: list
    terms: list[str]
    of: list[np.ndarray]


def _groups(items: DataFrame, id_col: str, text_col: str) -> Iterator[_Items]:
    """The items in groups of bounded size."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    listed = items.select(F.col(id_col).alias("id"), F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"({TERM})"), 1)).alias("terms"))
    ids, number, of = [], {}, []
    for row in listed.where(F.size("terms") > 0).toLocalIterator():
        if ids and (len(ids) == MOST_ITEMS or len(number) + len(row.terms) > MOST_TERMS):
            yield _Items(ids, list(number), of)
            ids, number, of = [], {}, []
        ids.append(row.id)
        of.append(np.array([number.setdefault(t, len(number)) for t in row.terms]))
    if ids:
        yield _Items(ids, list(number), of)


def _rows(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[tuple[pa.StructScalar, np.ndarray, np.ndarray]]:
    """Each block with its starts and the places of ``terms`` in it, -1 where it has none."""
    wanted = pa.array(terms, pa.string())
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch[n][i] for n in batch.schema.names}
            at = pc.fill_null(pc.index_in(wanted, value_set=row["terms"].values), -1).to_numpy(zero_copy_only=False)
            yield row, np.frombuffer(row["starts"].as_buffer(), "<i4"), at


def document_frequencies(index: Index, terms: list[str]) -> np.ndarray:
    """How many documents hold each term, added up in tasks first."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(shared.value), np.int64)
        for _, starts, at in _rows(batches, shared.value):
            held = np.flatnonzero(at >= 0)
            found[held] += starts[at[held] + 1] - starts[at[held]]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some], pa.int64())], ["term", "df"])

    out = np.zeros(len(terms), np.int64)
    for row in index.blocks.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row.term] = row.df
    shared.destroy()
    return out


class _Best:
    """The best documents of one item so far."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def bar(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]


def _score(best: _Best, weights: np.ndarray, begin: np.ndarray, end: np.ndarray, docs: np.ndarray, impacts: np.ndarray, counts: np.ndarray, scale: np.ndarray, ids: np.ndarray) -> None:
    """Put those documents of a block into ``best`` that one item ranks high."""
    place = np.concatenate([np.arange(a, b) for a, b in zip(begin, end, strict=True)])
    weight, doc = np.repeat(weights, end - begin), docs[place]
    # Sums below 2^53 are exact in doubles.
    upper = np.bincount(doc, weight * impacts[place], len(ids)).astype(np.int64)
    lower = upper - np.bincount(doc, weight, len(ids)).astype(np.int64)
    bar = best.bar() * BYTE
    if np.count_nonzero(upper) >= best.k:
        bar = max(bar, int(np.partition(lower[upper > 0], -best.k)[-best.k]) * TOP)
    able = (upper > 0) & (upper * TOP >= bar)
    mine = able[doc]
    exact = np.zeros(len(ids), np.int64)
    at = doc[mine]
    np.add.at(exact, at, weight[mine] * gain(counts[place[mine]].astype(np.int64), scale[at]))
    found = np.flatnonzero(exact > 0)
    best.add(exact[found], ids[found])


def _search(index: Index, items: _Items, k: int) -> DataFrame:
    spark = index.blocks.sparkSession
    df = document_frequencies(index, items.terms)
    weights = np.floor(1000 * np.log((2.0 * index.documents + 2) / (2 * df + 1))).astype(np.int64)
    shared = spark.sparkContext.broadcast((items.terms, items.of, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, of, weight = shared.value
        best = [_Best(k) for _ in of]
        for row, starts, at in _rows(batches, terms):
            docs = np.frombuffer(row["docs"].as_buffer(), "<u2" if len(row["ids"]) <= 1 << 16 else "<u4")
            impacts, counts = np.frombuffer(row["impacts"].as_buffer(), "u1"), np.frombuffer(row["counts"].as_buffer(), "<i4")
            scale, ids = row["scale"].values.to_numpy(), pc.fill_null(row["ids"].values, int(_NO_ID)).to_numpy()
            for own, held in zip(of, best, strict=True):
                if len(here := own[at[own] >= 0]):
                    _score(held, weight[here], starts[at[here]], starts[at[here] + 1], docs, impacts, counts, scale, ids)
        item = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        ids = np.concatenate([b.ids for b in best])
        columns = [pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(np.concatenate([b.scores for b in best]), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    found = index.blocks.mapInArrow(run, "item long, doc_id long, score long").withColumn("rank", rank).where(F.col("rank") <= k)
    return materialize(found, "ranked")


def search(index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = K) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item with a score above 0, the item's id under its own name."""
    spark = items.sparkSession
    kind = items.schema[id_col].dataType.simpleString()
    found = []
    for group in _groups(items, id_col, text_col):
        names = spark.createDataFrame(list(enumerate(group.ids)), f"item long, name {kind}")
        found.append(_search(index, group, k).join(names, "item").select(F.col("name").alias(id_col), "rank", "doc_id", "score"))
    none = spark.createDataFrame([], f"`{id_col}` {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.union, found) if found else none
