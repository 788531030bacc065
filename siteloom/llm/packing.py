"""Best-fit packing planned on a histogram of lengths.

The plan works on counts, never on documents: lengths from long to short, each length's
whole count at a time into the fullest open sequences it fits. Sequences that hold the
same are one group, so the plan has a few entries a length at any corpus size. Each
entry is a run: documents of one length by rank, so many to a sequence, at an offset.
A document then takes its slot by its rank within its length.

Defined cases: a null text counts as empty and still has its end id; repeated rows are
packed as often as they occur; ties within a length are broken by id, piece and digest;
an empty table packs into nothing; columns beyond the named ones are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import materialize, partitions
from siteloom.llm.tokens import encoder

#: Tokens of a sequence; the id that ends a document.
CAPACITY, END = 4096, 1


class Run(NamedTuple):
    """``bins * each`` documents of ``length``, from rank ``first`` on, in sequences ``sequence`` and up."""

    length: int
    first: int
    bins: int
    each: int
    sequence: int
    offset: int


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over counts; equal to placing the documents one by one."""
    runs: list[Run] = []
    spaces: list[int] = []  # sorted free spaces that some group has
    groups: dict[int, list[tuple[int, int]]] = {}  # free space: (first sequence, sequences)
    made = 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in groups:
                groups[space] = []
                insort(spaces, space)
            groups[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit 1 to {capacity}")
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                fresh = -(-left // (capacity // length))
                put(capacity, made, fresh)
                made += fresh
                continue
            space = spaces[at]
            first, n = groups[space].pop()
            if not groups[space]:
                del groups[space], spaces[at]
            each = space // length
            full = min(n, left // each)
            if full:
                runs.append(Run(length, rank, full, each, first, capacity - space))
                put(space - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = n - full
            if left and rest:  # fewer are left than one sequence takes
                runs.append(Run(length, rank, 1, left, first + full, capacity - space))
                put(space - left * length, first + full, 1)
                full, rest, left = full + 1, rest - 1, 0
            put(space, first + full, rest)
    return runs


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = True, place: Column | None = None) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids][, place])`` of each document's ids with its end id.

    Only documents longer than ``capacity`` are cut, into pieces of ``capacity`` ids.
    ``place``, a string of each document, tells its copies apart and orders them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                rows: list[tuple] = []
                places = part.column(2).to_pylist()
                for key, ids, at_place in zip(part.column(0).to_pylist(), tool.encode(part.column(1).to_pylist()), places, strict=True):
                    ids = np.append(ids, np.uint32(end)).astype("<u4", copy=False)
                    for k in range(0, len(ids), capacity):
                        raw = ids[k : k + capacity].tobytes()
                        rows.append((key, k // capacity, k, len(raw) // 4, zlib.crc32(raw), raw, at_place))
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(cols[i], k) for i, (_, k) in enumerate(made) if k is not None], names=[n for n, k in made if k is not None])

    made = [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    made += [("ids", pa.binary() if keep_ids else None), ("place", None if place is None else pa.string())]
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (F.lit(None).cast("string") if place is None else place).alias("place"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", place string" * (place is not None))


def pack(rows: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("id", "piece", "ids_crc32")) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset`` for their ``length``.

    Rank within length is counted in two steps, so that a length with a third of all
    rows is dealt over many tasks: rows of a length and shard are numbered, then moved
    by the count of the shards before. The histogram and the plan are bounded by
    ``capacity``, which makes them safe to hand to every task.
    """
    spark = rows.sparkSession
    shards = max(8, partitions(spark))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"))
    counts = materialize(rows.groupBy("length", "shard").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(best_fit_plan(histogram, capacity))
    key = np.array([(r.length << 48) + r.first for r in runs], np.int64)
    first, each, sequence, offset = (np.array([getattr(r, c) for r in runs], np.int64) for c in ("first", "each", "sequence", "offset"))

    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "shard").orderBy(*order))
    ranked = rows.withColumn("number", number).join(starts, ["length", "shard"]).withColumn("rank", F.col("before") + F.col("number") - 1)
    kept = [c for c in rows.columns if c != "shard"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            step = rank - first[at]
            arrays = [b.column(c) for c in kept]
            arrays += [pa.array(sequence[at] + step // each[at]), pa.array(offset[at] + step % each[at] * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "sequence_id", "offset"])

    schema = rows.select(kept).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*kept, "rank").mapInArrow(place, schema)


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = True, place: Column | None = None) -> DataFrame:
    """Pieces of all documents with their places; ids are encoded once, into the shared folder.

    Of a length, documents take slots by ``place`` where it is given, else by id.
    """
    made = materialize(pieces(df, tokenizer, id_col, text_col, capacity, end, keep_ids, place), "pieces")
    return pack(made, capacity, ("id", "piece", "ids_crc32") if place is None else ("place", "id", "piece"))
