"""Document fingerprints: weighted SimHash and its permuted block tables.

Defined cases: a null text counts as empty; an empty text has the all-zero
fingerprint; equal texts have equal fingerprints; repeated rows are kept, each with
its own result; rows with a null id come last in descending order; an empty table
gives an empty result; columns beyond the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import cut_points, partitions, range_bucket
from siteloom.llm.simhash import hamming, weighted_fingerprint

BITS = 128


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)``: 128 signed bits as 32 hex digits for each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [weighted_fingerprint(t or b"").hex() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["id", "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fingerprint string")


def edit(text: str, other: str) -> str:
    """``text`` whose last half (rounded down) gives way to the first as many code points of ``other``."""
    n = len(text) // 2
    return text[: len(text) - n] + other[:n]


def with_neighbour(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal rows out so that each one is followed by the next in descending id.

    Ids are cut into ranges of like counts by a quantile sketch. The first row of each
    range is also sent to the range before it (that of the first range to the last one),
    so a task sees the neighbour of its last row. Only range borders reach the driver.
    """
    n = partitions(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cuts = cut_points(rows, "id", n)
    bucket = range_bucket("id", cuts)
    heads = {r["bucket"]: r["id"] for r in rows.groupBy(bucket.alias("bucket")).agg(F.max("id").alias("id")).collect() if r["id"] is not None}
    rows = rows.withColumn("bucket", bucket)
    order = sorted(heads)
    home = [F.struct("bucket", F.lit(0).alias("guest"))]
    if order:
        follows = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}
        to = F.element_at(F.create_map(*[F.lit(x) for kv in follows.items() for x in kv]), F.col("bucket"))
        guest = F.struct(to.alias("bucket"), F.lit(1).alias("guest"))
        places = F.when(F.col("id").isin(list(heads.values())), F.array(*home, guest)).otherwise(F.array(*home))
    else:
        places = F.array(*home)
    dealt = rows.withColumn("at", F.explode(places)).select("id", "text", F.col("at.bucket").alias("bucket"), F.col("at.guest").alias("guest"))
    return dealt.repartitionById(max(1, len(cuts) + 1), F.col("bucket")).sortWithinPartitions("bucket", "guest", F.desc_nulls_last("id"), "text")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness, by a pass over neighbours.

    The edited text takes its end from the next row in descending id; after the last
    row comes the first. ``near_edited`` and ``near_next`` are shares of equal bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # (id, text, fingerprint) until its neighbour is seen
        names = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def done(row: tuple, other: str, mark: bytes) -> tuple:
            key, text, own = row
            new = edit(text, other)
            changed = own if new == text else weighted_fingerprint(new.encode())
            near = [1 - hamming(own, x) / BITS for x in (changed, mark)]
            return key, len(text), new, own.hex(), changed.hex(), *near

        for b in batches:
            out = []
            for key, text, guest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                text = text or ""
                mark = weighted_fingerprint(text.encode())
                if waiting:
                    out.append(done(waiting, text, mark))
                waiting = None if guest else (key, text, mark)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=names)
        if waiting:  # only without any id that is not null: the row is its own neighbour
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(done(waiting, waiting[1], waiting[2]), kinds, strict=True)], names=names)

    return with_neighbour(df, id_col, text_col).mapInArrow(run, "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edited_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`edited_fingerprints` with the edited text's SHA-256 in its place."""
    found = edited_fingerprints(df, id_col, text_col)
    return found.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")


def table_blocks(radius: int, blocks: int, bits: int = BITS) -> list[list[tuple[int, int]]]:
    """The permuted tables: bit ranges that form the key of each table.

    ``bits`` are cut into ``blocks`` ranges. At most ``radius`` of them can differ
    between two fingerprints within ``radius``, so some table that keys on
    ``blocks - radius`` ranges holds both under one key.
    """
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    spans = list(zip(cuts, cuts[1:], strict=False))
    return [list(kept) for kept in combinations(spans, blocks - radius)]


def _halves(hex_col: str) -> tuple[Column, Column]:
    return tuple(F.conv(F.substring(hex_col, at, 16), 16, -10).cast("long") for at in (1, 17))


def _bits(column: Column, start: int, stop: int) -> Column:
    """Bits ``start`` to ``stop`` of a 64-bit half, counted from the most significant."""
    return F.shiftrightunsigned(F.shiftleft(column, start), 64 - (stop - start))


def near_counts(rows: DataFrame, asked: Column, radius: int = 3, blocks: int = 4) -> DataFrame:
    """``(fingerprint, n_near)`` of the asked rows of ``rows (id, fingerprint)``: other rows within ``radius``.

    Copies are counted by fingerprint, so a group of copies is one entry of a table.
    """
    sizes = rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.max(asked).alias("asked"))
    mine = sizes.where("asked").select("fingerprint", F.col("n").alias("own"))
    pairs = near_matches(sizes, mine, radius, blocks)
    others = pairs.join(sizes.select("fingerprint", "n"), "fingerprint").groupBy(F.col("asked").alias("fingerprint")).agg(F.sum("n").alias("others"))
    return mine.join(others, "fingerprint", "left").select("fingerprint", (F.col("own") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"))


def near_matches(marks: DataFrame, asked: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """All pairs (asked fingerprint, other fingerprint) within ``radius`` differing bits.

    Both inputs have a column ``fingerprint``; equal fingerprints are one entry. Each
    pair comes from the first table whose key both share, so no distinct is needed.
    The default, four tables on 32 of 128 bits, keeps random candidates near zero.
    """
    tables = table_blocks(radius, blocks)

    def keyed(df: DataFrame) -> DataFrame:
        hi, lo = _halves("fingerprint")
        df = df.select("fingerprint").distinct().select("fingerprint", hi.alias("hi"), lo.alias("lo"))
        keys = []
        for spans in tables:
            parts = []
            for a, b in spans:
                if a < 64:
                    parts.append(_bits(F.col("hi"), a, min(b, 64)))
                if b > 64:
                    parts.append(_bits(F.col("lo"), max(a, 64) - 64, b - 64))
            keys.append(F.xxhash64(*parts))
        return df.select("hi", "lo", "fingerprint", F.array(*keys).alias("keys")).select("*", F.posexplode("keys").alias("table", "key"))

    a = keyed(asked).select("table", "key", *[F.col(c).alias(f"a_{c}") for c in ("hi", "lo", "keys", "fingerprint")])
    b = keyed(marks)
    apart = F.bit_count(F.col("a_hi").bitwiseXOR(F.col("hi"))) + F.bit_count(F.col("a_lo").bitwiseXOR(F.col("lo")))
    first = F.array_position(F.zip_with("a_keys", "keys", lambda x, y: x == y), True) - 1
    both = a.join(b, ["table", "key"]).where((apart <= radius) & (F.col("a_fingerprint") != F.col("fingerprint")) & (first == F.col("table")))
    return both.select(F.col("a_fingerprint").alias("asked"), "fingerprint", apart.alias("distance"))
