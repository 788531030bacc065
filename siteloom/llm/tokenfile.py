"""Token ids in seekable zstandard files.

A file is a row of independent frames, one a document in ascending id, then one frame
with the index, then the seek table in a skippable frame: for each frame the compressed
size, the plain size and the low 32 bits of the XXH64 of its plain bytes. Any zstandard
tool reads the frames in order; a reader that has the table fetches and decompresses
only the documents asked for. Ids are little-endian, 16 bits wide if the vocabulary
fits, else 32; the index holds that width and the 64-bit document ids.

Defined cases: a null text counts as empty and still has its end id; repeated rows are
frames of their own, ties ordered by text; null ids come first; an empty table gives no
documents; columns beyond the named ones are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import cut_points, materialize, new_path, partitions, range_bucket, until_exit
from siteloom.llm.files import attempt_name, opened
from siteloom.llm.tokens import encoder

#: Fixed values of the seekable format: magic of its skippable frame, of its footer, flag for checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
END = 0
_NULL = -(1 << 63)
_READ = 8 << 20


class Writer:
    """Frames to a binary stream; ``close`` writes index and seek table."""

    def __init__(self, sink, wide: bool, level: int = 3) -> None:
        self.sink, self.kind = sink, np.dtype("<u4" if wide else "<u2")
        self.tool = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.table: list[bytes] = []
        self.ids: list[int] = []
        self.tokens = self.size = 0

    def _frame(self, plain: bytes) -> None:
        packed = self.tool.compress(plain)
        self.sink.write(packed)
        self.size += len(packed)
        self.table.append(struct.pack("<III", len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._frame(ids.astype(self.kind).tobytes())
        self.ids.append(_NULL if doc_id is None else doc_id)
        self.tokens += len(ids)

    def close(self) -> None:
        self._frame(bytes([self.kind.itemsize]) + np.array(self.ids, "<i8").tobytes())
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.size += 8 + len(body)


class Reader:
    """Random access to a file of :class:`Writer` through a seekable binary stream."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        head = size - 9 - 12 * count - 8
        kind, _ = struct.unpack("<II", self._at(head, 8))
        if kind != SKIPPABLE:
            raise ValueError("the seek table is not in a skippable frame")
        self.table = np.frombuffer(self._at(head + 8, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.begin = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        self.tool = zstandard.ZstdDecompressor()
        index = self._plain(count - 1, self._at(int(self.begin[-1]), int(self.table[-1, 0])))
        self.kind = np.dtype(f"<u{index[0]}")
        self.ids = np.frombuffer(index, "<i8", offset=1)
        self.lengths = self.table[:-1, 1] // self.kind.itemsize

    def _at(self, where: int, size: int) -> bytes:
        self.source.seek(where)
        return self.source.read(size)

    def _plain(self, frame: int, packed: bytes) -> bytes:
        plain = self.tool.decompress(packed)
        if len(plain) != self.table[frame, 1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table[frame, 2]:
            raise ValueError(f"frame {frame} does not match its checksum")
        return plain

    def document(self, number: int) -> np.ndarray:
        """Ids of one document, reading and decompressing its frame alone."""
        packed = self._at(int(self.begin[number]), int(self.table[number, 0]))
        return np.frombuffer(self._plain(number, packed), self.kind)

    def documents(self) -> Iterator[np.ndarray]:
        """Ids of all documents in order; neighbouring frames share reads of a few MB."""
        at, n = 0, len(self.ids)
        while at < n:
            stop = max(at + 1, int(np.searchsorted(self.begin, self.begin[at] + _READ)))
            stop = min(stop, n)
            end = int(self.begin[stop - 1] + self.table[stop - 1, 0])
            data = self._at(int(self.begin[at]), end - int(self.begin[at]))
            for k in range(at, stop):
                a = int(self.begin[k] - self.begin[at])
                yield np.frombuffer(self._plain(k, data[a : a + int(self.table[k, 0])]), self.kind)
            at = stop


def write_token_files(df: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Encode every text and write files in ascending id; returns the manifest ``(part, path, size, documents, tokens)``.

    Only files of attempts that succeeded are in the manifest, so tasks may be retried.
    """
    spark = df.sparkSession
    own, folder = folder is None, folder or new_path(spark, "tokens")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cuts = cut_points(rows, "id", partitions(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        wide = tool.tokenizer.get_vocab_size() > 1 << 16 or end >= 1 << 16
        writer = sink = None
        part = TaskContext.get().partitionId()
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                some = b.slice(at, 2000)
                if writer is None:
                    path = attempt_name(folder, part, ".ids.zst")
                    store, where = opened(path)
                    sink = store.open_output_stream(where, compression=None)
                    writer = Writer(sink, wide)
                for key, ids in zip(some.column(0).to_pylist(), tool.encode(some.column(1).to_pylist()), strict=True):
                    writer.add(key, np.append(ids, np.uint32(end)))
        if writer is not None:
            writer.close()
            sink.close()
            row = {"part": [part], "path": [path], "size": [writer.size], "documents": [len(writer.ids)], "tokens": [writer.tokens]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("path", pa.string()), ("size", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    dealt = rows.repartitionById(len(cuts) + 1, range_bucket("id", cuts)).sortWithinPartitions(F.asc_nulls_first("id"), "text")
    manifest = materialize(dealt.mapInArrow(run, "part int, path string, size long, documents long, tokens long"), "manifest")
    if own:
        until_exit(spark, folder)
    return manifest


def read_token_files(spark: SparkSession, manifest: DataFrame, keep_ids: bool = True) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32[, ids])`` of every document, from the files alone.

    ``start`` counts the ids of all documents before it, over all files; for that the
    driver adds up one number a file, from their seek tables.
    """
    kinds = [("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())][: 4 + keep_ids]

    def open_reader(path: str, size: int) -> Reader:
        store, where = opened(path)
        return Reader(store.open_input_file(where), size)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [int(open_reader(p, s).lengths.sum()) for p, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums, pa.int64())], names=["part", "path", "size", "tokens"])

    listed = manifest.select("part", "path", "size")
    files = sorted(map(tuple, listed.mapInArrow(totals, "part int, path string, size long, tokens long").collect()))
    starts, at = [], 0
    for _, path, size, tokens in files:
        starts.append((path, size, at))
        at += tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                reader = open_reader(path, size)
                rows: list[tuple] = []
                for key, ids in zip(reader.ids.tolist(), reader.documents(), strict=True):
                    raw = ids.astype("<u4").tobytes()
                    rows.append((None if key == _NULL else key, start, len(ids), zlib.crc32(raw), raw))
                    start += len(ids)
                    if len(rows) == 2000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=False)], names=[n for n, _ in kinds])

    spread = spark.createDataFrame(starts, "path string, size long, start long").repartitionById(max(1, len(starts)), F.pmod(F.xxhash64("path"), F.lit(max(1, len(starts)))).cast("int"))
    return spread.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
