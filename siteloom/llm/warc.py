"""WARC records in ZIP-packaged archives, read by range without extraction.

An archive is a ZIP whose members are stored, not deflated: ``archive/data.warc.gz``, a
gzip member a record, and ``indexes/index.cdxj``, a line a record with its place in the
first. A reader takes the directory from the end of the file (ZIP64 records where a
field overflows), finds both members in it, and reads the byte range of each record.

Records with equal payloads of at least ``LEAST`` bytes: those of the largest page id
are responses, the others revisits that keep headers only.

Defined cases: a null html counts as empty; repeated rows with the largest page id of
their payload are all responses; a null page id revisits if its payload has a row with
an id and is a response if not; line breaks in a URL are percent-encoded and a null URL
has no header; an empty table gives no archives and no records; columns beyond the named
ones are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import materialize, new_path, partitions, until_exit
from siteloom.llm.files import attempt_name, opened

#: Least payload that a revisit may stand for.
LEAST = 1000
#: Member names and the profile of a revisit.
ARCHIVES, INDEXES = "archive/", "indexes/"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"
_READ = 8 << 20


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """``(id, url, payload, refers_to)``: ``refers_to`` is null for responses.

    Only payloads that occur more than once are joined, one row each; the rows of a
    frequent payload may sit in one partition of the join, which Spark splits. Rows without a
    digest get a key of their own each, so the many small pages do not meet in one task.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha1("payload")))
    heads = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.max("id").alias("head"), F.count("*").alias("n")).where("n > 1 AND head IS NOT NULL")
    apart = F.coalesce("digest", F.concat(F.lit("-"), F.xxhash64("id", "url", "payload").cast("string")))  # no digest has a dash
    joined = rows.withColumn("digest", apart).join(heads.select("digest", "head"), "digest", "left")
    return joined.select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to"))


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC 1.1 record, a response or a revisit, with its HTTP headers."""
    digest = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = "".join(c if c > "\x1f" and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    head.append("WARC-Payload-Digest: sha1:" + b32encode(digest).decode())
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class Parsed(NamedTuple):
    page_id: int | None
    url: str | None
    payload: bytes | None
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None


def parse_record(raw: bytes) -> Parsed:
    """A record of :func:`record`; a response is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError("the payload does not match its digest")
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    to = fields.get("WARC-Refers-To")
    return Parsed(number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), payload if kind == "response" else None, length, digest, kind, number(to) if to else None)


class ArchiveWriter:
    """Streams records into the stored data member; the index follows when it closes."""

    def __init__(self, sink, zip64: bool = True) -> None:
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.zip64 = zip64
        self.data = self.zip.open(self._member(DATA), "w", force_zip64=zip64)
        self.index, self.at = io.StringIO(), 0

    def _member(self, name: str) -> zipfile.ZipInfo:
        return zipfile.ZipInfo(name)  # a fixed time: equal rows make equal archives

    def add(self, key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        packed = gzip.compress(record(key, url, payload, refers_to), 6, mtime=0)
        self.data.write(packed)
        line = json.dumps({"page": key, "filename": DATA.removeprefix(ARCHIVES), "offset": str(self.at), "length": str(len(packed))})
        self.index.write(f"{quote(url or '-', safe=':/?&=')} {re.sub('[^0-9]', '', DATE)} {line}\n")
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(self._member(INDEX), "w", force_zip64=self.zip64) as f:
            f.write(self.index.getvalue().encode())
        self.zip.close()


class Member(NamedTuple):
    method: int
    size: int
    header: int  # offset of the local header


def read_directory(read, size: int) -> dict[str, Member]:
    """Members by name, from the end of a ZIP of ``size`` bytes; ``read(offset, length)``."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    where = tail_at + at - 20
    if where >= 0:
        locator = read(where, 20)
        if locator[:4] == b"PK\x06\x07":  # ZIP64: any of the fields may be in the larger record
            end = read(struct.unpack("<Q", locator[8:16])[0], 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory where its locator points")
            count, length, start = struct.unpack("<QQQ", end[32:56])
    raw, members, p = read(start, length), {}, 0
    for _ in range(count):
        if raw[p : p + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        method, = struct.unpack("<H", raw[p + 10 : p + 12])
        packed, plain, n, m, k = struct.unpack("<IIHHH", raw[p + 20 : p + 34])
        header, = struct.unpack("<I", raw[p + 42 : p + 46])
        name = raw[p + 46 : p + 46 + n].decode()
        extra, q = raw[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            tag, part = struct.unpack("<HH", extra[q : q + 4])
            if tag == 1:  # the overflown fields, in this order
                wide = iter(struct.unpack(f"<{part // 8}Q", extra[q + 4 : q + 4 + part // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            q += 4 + part
        members[name] = Member(method, packed, header)
        p += 46 + n + m + k
    return members


class ArchiveReader:
    """Records of a package by byte range through a seekable stream.

    Every member under ``archive/`` is read, and every index under ``indexes/``. An index
    line is JSON with ``offset`` and ``length``, after a key and a time as in CDXJ or alone,
    and names its member as ``filename``, unless there is one only. Members that no index
    lists are walked record by record. A member that is compressed once more, a line that
    points to none, and one that is no record's are errors.
    """

    def __init__(self, source, size: int) -> None:
        self.source = source
        self.members = read_directory(self.read, size)
        self.data = {name: self._stored(name) for name in sorted(self.members) if name.startswith(ARCHIVES) and not name.endswith("/")}
        if not self.data:
            raise ValueError(f"no member under {ARCHIVES}")
        self.index = sorted((e for name in sorted(self.members) if name.startswith(INDEXES) and not name.endswith("/") for e in self._lines(name)), key=lambda e: (e["member"], e["offset"]))
        listed = {e["member"] for e in self.index}
        self.walked = [name for name in self.data if name not in listed]

    def read(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def _stored(self, name: str) -> tuple[int, int]:
        """Offset and length of a member's bytes."""
        found = self.members[name]
        if found.method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is not stored")
        local = self.read(found.header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        return found.header + 30 + sum(struct.unpack("<HH", local[26:30])), found.size

    def _lines(self, name: str) -> Iterator[dict]:
        """Entries of an index: where a record is, and what else its line says."""
        raw = self.read(*self._stored(name))
        for line in (gzip.decompress(raw) if name.endswith(".gz") else raw).decode().splitlines():
            if not line.strip() or line.startswith("!"):  # a header line
                continue
            entry = json.loads(line if line.startswith("{") else line.split(" ", 2)[2])
            member = ARCHIVES + entry["filename"].removeprefix(ARCHIVES) if "filename" in entry else next(iter(self.data)) if len(self.data) == 1 else None
            if member not in self.data:
                raise ValueError(f"a line of {name} points to no member: {line[:200]}")
            yield entry | {"member": member, "offset": int(entry["offset"]), "length": int(entry["length"])}

    def record(self, entry: dict) -> Parsed:
        return parse_record(gzip.decompress(self.read(self.data[entry["member"]][0] + entry["offset"], entry["length"])))

    def records(self) -> Iterator[Parsed]:
        """All responses and revisits, listed ones first, in order; neighbouring ranges share reads of a few MB."""
        at = 0
        while at < len(self.index):
            member, begin, stop, end = self.index[at]["member"], self.index[at]["offset"], at, 0
            while stop < len(self.index) and self.index[stop]["member"] == member and (stop == at or end - begin < _READ):
                end = max(end, self.index[stop]["offset"] + self.index[stop]["length"])
                stop += 1
            data = self.read(self.data[member][0] + begin, end - begin)
            for x in self.index[at:stop]:
                yield parse_record(gzip.decompress(data[x["offset"] - begin : x["offset"] - begin + x["length"]]))
            at = stop
        for member in self.walked:
            yield from (parse_record(raw) for raw in self._walk(member) if _kind(raw) in ("response", "revisit"))

    def _walk(self, member: str) -> Iterator[bytes]:
        """The records of a member that are gzip members of their own, one after the other."""
        start, size = self.data[member]
        at, tool, out = 0, zlib.decompressobj(31), []
        while at < size:
            data = self.read(start + at, min(_READ, size - at))
            at += len(data)
            while data:
                out.append(tool.decompress(data))
                data = tool.unused_data
                if tool.eof:
                    yield b"".join(out)
                    tool, out = zlib.decompressobj(31), []
        if out:
            raise ValueError(f"{member} ends within a record")


def _kind(raw: bytes) -> str:
    """A record's type, by its head."""
    found = re.search(rb"^WARC-Type:[ \t]*(\S+)", raw.partition(b"\r\n\r\n")[0], re.M | re.I)
    return found[1].decode() if found else ""


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write every row as a record; returns the manifest ``(part, path, size, records)`` of finished archives."""
    own, folder = folder is None, folder or new_path(pages.sparkSession, "archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = sink = None
        n, part = 0, TaskContext.get().partitionId()
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is None:
                    path = attempt_name(folder, part, ".zip")
                    store, where = opened(path)
                    sink = store.open_output_stream(where, compression=None)
                    writer = ArchiveWriter(sink)
                writer.add(*row)
                n += 1
        if writer is not None:
            writer.close()
            size = sink.tell()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "size": [size], "records": [n]}, pa.schema([("part", pa.int32()), ("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))

    manifest = materialize(with_roles(pages, id_col, url_col, html_col, least).mapInArrow(run, "part int, path string, size long, records long"), "manifest")
    if own:
        until_exit(pages.sparkSession, folder)
    return manifest


_RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, manifest: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Every record of the archives of a manifest; revisits have no payload of their own."""
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, where = opened(path)
                rows: list[Parsed] = []
                for x in ArchiveReader(store.open_input_file(where), size).records():
                    rows.append(x if keep_payload else x._replace(payload=None))
                    if len(rows) == 1000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows: list[Parsed]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(Parsed._fields))

    n = max(1, min(partitions(spark), manifest.count()))
    return manifest.select("path", "size").repartition(n).mapInArrow(run, _RECORD)
