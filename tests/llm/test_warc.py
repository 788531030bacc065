"""Archives: round trips, ZIP64, revisits, broken files."""

import hashlib
import io
import random
import zipfile

import pytest

from siteloom.llm import warc


def archive(rows, zip64):
    sink = io.BytesIO()
    w = warc.ArchiveWriter(sink, zip64)
    for r in rows:
        w.add(*r)
    w.close()
    return sink.getvalue()


ROWS = [(1, "http://a/", b"x" * 2000, None), (2, "http://b/\r\nX: y", "é\r\n\r\nWARC/1.1".encode(), None), (None, None, b"", None), (3, "http://c/", b"x" * 2000, 1)]


@pytest.mark.parametrize("zip64", [True, False])
def test_records_by_range(zip64):
    data = archive(ROWS, zip64)
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    reader = warc.ArchiveReader(io.BytesIO(data), len(data))
    found = list(reader.records())
    assert [(r.page_id, r.payload, r.refers_to, r.record_type) for r in found] == [(1, b"x" * 2000, None, "response"), (2, ROWS[1][2], None, "response"), (None, b"", None, "response"), (3, None, 1, "revisit")]
    assert reader.record(reader.index[3]) == found[3]
    assert found[3].payload_bytes == 2000 and found[3].payload_digest == hashlib.sha1(b"x" * 2000).hexdigest()
    assert found[1].url == "http://b/%0D%0AX: y" and found[2].url is None


def test_directory_with_overflown_fields():
    """A directory whose 32-bit fields are all full, so that the ZIP64 records must be read."""
    import struct

    data = bytearray(archive(ROWS, False))
    plain = warc.read_directory(lambda a, n: bytes(data[a : a + n]), len(data))
    end = data.rfind(b"PK\x05\x06")
    count, size, start = struct.unpack("<HII", data[end + 10 : end + 20])
    body, p = bytearray(), start
    for _ in range(count):
        n, m, k = struct.unpack("<HHH", data[p + 28 : p + 34])
        entry = bytearray(data[p : p + 46 + n])
        packed, whole = struct.unpack("<II", entry[20:28])
        header, = struct.unpack("<I", entry[42:46])
        extra = struct.pack("<HHQQQ", 1, 24, whole, packed, header)
        entry[20:28] = entry[42:46] * 0 + b"\xff" * 8
        entry[42:46] = b"\xff" * 4
        entry[30:34] = struct.pack("<HH", len(extra), 0)
        body += entry + extra
        p += 46 + n + m + k
    record = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(body), start)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, start + len(body), 1)
    tail = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    big = bytes(data[:start]) + bytes(body) + record + locator + tail
    assert warc.read_directory(lambda a, n: big[a : a + n], len(big)) == plain
    assert len(list(warc.ArchiveReader(io.BytesIO(big), len(big)).records())) == 4


def test_broken_files():
    data = archive(ROWS, True)
    with pytest.raises(ValueError, match="central directory"):
        warc.read_directory(lambda a, n: bytes(n), 500)
    raw = warc.record(1, "u", b"payload", None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(raw.replace(b"payload", b"pAyload"))
    assert data


def test_pages(spark):
    rng = random.Random(4)
    big = ["a" * 999, "b" * 1000, "é" * 500, "c" * 3000]
    rows = [(i, f"http://h/{i}", rng.choice([*big, "", None])) for i in range(60)]
    rows += [(100, "u", big[1]), (100, "u", big[1]), (None, None, big[1]), (None, None, "n" * 2000), (None, None, "n" * 2000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    manifest = warc.write_archives(df)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, manifest).collect()), key=str)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == p and j is not None]
        to = max(same) if len(p) >= 1000 and same and i != max(same) else None
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if to is not None else "response", to))
    assert got == sorted(want, key=str)
    assert warc.read_archives(spark, warc.write_archives(df.limit(0))).count() == 0


def package(members, compressed=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data, zipfile.ZIP_DEFLATED if name in compressed else zipfile.ZIP_STORED)
    return out.getvalue()


def test_packages_of_several_members_and_indexes():
    """Two archives with CDXJ lines, one index packed, and a third archive that no index lists."""
    import gzip
    import json

    parts = [[gzip.compress(warc.record(i, f"http://h/{i}", f"page {i}".encode() * 9, None)) for i in some] for some in ((1, 2, 3), (4, 5), (6, 7))]
    info = gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    parts[2].insert(0, info)
    lines = []
    for n, records in enumerate(parts[:2]):
        at = 0
        for r in records:
            lines.append(f"h)/{n} 20240101000000 " + json.dumps({"url": "http://h/{x}", "filename": f"data-{n}.warc.gz", "offset": str(at), "length": str(len(r))}))
            at += len(r)
    members = {f"archive/data-{n}.warc.gz": b"".join(records) for n, records in enumerate(parts)}
    indexes = {"indexes/a.cdxj": ("!meta {}\n" + lines[4] + "\n\n" + lines[0] + "\n").encode(), "indexes/b.cdx.gz": gzip.compress("\n".join(lines[1:4]).encode()), "pages/pages.jsonl": b"not an index", "archive/": b""}
    data = package(members | indexes)
    reader = warc.ArchiveReader(io.BytesIO(data), len(data))
    assert [r.page_id for r in reader.records()] == [1, 2, 3, 4, 5, 6, 7] and len(reader.index) == 5
    assert [reader.record(e).payload for e in reader.index] == [f"page {i}".encode() * 9 for i in (1, 2, 3, 4, 5)]
    read = lambda d: list(warc.ArchiveReader(io.BytesIO(d), len(d)).records())
    for members_, packed, why in (
        (members | {"indexes/c.cdxj": b'k 1 {"filename": "none.warc.gz", "offset": 0, "length": 1}'}, (), "no member"),
        (members, ("archive/data-1.warc.gz",), "not stored"),
        ({"archive/a.warc.gz": parts[0][0][:-9]}, (), "within a record"),
        ({"indexes/a.cdxj": b""}, (), "no member under"),
    ):
        with pytest.raises(ValueError, match=why):
            read(package(members_, packed))


def test_small_pages_do_not_share_a_key(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", "small") for i in range(200)], "page_id long, url string, html string")
    assert warc.with_roles(df).where("refers_to IS NOT NULL").count() == 0
