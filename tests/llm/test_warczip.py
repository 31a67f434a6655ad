import base64
import gzip
import hashlib
import io
import re
import zipfile
from collections import defaultdict

import pyarrow as pa
import pytest
from pyarrow import fs

from loomseries.llm import warczip

PAGES = "page_id long, url string, html string, sha string, refers_to string, n int"


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(pages, least=0):
    groups = defaultdict(list)
    for page_id, _, html in pages:
        if page_id is not None:
            groups[(html or "").encode()].append(page_id)
    out = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        first = min(groups[data], default=None)
        again = page_id is not None and len(data) >= least and page_id > first
        out.append((page_id is None, page_id or 0, len(data), b32(data), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def frame(spark, pages):
    return spark.createDataFrame([(*p, "s", "r", 0) for p in pages], PAGES)


def some_pages():
    pages = [(i, f"http://example.org/{i % 50}", f"<html>{i % 40}\r\n\r\n{'x' * (i % 300)}</html>") for i in range(400)]
    pages += [(1000 + i, "http://a/ü ?q=1", "<p>same</p>") for i in range(90)]
    pages += [(2000, None, None), (2001, "", ""), (2002, "x\r\nWARC-Type: resource", "é" * 100_000), (None, "u", "<p>same</p>"), (5, "again", "<html>5\r\n\r\nxxxxx</html>")]
    return pages


@pytest.mark.parametrize("least", [0, 12])
def test_archive_round_trip(spark, monkeypatch, least):
    pages = some_pages()
    assert rows(warczip.archive(frame(spark, pages), least)) == brute(pages, least)


def test_payloads_come_back(spark):
    pages = some_pages()
    out = warczip.archive(frame(spark, pages).repartition(5), payload=True).collect()
    text = {p[0]: (p[2] or "").encode() for p in pages if p[0] not in (None, 5)}
    for r in out:
        if r.page_id in text:
            assert bytes(r.payload) == text[r.page_id] if r.record_type == "response" else r.payload is None
    urls = {r.page_id: r.url for r in out}
    assert urls[2000] is None and urls[1000] == "http://a/%C3%BC%20?q=1" and urls[2002] == "x%0D%0AWARC-Type:%20resource"


def test_nothing_to_write(spark):
    assert warczip.archive(frame(spark, [])).count() == 0


@pytest.fixture
def package(tmp_path):
    def make(n=50, name="p"):
        p = warczip.Package(f"file://{tmp_path}", name)
        for i in range(n):
            p.add(i, warczip.record_bytes(i, f"http://e/{i}", f"page {i}".encode() * 20, i - 1 if i % 5 == 4 else None))
        return p.write()

    return make


def open_file(path):
    return fs.LocalFileSystem().open_input_file(path)


def check(path, n=50, others=True):
    with open_file(path) as file:
        members = warczip.directory(file)
        assert set(members) == {warczip.ARCHIVE, warczip.INDEX}
        at, size = warczip.member_range(file, members[warczip.ARCHIVE])
        data = file.read_at(size, at)
    # Another reader of ZIP and gzip sees the same.
    if others:
        with zipfile.ZipFile(path) as z:
            assert z.read(warczip.ARCHIVE) == data and z.testzip() is None
    whole = gzip.decompress(data).decode()
    assert len(re.findall(r"^WARC/1\.1\r$", whole, re.M)) == n


def test_other_readers_agree(package):
    path, n, size = package()
    assert n == 50 and size == fs.LocalFileSystem().get_file_info(path).size
    check(path)


def test_zip64_directories(package, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path, _, _ = package(name="z64")
    data = open(path, "rb").read()
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    check(path)


def test_comments(package):
    path, _, _ = package(name="c")
    with zipfile.ZipFile(path, "a") as z:
        z.comment = b"a comment" * 100
    check(path)
    with zipfile.ZipFile(path, "a") as z:
        z.comment = b"a comment with PK\x05\x06 inside" * 100  # which the other reader takes for the end record
    check(path, others=False)


def test_zip64_values_by_hand():
    """A directory entry whose size, stored size and place are all in the ZIP64 field, and a 64-bit end record."""
    import struct

    name, body = b"archive/data.warc.gz", b"abcdef"
    local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, 6, 6) + body
    extra = struct.pack("<HHH", 0x5455, 2, 7) + struct.pack("<HHQQQ", 1, 24, 6, 6, 0)
    entry = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    place = len(local)
    end64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, 1, 1, len(entry), place)
    locator = struct.pack("<IIQI", 0x07064B50, 0, place + len(entry), 1)
    end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    file = pa.BufferReader(local + entry + end64 + locator + end)
    members = warczip.directory(file)
    at, n = warczip.member_range(file, members["archive/data.warc.gz"])
    assert file.read_at(n, at) == body


@pytest.mark.parametrize("data", [b"", b"PK", b"x" * 100, b"PK\x05\x06" + b"\xff" * 18])
def test_broken_packages_are_refused(data):
    with pytest.raises(ValueError):
        warczip.directory(pa.BufferReader(data))


def test_compressed_members_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warczip.ARCHIVE, b"a" * 1000)
    file = pa.BufferReader(out.getvalue())
    with pytest.raises(ValueError):
        warczip.member_range(file, warczip.directory(file)[warczip.ARCHIVE])


def test_several_packages_and_runs(spark, monkeypatch):
    monkeypatch.setattr(warczip, "PACKAGE_BYTES", 3000)
    monkeypatch.setattr(warczip, "CHUNK_BYTES", 700)
    pages = some_pages()
    assert rows(warczip.archive(frame(spark, pages).coalesce(2))) == brute(pages)


def test_damaged_records_are_refused():
    good = warczip.record_bytes(1, "u", b"payload", None)
    assert warczip.parse_record(good).payload == b"payload"
    other = gzip.compress(gzip.decompress(good).replace(b"payload\r\n", b"paylood\r\n"))
    with pytest.raises(ValueError):
        warczip.parse_record(other)
