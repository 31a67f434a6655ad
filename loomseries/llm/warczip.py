"""Web archives in ZIP packages: written per task, read by ranges without extraction.

A package is a ZIP file with two stored (not compressed) members: the WARC file,
in which every record is a gzip member of its own, and an index with one line
per record. A reader takes the end of the file, finds the central directory (by
the ZIP64 records where the plain ones are full), takes the place of each
member from its local header, reads the index, and then reads and unpacks just
the bytes of the records it wants.

Records follow WARC 1.1. Pages with equal payloads share a digest: that with
the smallest page_id is a response, the others revisit it and hold no payload.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved, scratch_path

ARCHIVE = "archive/data.warc.gz"
INDEX = "indexes/index.jsonl"
PACKAGE_BYTES = 32 << 20  # a task starts another package from here on, so its memory is bounded
CHUNK_BYTES = 4 << 20  # neighbouring records that one read takes
TAIL_BYTES = 22 + 65535  # the end record and the longest comment
LEVEL = 3
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"  # records carry a fixed date, so that a repeated task writes the same bytes

RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


# --- records ---------------------------------------------------------------------------------------------------------

def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _named(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(name: str) -> int | None:
    number = name.strip("<>").rpartition(":")[2]
    return None if number == "none" else int(number)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, revisits: int | None, level: int = LEVEL) -> bytes:
    """One gzip member: a response with the payload, or a revisit of page ``revisits`` without it."""
    kind = "response" if revisits is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if revisits is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_named(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe=";/?:@&=+$,#!*'()~%[]"))
    if revisits is not None:
        head += [f"WARC-Refers-To: {_named(revisits)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Record(NamedTuple):
    page_id: int | None
    url: str | None
    record_type: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def _fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines.decode().split("\r\n")[1:])}


def parse_record(member: bytes) -> Record:
    """The record in one gzip member. The size and digest of a response are those of the bytes read."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    if not head.startswith(b"WARC/") or len(block) != int(fields["content-length"]):
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    url = fields.get("warc-target-uri")
    if fields["warc-type"] == "response":
        if digest(payload) != stated:
            raise ValueError(f"the payload of {fields['warc-record-id']} has another digest")
        size, refers = len(payload), None
    else:
        size, refers, payload = int(_fields(http)["content-length"]), _page_id(fields["warc-refers-to"]), None
    return Record(_page_id(fields["warc-record-id"]), url, fields["warc-type"], refers, size, stated, payload)


# --- packages --------------------------------------------------------------------------------------------------------

class Package:
    """Collects records and writes them as one ZIP file, under a name that appears when it is whole."""

    def __init__(self, folder: str, name: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.name, self.parts, self.index, self.size = name, [], [], 0

    def add(self, page_id: int | None, record: bytes) -> None:
        self.parts.append(record)
        self.index.append(json.dumps({"page_id": page_id, "offset": self.size, "length": len(record)}))
        self.size += len(record)

    def write(self) -> tuple[str, int, int]:
        """Path, records and bytes of the written package."""
        path = f"{self.folder}/{self.name}.zip"
        part = f"{path}.{uuid.uuid4().hex}.part"
        with self.store.open_output_stream(part) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, parts in ((ARCHIVE, self.parts), (INDEX, [("\n".join(self.index) + "\n").encode()])):
                with z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=self.size >= zipfile.ZIP64_LIMIT) as member:
                    for p in parts:
                        member.write(p)
        size = self.store.get_file_info(part).size
        self.store.move(part, path)  # a repeated task puts the same bytes in place
        return path, len(self.index), size


class Member(NamedTuple):
    name: str
    method: int
    size: int
    stored: int
    header: int  # place of the local header


def _zip64(extra: bytes, values: list[int]) -> list[int]:
    """Values that are full (0xFFFFFFFF), taken from the ZIP64 field in their order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body = extra[at + 4 : at + 4 + n]
            out = []
            for v in values:
                if v == 0xFFFFFFFF:
                    out.append(struct.unpack_from("<Q", body)[0])
                    body = body[8:]
                else:
                    out.append(v)
            return out
        at += 4 + n
    return values


def directory(file) -> dict[str, Member]:
    """The central directory of an open file, which is read from its end."""
    size = file.size()
    start = max(0, size - TAIL_BYTES)
    tail = file.read_at(size - start, start)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of a ZIP file")
    count, length, place = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, place):
        at = start + end - 20
        sign, _, record, _ = struct.unpack("<IIQI", file.read_at(20, at)) if at >= 0 else (0, 0, 0, 0)
        if sign != 0x07064B50:
            raise ValueError("no ZIP64 locator")
        head = file.read_at(56, record)
        if head[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, place = struct.unpack_from("<QQQ", head, 32)
    data, at, out = file.read_at(length, place), 0, {}
    for _ in range(count):
        sign, flags, method, stored, full, n, m, c, header = struct.unpack_from("<I4xHH8xIIHHH8xI", data, at)
        if sign != 0x02014B50:
            raise ValueError("no entry of a ZIP directory")
        name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        full, stored, header = _zip64(data[at + 46 + n : at + 46 + n + m], [full, stored, header])
        out[name] = Member(name, method, full, stored, header)
        at += 46 + n + m + c
    return out


def member_range(file, member: Member) -> tuple[int, int]:
    """Place and size of a stored member's bytes."""
    if member.method != 0 or member.size != member.stored:
        raise ValueError(f"{member.name} is compressed; its records can't be read by ranges")
    head = file.read_at(30, member.header)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name} has no local header")
    n, m = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n + m, member.size


# --- over Spark ------------------------------------------------------------------------------------------------------

def with_roles(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html and refers_to, the page whose payload is the same and whose id is the smallest (NULL: none, or itself)."""
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("sha", F.unhex(F.sha1("html")))
    long_enough = F.octet_length("html") >= min_bytes
    first = keyed.where(long_enough & F.col("page_id").isNotNull()).groupBy("sha").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(first, "sha", "left")
    revisits = long_enough & (F.col("page_id") > F.col("first"))
    return met.select("page_id", "url", "html", F.when(revisits, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html, refers_to) as packages in ``folder``: path, records, bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, made, package = TaskContext.get().partitionId(), 0, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in package.write()], ["path", "records", "bytes"])

        for batch in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package is None:
                    package = Package(folder, f"part-{number:06d}-{made:04d}")
                    package.store.create_dir(package.folder, recursive=True)
                package.add(page_id, record_bytes(page_id, url, html.encode(), refers))
                if package.size >= PACKAGE_BYTES:
                    yield closed()
                    made, package = made + 1, None
        if package is not None:
            yield closed()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long, bytes long")


def _open(store: fs.FileSystem, path: str):
    return store.open_input_file(path)


def index(packages: DataFrame, root: str) -> DataFrame:
    """path, start, lengths: runs of neighbouring records of about ``CHUNK_BYTES``, from the directories and indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(store, path) as file:
                    members = directory(file)
                    base, size = member_range(file, members[ARCHIVE])
                    at, n = member_range(file, members[INDEX])
                    lines = [json.loads(x) for x in file.read_at(n, at).decode().splitlines()]
                starts, lengths, free = [], [], True
                for line in sorted(lines, key=lambda x: x["offset"]):
                    if line["offset"] + line["length"] > size:
                        raise ValueError(f"{path}: the index goes beyond the archive")
                    here = base + line["offset"]
                    if free or here != starts[-1] + sum_ or sum_ >= CHUNK_BYTES:
                        starts.append(here)
                        lengths.append([])
                        free, sum_ = False, 0
                    lengths[-1].append(line["length"])
                    sum_ += line["length"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))],
                    ["path", "start", "lengths"])

    return packages.select("path").mapInArrow(run, "path string, start long, lengths array<long>")


def read(runs: DataFrame, root: str, payload: bool = False) -> DataFrame:
    """The records of ``runs`` (path, start, lengths); ``payload`` is NULL unless asked for, and for revisits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(store, path) as file:
                    data = file.read_at(sum(lengths), start)
                at, found = 0, []
                for n in lengths:
                    record = parse_record(data[at : at + n])
                    found.append(record if payload else record._replace(payload=None))
                    at += n
                columns = list(zip(*found, strict=True))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(Record._fields))

    return runs.select("path", "start", "lengths").mapInArrow(rows, RECORDS)


def archive(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, payload: bool = False) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) to packages in the shared folder, and read them back.

    Returns the records: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload. A NULL html is an empty payload; of pages with
    equal payloads of at least ``min_bytes`` bytes that with the smallest
    page_id is the response. Rows with the same page_id and payload are of one
    kind. A page without an id is a response, and has none when read; a NULL
    url is left out of the record; characters that can't be in a URL are
    percent-encoded. Other columns are not looked at. An empty table writes
    nothing and gives an empty result. The folder must be one that executors
    reach by its URI (a shared file system or an object store).
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    uri = folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    packages = saved(write(with_roles(pages, min_bytes), uri))
    runs = saved(index(packages.repartition(max(1, spark.sparkContext.defaultParallelism)), uri))
    return read(runs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), uri, payload)
