"""WARC records in ZIP packages: written by tasks, read back by ranges.

A package is a ZIP with stored (not compressed) members: ``archive/data.warc.gz``, one gzip member per record;
``indexes/index.cdxj``, a line per record with its offset and length in that file; ``datapackage.json`` with both
members' sizes and digests.

Writing: records with equal payloads are found by SHA-1 first, as rows of ids; the payloads themselves meet only the table of repeated digests. That is a
broadcast while Spark finds the table's file small enough, else a join whose skewed partitions Spark splits. A task streams its rows into packages of
about ``most`` bytes each. A package has a name of its own and counts only if its task ends, so that repeated tasks leave no row twice.

Reading never extracts: a task reads a package's end, its central directory (ZIP64 or not) and the headers of the members it
is after; index members are read in ranges of ``INDEX_BYTES``, lines that lie across borders included; records are read by
the offsets of the index, neighbours in one range of about ``READ_BYTES``, by as many tasks as there are ranges. A WARC member that no
index line names is walked from its start by one task for its offsets, as gzip has no marks to start from within.

Files are opened by pyarrow's file systems (local, HDFS, S3, GCS), as Spark gives no ranges of binary files.

Defined results: a null html is an empty payload; equal payloads (empty ones too, unless ``least`` is above 0) are one response, of the largest
page_id, and revisits of it; rows that share the largest page_id are all responses; a null page_id revisits any other row with its
payload, and is a response where there is none; a null url leaves its field out, white space and control characters in it
are percent-encoded; very long payloads are written and read whole, each in one task; an empty table gives no package and no rows; other columns are ignored.
A package that is no ZIP, or holds a WARC member that is encrypted or not stored, is an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, scratch, spread

WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES, READ_BYTES, INDEX_BYTES, BATCH_BYTES = 1 << 30, 8 << 20, 32 << 20, 4 << 20
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
PACKAGES = "path string, records bigint, bytes bigint"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?!/)", "file:///", path)))


# Records


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": str(len(block))}).items() if v is not None)
    return b"".join([b"WARC/1.1\r\n", head.encode(), b"\r\n", block, b"\r\n\r\n"])


def page_record(name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit of ``refers_to`` with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{name}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Refers-To": None if refers_to is None else f"<{refers_to}>",
        "WARC-Profile": None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response",
    }
    return record(fields, head + payload if refers_to is None else head)


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line is not one."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def parsed(raw: bytes) -> dict:
    """A record's type, target, names, digest as it says, payload, size of the payload (a revisit's is what its HTTP head says)."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not raw.startswith(b"WARC/") or not found:
        raise ValueError("no WARC record starts here")
    field = _fields(head)
    block = rest[: int(field["content-length"])]
    if len(block) < int(field["content-length"]):
        raise ValueError("a WARC record ends too early")
    payload, size = block, len(block)
    if field.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        if field["warc-type"] == "revisit":
            size = int(_fields(http).get("content-length", size))
    name = lambda k: field[k].strip("<>") if k in field else None
    return {"record_type": field["warc-type"], "url": field.get("warc-target-uri"), "record_id": name("warc-record-id"), "refers_to": name("warc-refers-to"), "digest": field.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload": payload, "payload_bytes": size}


# Packages


class Package:
    """A package that is being written; ``add`` takes records, ``close`` writes index and datapackage."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        where, at = opened(self.path)
        self.file = where.open_output_stream(at)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(WARC, "w", force_zip64=True)
        self.size, self.lines, self.sha = 0, [], hashlib.sha256()

    def add(self, raw: bytes, about: dict, level: int) -> None:
        pressed = zlib.compressobj(level, zlib.DEFLATED, 31)
        data = pressed.compress(raw) + pressed.flush()
        self.member.write(data)
        self.sha.update(data)
        self.lines.append(json.dumps(about | {"filename": WARC, "offset": self.size, "length": len(data)}))
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        index = "".join(line + "\n" for line in self.lines).encode()
        parts = [(WARC, self.size, self.sha), (INDEX, len(index), hashlib.sha256(index))]
        with self.zip.open(INDEX, "w", force_zip64=True) as out:
            out.write(index)
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"name": p.rpartition("/")[2], "path": p, "bytes": n, "hash": f"sha256:{h.hexdigest()}"} for p, n, h in parts]}))
        self.zip.close()
        self.file.close()
        return self.path, len(self.lines), self.size


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, digest, refers_to: the page that a row of at least ``least`` bytes repeats, else null."""
    known = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    several = materialize(known.where(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("_n")).where("_n > 1 and response is not null").drop("_n"))
    repeats = (F.length("payload") >= least) & (F.col("page_id").isNull() | (F.col("page_id") < F.col("response")))
    return known.join(several, "digest", "left").select("page_id", "url", "payload", "digest", F.when(repeats, F.col("response")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, *, least: int = 0, most: int = PACKAGE_BYTES, level: int = 1, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """path, records, bytes of the packages written to folder. pages: page_id, url, html; the record of page 7 is ``urn:page:7``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                page, url, payload, digest, refers_to = (c[row].as_py() for c in batch.columns)
                package = package or Package(folder)
                name = f"urn:page:{page}" if page is not None else f"urn:uuid:{uuid.uuid4()}"
                digest = base32(digest)
                package.add(page_record(name, url, payload, digest, None if refers_to is None else f"urn:page:{refers_to}", date), {"url": url, "digest": f"sha1:{digest}"}, level)
                if package.size >= most:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [c.split()[0] for c in PACKAGES.split(", ")])

    return materialize(with_revisits(pages, least).mapInArrow(run, PACKAGES))


# Directories of ZIP files

_EOCD, _EOCD64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def _range(file: pa.NativeFile, start: int, size: int) -> bytes:
    file.seek(start)
    data = file.read(size)
    if len(data) < size:
        raise ValueError("the file ends too early")
    return data


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offsets, those that are all ones replaced by the ZIP64 field's values, which follow in this order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(wide) if v == 0xFFFFFFFF else v for v in values]
        at += 4 + size
    return values


def directory(file: pa.NativeFile) -> list[tuple[str, int, int, int, int]]:
    """(name, flags, method, stored size, offset of the local header) of every member, from the central directory alone."""
    size = file.size()
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = _range(file, tail_at, size - tail_at)
    end = tail.rfind(_EOCD)
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(_EOCD, 0, end)
    if end < 0:
        raise ValueError("no end of a central directory: not a ZIP file, or cut short")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    stop = tail_at + end
    if n == 0xFFFF or 0xFFFFFFFF in (length, start):
        locator = _range(file, stop - 20, 20)
        if locator.startswith(_LOCATOR):
            said = struct.unpack_from("<Q", locator, 8)[0]
            stop = said if _range(file, said, 4) == _EOCD64 else tail_at + tail.rfind(_EOCD64, 0, end)
            n, length, start = struct.unpack_from("<QQQ", _range(file, stop, 56), 32)
    shift = stop - length - start  # of bytes before the ZIP file proper
    data, at, out = _range(file, start + shift, length), 0, []
    for _ in range(n):
        if data[at : at + 4] != _CENTRAL:
            raise ValueError("an entry of the central directory is damaged")
        flags, method, _, _, _, stored, full, names, extras, notes = struct.unpack_from("<HHHHIIIHHH", data, at + 8)
        offset = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        full, stored, offset = _wide(data[at + 46 + names : at + 46 + names + extras], [full, stored, offset])
        out.append((name, flags, method, stored, offset + shift))
        at += 46 + names + extras + notes
    return out


MEMBERS = "path string, name string, kind string, start bigint, size bigint"


def members(packages: DataFrame) -> DataFrame:
    """The WARC and index members of packages (column path): where their bytes lie in the file."""

    def kind(name: str) -> str | None:
        low = name.lower()
        if low.startswith("archive/") and low.endswith((".warc", ".warc.gz")):
            return "warc"
        return "index" if low.startswith("indexes/") and low.endswith((".cdx", ".cdxj")) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, at = opened(path)
                rows = []
                with where.open_input_file(at) as file:
                    for name, flags, method, size, offset in directory(file):
                        if (what := kind(name)) is None:
                            continue
                        if flags & 1 or method:
                            raise ValueError(f"{name} in {path} is {'encrypted' if flags & 1 else 'compressed'}: it can't be read by ranges")
                        head = _range(file, offset, 30)
                        if not head.startswith(_LOCAL):
                            raise ValueError(f"no member starts at {offset} in {path}")
                        rows.append((path, name, what, offset + 30 + sum(struct.unpack_from("<HH", head, 26)), size))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate([pa.string()] * 3 + [pa.int64()] * 2)], [c.split()[0] for c in MEMBERS.split(", ")])

    return packages.select("path").mapInArrow(run, MEMBERS)


def _lines(file: pa.NativeFile, start: int, size: int, low: int, high: int) -> Iterator[bytes]:
    """The lines of a member that start within its bytes low to high - 1."""
    at = max(0, low - 1)
    data = _range(file, start + at, min(high, size) - at)
    while not data.endswith(b"\n") and at + len(data) < size:
        data += _range(file, start + at + len(data), min(1 << 16, size - at - len(data)))
        if (cut := data.find(b"\n", high - at - 1)) >= 0:
            data = data[: cut + 1]
    if low:
        data = data[data.find(b"\n") + 1 :] if b"\n" in data[: high - at - 1] else b""
    yield from data.splitlines()


ENTRIES = "path string, name string, offset bigint, length bigint"


def index_entries(found: DataFrame, step: int = INDEX_BYTES) -> DataFrame:
    """path, name (of a WARC member), offset, length of every record that the index members list; found: members."""
    ranges = found.where("kind = 'index' and size > 0").select("path", "start", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(step))).alias("low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                where, at = opened(r["path"])
                with where.open_input_file(at) as file:
                    rows = [json.loads(line[line.index(b"{") :]) for line in _lines(file, r["start"], r["size"], r["low"], r["low"] + step) if b"{" in line]
                names = [x["filename"] if "/" in x["filename"] else f"archive/{x['filename']}" for x in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(rows), pa.string()), pa.array(names, pa.string()), *[pa.array([int(x[k]) for x in rows], pa.int64()) for k in ("offset", "length")]], [c.split()[0] for c in ENTRIES.split(", ")])

    return ranges.repartition("path", "low").mapInArrow(run, ENTRIES)


def _walked(file: pa.NativeFile, start: int, size: int, pressed: bool) -> Iterator[tuple[int, int]]:
    """(offset, length) of each record of a member, from its start."""
    at = 0
    while at < size:
        if pressed:
            one, fed = zlib.decompressobj(31), 0
            while not one.eof:
                if not (data := _range(file, start + at + fed, min(READ_BYTES, size - at - fed))):
                    raise ValueError("a WARC record ends too early")
                rest = data
                while rest and not one.eof:
                    one.decompress(rest, READ_BYTES)
                    rest = one.unconsumed_tail
                fed += len(data) - len(one.unused_data)
            length = fed
        else:
            head = b""
            while b"\r\n\r\n" not in head:
                if not (more := _range(file, start + at + len(head), min(1 << 16, size - at - len(head)))):
                    raise ValueError("a WARC record ends too early")
                head += more
            head = head[: head.index(b"\r\n\r\n")]
            length = len(head) + 4 + int(_fields(head)["content-length"]) + 4
        yield at, length
        at += length


def walked_entries(unlisted: DataFrame) -> DataFrame:
    """path, name, offset, length of every record of WARC members without an index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                where, at = opened(r["path"])
                with where.open_input_file(at) as file:
                    rows = list(_walked(file, r["start"], r["size"], r["name"].lower().endswith(".gz")))
                yield pa.RecordBatch.from_arrays([*[pa.array([r[k]] * len(rows), pa.string()) for k in ("path", "name")], *[pa.array([x[k] for x in rows], pa.int64()) for k in (0, 1)]], [c.split()[0] for c in ENTRIES.split(", ")])

    return unlisted.select("path", "name", "start", "size").repartition("path", "name").mapInArrow(run, ENTRIES)


RECORDS = "path string, name string, offset bigint, record_type string, url string, record_id string, refers_to string, payload_bytes bigint, payload_digest string, intact boolean, payload binary"


def read_records(packages: DataFrame, payload: bool = True) -> DataFrame:
    """The records of packages (column path). Without ``payload``, that column is null.

    A response's size and digest are those of the payload read; ``intact`` says whether the record's own digest is the same. A
    revisit's are what it says of the payload it leaves out.
    """
    found = materialize(members(packages))
    listed = materialize(index_entries(found))
    warcs = found.where("kind = 'warc'")
    entries = listed.unionByName(walked_entries(warcs.join(listed.select("path", "name").distinct(), ["path", "name"], "left_anti")))
    placed = entries.join(warcs.select("path", "name", "start"), ["path", "name"]).withColumn("chunk", F.floor(F.col("offset") / READ_BYTES))
    kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        file, path = None, None
        data, low = b"", 0
        for batch in batches:
            todo = batch.to_pylist()
            for k, r in enumerate(todo):
                if r["path"] != path:
                    where, at = opened(r["path"])
                    file, path, data, low = where.open_input_file(at), r["path"], b"", 0
                first = r["start"] + r["offset"]
                if not low <= first <= first + r["length"] <= low + len(data):
                    high = first + r["length"]
                    for x in todo[k + 1 :]:  # neighbours in the file are read with it
                        if x["path"] != path or x["start"] + x["offset"] != high or high + x["length"] - first > READ_BYTES:
                            break
                        high += x["length"]
                    low, data = first, _range(file, first, high - first)
                raw = data[first - low : first - low + r["length"]]
                one = parsed(zlib.decompress(raw, 31) if r["name"].lower().endswith(".gz") else raw)
                whole = one["record_type"] != "revisit"
                digest = base32(hashlib.sha1(one["payload"]).digest()) if whole else one["digest"]
                rows.append((path, r["name"], r["offset"], one["record_type"], one["url"], one["record_id"], one["refers_to"], one["payload_bytes"], digest, not whole or one["digest"] in (None, digest), one["payload"] if payload else None))
                held += 256 + (len(one["payload"]) if payload else 0)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    sort = ["path", "name", "offset"]
    return placed.repartition("path", "name", "chunk").sortWithinPartitions(*sort).select("path", "name", "start", "offset", "length").mapInArrow(run, RECORDS)


def op12_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record into ZIP packages, and what reading these back gives."""
    packages = write_packages(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")), scratch(spark))
    number = lambda c: F.when(F.col(c).startswith("urn:page:"), F.substring(c, 10, 20).cast("bigint"))
    return read_records(packages, payload=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "intact")
