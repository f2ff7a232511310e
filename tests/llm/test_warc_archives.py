import base64
import gzip
import hashlib
import io
import struct
import zipfile
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import warc_archives as wa

PAGES = "page_id long, url string, html string"


def by_hand(rows):
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        refers = last.get(html or "")
        refers = None if refers == i else refers
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if refers is None else "revisit", refers, True))
    return Counter(out)


ROWS = [(i, f"http://h/{i}", f"<p>{i % 40} é</p>" * (i % 5)) for i in range(200)] + [(300, None, None), (301, "http://x/a b\r\nX: y", ""), (302, "u", "L" * 3_000_000), (303, "", "\x00\r\n\r\nWARC/1.1"), (None, "n", "<p>3 é</p>" * 3), (None, "n", "alone"), (None, None, "alone"), (5, "again", "<p>5 é</p>"), (303, "u", "\x00\r\n\r\nWARC/1.1"), (-4, "m", "minus")]


def test_query(spark, tmp_path):
    spark.createDataFrame([(*r, b"x", 1) for r in ROWS], f"{PAGES}, payload binary, digest int").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    assert Counter(map(tuple, wa.op12_zip_warc(spark, str(tmp_path)).collect())) == by_hand(ROWS)


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    assert wa.op12_zip_warc(spark, str(tmp_path)).collect() == []


def test_packages_are_what_others_read(spark, tmp_path):
    """Small packages by the size bound; zipfile and gzip read the same records; targets are one line."""
    made = wa.write_packages(spark.createDataFrame(ROWS, PAGES).coalesce(1), str(tmp_path), most=4000, least=1)
    paths = [r.path for r in made.collect()]
    assert len(paths) > 1 and sum(r.records for r in made.collect()) == len(ROWS)
    raw = []
    for path in paths:
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            raw.append(gzip.decompress(z.read(wa.WARC)))
    rows = wa.read_records(made).collect()
    assert sum(x.count(b"WARC-Type: ") for x in raw) == len(rows) == len(ROWS)
    assert Counter(bytes(r.payload) for r in rows if r.record_type == "response") == Counter((h or "").encode() for (i, _, h), t in zip(ROWS, [k for k in _types(ROWS)], strict=True) if t == "response")
    assert {r.url for r in rows} >= {None, "http://x/a%20b%0D%0AX:%20y"} and all(r.intact for r in rows)


def _types(rows):
    last = {}
    for i, _, html in rows:
        if i is not None and html:
            last[html] = max(i, last.get(html, i))
    return ["response" if not html or last.get(html) in (None, i) else "revisit" for i, _, html in rows]


def _packed(tmp_path, name, members, before=b"", **options):
    path = tmp_path / name
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
        for member, body in members.items():
            z.writestr(member, body, **options)
    path.write_bytes(before + data.getvalue())
    return str(path)


def _responses(n):
    return [wa.page_record(f"urn:page:{i}", f"http://{i}", f"body {i}".encode() * i, wa.base32(hashlib.sha1(f"body {i}".encode() * i).digest()), None, "2000-01-01T00:00:00Z") for i in range(n)]


def _read(spark, *paths):
    return {(r.path, r.record_id): (bytes(r.payload), r.intact) for r in wa.read_records(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}


def test_without_an_index(spark, tmp_path):
    """Offsets by walking the member: gzip members, records that are not compressed, and bytes before the ZIP file."""
    records = _responses(30)
    pressed = b"".join(map(gzip.compress, records))
    paths = [_packed(tmp_path, "a.wacz", {"archive/x.warc.gz": pressed, "notes.txt": "n"}), _packed(tmp_path, "b.wacz", {"archive/y.warc": b"".join(records), "archive/empty.warc": b""}, before=b"#!/bin/sh\n")]
    assert _read(spark, *paths) == {(p, f"urn:page:{i}"): (f"body {i}".encode() * i, True) for p in paths for i in range(30)}


def test_a_wrong_digest_is_told(spark, tmp_path):
    bad = wa.page_record("urn:page:1", "u", b"payload", "A" * 32, None, "2000-01-01T00:00:00Z")
    assert _read(spark, _packed(tmp_path, "c.wacz", {"archive/x.warc": bad})) == {(str(tmp_path / "c.wacz"), "urn:page:1"): (b"payload", False)}


def _zip64(name: str, body: bytes) -> bytes:
    """A ZIP file whose sizes and offsets stand in ZIP64 fields only."""
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name.encode()), 20) + name.encode() + struct.pack("<HHQQ", 1, 16, len(body), len(body))
    extra = struct.pack("<HHH", 0xCAFE, 2, 7) + struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    central = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name.encode()), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name.encode() + extra
    at = len(local) + len(body)
    end = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    return local + body + central + end + b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(central), 1) + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 5) + b"PK\x05\x06"[:5] + b"!"


@pytest.mark.parametrize("before", [b"", b"in front"])
def test_zip64(spark, tmp_path, before):
    body = b"".join(map(gzip.compress, _responses(4)))
    path = tmp_path / "z.wacz"
    path.write_bytes(before + _zip64("archive/ä.warc.gz", body))
    assert len(_read(spark, str(path))) == 4




def test_damaged_packages(spark, tmp_path):
    good = _packed(tmp_path, "d.wacz", {"archive/x.warc": _responses(2)[1]})
    short = tmp_path / "short.wacz"
    short.write_bytes(open(good, "rb").read()[:-30])
    packed = _packed(tmp_path, "e.wacz", {"archive/x.warc": _responses(2)[1]}, compress_type=zipfile.ZIP_DEFLATED)
    for path, said in ((str(short), "not a ZIP file"), (packed, "compressed")):
        with pytest.raises(Exception, match=said):
            _read(spark, path)


def test_index_lines_by_ranges():
    lines = [b"x" * k for k in (0, 1, 5, 30, 2, 0, 0, 17)] + [b"last, without an end"]
    body = b"\n".join(lines)
    file = pa.PythonFile(io.BytesIO(b"head" + body), mode="r")
    for step in (1, 2, 3, 7, 16, 100):
        found = [line for low in range(0, len(body), step) for line in wa._lines(file, 4, len(body), low, low + step)]
        assert found == lines, step


def test_index_in_ranges(spark, tmp_path):
    made = wa.write_packages(spark.createDataFrame(ROWS, PAGES).coalesce(1), str(tmp_path))
    found = wa.members(made)
    whole = found.transform(wa.index_entries).collect()
    assert Counter(wa.index_entries(found, step=500).collect()) == Counter(whole) and len(whole) == len(ROWS)
    assert found.where("kind = 'warc'").select(F.sum("size")).first()[0] == sum(r.length for r in whole)
