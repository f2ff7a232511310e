"""FASTA, FASTQ and GenBank as data sources of Spark: ``spark.read.format("fastq").load(path)`` after ``register(spark)``.

Files are read in splits of ``splitSize`` bytes (an option). A task finds the first record that starts in its split and goes on, past the split's
end, until its last record is whole: no line is numbered, sorted or shuffled. Conditions ``name = ..`` and ``name IN (..)`` are pushed
down (``seqname`` in GenBank files): other records are left before they are decoded. Files that end in .gz are one split each.

``path`` is a file, a folder, or several of these (load([..])). Files are opened by pyarrow's file systems, which know local paths, HDFS, S3 and GCS.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .formats import GENBANK, GENBANK_ARROW, genbank_rows

SPLIT, CHUNK, BATCH = 64 << 20, 4 << 20, 8 << 20
MOST = 1024  # tasks that read one load; where there are more splits, a task reads several in a row


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?!/)", "file:///", path)))


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int | None  # None: the whole of a compressed file


@dataclass
class Splits(InputPartition):
    splits: list[Split]


class Bytes:
    """The bytes of a file from an offset on, kept from the record at hand."""

    def __init__(self, file, at: int):
        self.file, self.at, self.held, self.over = file, at, b"", False

    def more(self) -> bool:
        """Reads on; False at the end of the file."""
        data = b"" if self.over else self.file.read(CHUNK)
        self.over = not data
        self.held += data
        return bool(data)

    def drop(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def marked_records(source: Bytes, mark: bytes, end: int | None) -> Iterator[bytes]:
    """Records that begin with ``mark`` at the start of a line; source begins at a line break, or at offset 0 of a file with one put before."""
    begin, scanned = b"\n" + mark, 0
    inside = False
    while True:
        at = source.held.find(begin, scanned)
        if at < 0:
            scanned = max(1 if inside else 0, len(source.held) - len(begin) + 1)
            if not inside:
                source.drop(scanned)
                scanned = 0
            if source.more():
                continue
            if inside and source.held[1:].strip():
                yield source.held[1:]
            return
        if inside:
            yield source.held[1:at]
        source.drop(at)
        # The record starts one byte after the line break.
        if end is not None and source.at + 1 >= end:
            return
        inside, scanned = True, 1


def fastq_records(source: Bytes, first: bool, end: int | None) -> Iterator[tuple[bytes, bytes, bytes]]:
    """Header, sequence and quality of groups of four lines; the group that lies on a border belongs to the split it starts in.

    Where a split begins, a group is found by its first and third line: they begin with @ and +. A line of qualities may begin with @ too, but then
    the line after the next is a sequence.
    """

    def lines(n: int) -> list[bytes] | None:
        """The next n lines, or what is left of them; None without any."""
        while source.held.count(b"\n") < n and source.more():
            pass
        return source.held.split(b"\n", n)[:n] if source.held else None

    if not first:  # the rest of a line belongs to the split before
        while b"\n" not in source.held and source.more():
            pass
        source.drop(source.held.find(b"\n") + 1 if b"\n" in source.held else len(source.held))
        while (ahead := lines(3)) and not (len(ahead) == 3 and ahead[0].startswith(b"@") and ahead[2].startswith(b"+")):
            source.drop(min(len(source.held), len(ahead[0]) + 1))
    while source.held or source.more():
        # As many whole groups as the bytes at hand hold.
        parts = source.held.split(b"\n")
        groups = (len(parts) - 1) // 4
        if not groups:
            if source.more():
                continue
            if len(parts) >= 2 and (end is None or source.at < end):
                yield parts[0], parts[1], parts[3] if len(parts) > 3 else b""
            return
        at = source.at
        for k in range(groups):
            head, seq, plus, quality = parts[4 * k : 4 * k + 4]
            if end is not None and at >= end:
                return
            at += len(head) + len(seq) + len(plus) + len(quality) + 4
            yield head, seq, quality
        source.drop(at - source.at)


def _name(head: bytes) -> str:
    found = head.split(None, 1) if not head[:1].isspace() else []
    return found[0].decode() if found else ""


class RecordReader(DataSourceReader):
    """Splits of the files, and batches of rows of the records in them; subclasses say how a record is found and read."""

    columns: pa.Schema
    key = "name"

    def __init__(self, options: dict):
        paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.paths, self.size, self.names = paths, int(options.get("splitSize", SPLIT)), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == (self.key,):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = self.splits()
        n = -(-len(found) // MOST)
        return [Splits(found[k : k + n]) for k in range(0, len(found), n)] if n > 1 else found

    def splits(self) -> list[Split]:
        out = []
        for path in self.paths:
            where, at = _opened(path)
            lead = path[: len(path) - len(at)] if path.endswith(at) else ""
            info = where.get_file_info(at)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(at, recursive=True))
            for f in sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
                if f.path.endswith(".gz"):
                    out.append(Split(lead + f.path, 0, None))
                else:
                    out += [Split(lead + f.path, a, min(a + self.size, f.size)) for a in range(0, f.size, self.size)]
        return out

    def read(self, split: Split | Splits | None) -> Iterator[pa.RecordBatch]:
        if isinstance(split, Splits):
            for one in split.splits:
                yield from self.read(one)
            return
        if split is None:  # Spark's way to say that there are no splits
            return
        where, at = _opened(split.path)
        rows, held = [], 0
        with where.open_input_stream(at, compression="gzip") if split.end is None else where.open_input_file(at) as file:
            for row, size in self.records(file, split):
                rows.append(row)
                held += size
                if held >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, self.columns)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.columns)

    def wanted(self, name: str) -> bool:
        return self.names is None or name in self.names

    def records(self, file, split: Split) -> Iterator[tuple[dict, int]]:
        """Rows and their sizes in bytes."""
        raise NotImplementedError

    def marked(self, file, split: Split, mark: bytes) -> Iterator[bytes]:
        source = Bytes(file, split.start - 1)
        if split.start:
            file.seek(split.start - 1)
        else:
            source.held = b"\n"
        return marked_records(source, mark, split.end)


class FastaReader(RecordReader):
    columns = pa.schema([("name", pa.string()), ("seq", pa.string())])

    def records(self, file, split):
        for raw in self.marked(file, split, b">"):
            head, _, body = raw[1:].partition(b"\n")
            name = _name(head)
            if self.wanted(name) and raw.strip() != b">":
                yield {"name": name, "seq": b"".join(body.split()).decode()}, len(raw)


class FastqReader(RecordReader):
    columns = pa.schema([("name", pa.string()), ("seq", pa.string()), ("quality", pa.string())])

    def records(self, file, split):
        source = Bytes(file, max(0, split.start - 1))
        if split.start:
            file.seek(split.start - 1)
        for head, seq, quality in fastq_records(source, split.start == 0, split.end):
            name = _name(head[1:])
            if self.wanted(name):
                yield {"name": name, "seq": seq.rstrip(b"\r").decode(), "quality": quality.rstrip(b"\r").decode()}, len(seq) * 2


class GenBankReader(RecordReader):
    columns, key = GENBANK_ARROW, "seqname"

    def records(self, file, split):
        for raw in self.marked(file, split, b"LOCUS"):
            name = _name(raw[5:].lstrip())
            if self.wanted(name):
                for row in genbank_rows(raw.decode().split("\n//")[0]):
                    yield row, len(row["sequence"] or "") + 200


def _source(form: str, columns: str, of: type[RecordReader]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return form

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> RecordReader:
            return of(self.options)

    return Source


SOURCES = [_source("fasta", "name string, seq string", FastaReader), _source("fastq", "name string, seq string, quality string", FastqReader), _source("genbank", GENBANK, GenBankReader)]


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and lets Spark push conditions down into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in SOURCES:
        spark.dataSource.register(source)
