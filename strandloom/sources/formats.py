"""Readers of the text formats: PAF, BLAST tables, GFF3, GFA, FASTA, FASTQ, GenBank, tables of ids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import number_in_place
from .genbank import record_of


def read_lines(spark: SparkSession, path: str | list[str], skip_comments: bool = False) -> DataFrame:
    """value, file, at: lines of text files; (file, at) sorts them as they stand in the files.

    ``at`` joins the offset of the split a line was read from and its running number inside.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"))
    out = lines.select("value", "file", F.struct("_block", "_n").alias("at"))
    return out.where(~F.col("value").startswith("#")) if skip_comments else out


def uri_of(spark: SparkSession, path: str) -> str:
    """A path as ``file_of`` shows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().toString()
    return re.sub("^([a-zA-Z0-9]+):/+", r"\1:/", whole)


def file_of(column: str = "file") -> Column:
    """The file of read_lines with one slash after its scheme, so that files can be compared with uri_of."""
    return F.regexp_replace(column, "^([a-zA-Z0-9]+):/+", "$1:/")


def _columns(value: str = "value") -> Column:
    return F.split(value, "\t")


def _cut(lines: DataFrame) -> DataFrame:
    """Lines with ``_c``, their cells: a row of its own step, or every condition on a cell would split the line again."""
    return lines.withColumn("_c", F.explode(F.array(_columns())))


def _kept(lines: DataFrame) -> list[str]:
    """Columns of read_lines and number_lines that stay beside what is parsed."""
    return [c for c in ("line_no", "file", "at") if c in lines.columns]


def number_lines(lines: DataFrame) -> DataFrame:
    """Lines of read_lines with ``line_no``, from 1 over all files."""
    return number_in_place(lines, "line_no", first=1).drop("file", "at")


def read_file_list(spark: SparkSession, path: str) -> list[str]:
    """The paths listed in a small text file, one per line."""
    return [r.value.strip() for r in read_lines(spark, path).orderBy("file", "at").collect() if r.value.strip()]


def _int(cells: Column, i: int) -> Column:
    return F.get(cells, F.lit(i)).cast("int")


def _text(cells: Column, i: int) -> Column:
    return F.get(cells, F.lit(i))


def parse_paf(lines: DataFrame) -> DataFrame:
    """Alignments of PAF lines; a query's name ends at its first white space."""
    c = F.col("_c")
    return _cut(lines).select(*_kept(lines), F.regexp_extract(_text(c, 0), r"^(\S*)", 1).alias("qname"), _int(c, 1).alias("query_length"), _int(c, 2).alias("qstart"), _int(c, 3).alias("qend"), _text(c, 4).alias("ori"), _text(c, 5).alias("rname"), _int(c, 6).alias("ref_length"), _int(c, 7).alias("rstart"), _int(c, 8).alias("rend"), _int(c, 10).alias("align_length"), _int(c, 11).alias("mapq"))


def parse_blast(lines: DataFrame, local_ids: bool = False) -> DataFrame:
    """Pairs of ten-column BLAST table lines, q and r being numbers or, as local ids, names; '+' iff the subject's start lies before its end."""
    c = F.col("_c")
    name = _text if local_ids else _int
    ori = F.when(_int(c, 4) < _int(c, 5), "+").otherwise("-")
    return _cut(lines).select(*_kept(lines), name(c, 0).alias("q"), _int(c, 1).alias("qlength"), name(c, 2).alias("r"), _int(c, 3).alias("rlength"), ori.alias("ori"), _int(c, 6).alias("alength"), *(_text(c, i).cast("double").alias(n) for i, n in ((7, "identity"), (8, "eval"), (9, "bitscore"))))


def attribute(attributes: Column, tag: str) -> Column:
    """What follows the tag in the first ;-separated piece that starts with it; the text "null" without one."""
    found = F.get(F.filter(F.split(attributes, ";"), lambda x: x.startswith(tag)), F.lit(0))
    return F.coalesce(F.substring(found, len(tag) + 1, 1 << 30), F.lit("null"))


def parse_gff(lines: DataFrame, features: list[str] | None = None, name_tag: str = "product=", id_tag: str = "protein_id=") -> DataFrame:
    """Genes of GFF3 lines (start from 0): comments and rows of fewer than 9 columns are skipped, other features left out.

    A row without a proper orientation or extent is an error.
    """
    c = F.col("_c")
    rows = _cut(lines.where(~F.col("value").startswith("#"))).where((F.size(c) >= 9) & _text(c, 2).isin(features or ["CDS"]))
    start, end, ori = _int(c, 3) - 1, _int(c, 4), _text(c, 6)
    checked = F.when(ori.isin("+", "-") & (start < end), start).otherwise(F.raise_error(F.concat(F.lit("not a proper gene: "), "value")).cast("int"))
    return rows.select(*_kept(lines), _text(c, 0).alias("ref"), checked.alias("gstart"), end.alias("gend"), ori.alias("ori"), attribute(_text(c, 8), name_tag).alias("description"), attribute(_text(c, 8), id_tag).alias("gene_id"))


def read_gff(spark: SparkSession, paths: list[str], **tags) -> DataFrame:
    """Genes of one or several GFF3 files with running ids, by file in the order given, then by line."""
    lines = read_lines(spark, paths)
    # A path is a file, or a folder of files.
    known = {uri_of(spark, p).rstrip("/"): k for k, p in reversed(list(enumerate(paths)))}

    def rank(file: str) -> int:
        place = re.sub("^([a-zA-Z0-9]+):/+", r"\1:/", file)
        return min((k for p in [place, *(place[:i] for i, c in enumerate(place) if c == "/")] if (k := known.get(p)) is not None), default=len(paths))

    ranks = spark.createDataFrame([(f, rank(f)) for f in set(lines.inputFiles())], "file string, rank int")
    rows = parse_gff(lines, **tags).withColumn("file", file_of())
    numbered = number_in_place(rows, "id", ranks=ranks.withColumn("file", file_of()))
    return numbered.select(F.col("id").cast("int").alias("id"), "ref", "gstart", "gend", "ori", "description", "gene_id")


def parse_descriptions(lines: DataFrame) -> DataFrame:
    """Genes of description lines; the start is taken as it stands."""
    c = _columns()
    return lines.select(_int(c, 0).alias("id"), _text(c, 1).alias("ref"), _int(c, 2).alias("gstart"), _int(c, 3).alias("gend"), _text(c, 4).alias("ori"), _text(c, 5).alias("description"), _text(c, 6).alias("gene_id"))


def parse_pairs(lines: DataFrame, a: str, b: str) -> DataFrame:
    """Two columns of ids or labels; a row of another width is an error."""
    c = _columns()
    first = F.when(F.size(c) == 2, _text(c, 0)).otherwise(F.raise_error(F.concat(F.lit("expected two columns: "), "value")))
    return lines.select(first.alias(a), _text(c, 1).alias(b), *_kept(lines))


def last_wins(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """key, value of the last line of each key; pairs come from read_lines."""
    return pairs.groupBy(key).agg(F.max_by(value, F.struct("file", "at")).alias(value))


def parse_gene_families(lines: DataFrame) -> DataFrame:
    """family, gene: the different genes of each family, a row each. A line of more or fewer than two columns is an error."""
    pairs = parse_pairs(lines, "gene", "family")
    return pairs.select(F.col("family").cast("int").alias("family"), F.col("gene").cast("int").alias("gene")).distinct()


def parse_labels(lines: DataFrame) -> DataFrame:
    """id, label: the different labels of each node, a row each; further columns of a line are left out."""
    c = _columns()
    return lines.select(_int(c, 0).alias("id"), _text(c, 1).alias("label")).distinct()


def parse_fetch_config(lines: DataFrame) -> DataFrame:
    """id, start, end: windows to fetch; both null for a whole sequence. Tab-separated; two columns are an error, further ones are left out, empty ones at the end too."""
    c = F.split(F.regexp_replace("value", r"\t+$", ""), "\t")
    name = F.when(F.size(c) != 2, _text(c, 0)).otherwise(F.raise_error(F.concat(F.lit("expected a name, or name, start and end: "), "value")))
    return lines.select(name.alias("id"), _int(c, 1).alias("start"), _int(c, 2).alias("end"))


def parse_gfa_paths(lines: DataFrame) -> DataFrame:
    """name, path, size of P lines with a path. Of paths of one name, the last in lines of read_lines stays."""
    from ..functions.paths import parsed

    c = _columns()
    rows = lines.where(_text(c, 0) == "P")
    name = F.when(F.size(c) == 4, _text(c, 1)).otherwise(F.raise_error(F.concat(F.lit("expected four columns: "), "value")))
    found = rows.select(name.alias("name"), parsed(_text(c, 2)).alias("path"), _int(c, 3).alias("size"), *_kept(lines)).where(F.size("path") > 0)
    if "at" not in found.columns:
        return found.select("name", "path", "size")
    last = found.groupBy("name").agg(F.max_by(F.struct("path", "size"), F.struct("file", "at")).alias("_p"))
    return last.select("name", "_p.path", "_p.size")


def _weight() -> Column:
    return F.nullif(F.regexp_extract("value", r"\tFC:i:(\d+)", 1), F.lit("")).cast("int")


def gfa_node_table(lines: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """id, weight, label of S lines; labels: id, label."""
    nodes = lines.where(F.col("value").startswith("S\t")).select(_int(_columns(), 1).alias("id"), _weight().alias("weight"))
    if labels is None:
        return nodes.withColumn("label", F.lit("None"))
    return nodes.join(labels, "id", "left").withColumn("label", F.coalesce("label", F.lit("None")))


def gfa_edge_table(lines: DataFrame) -> DataFrame:
    """source, target, weight of L lines."""
    c = _columns()
    return lines.where(F.col("value").startswith("L\t")).select(_int(c, 1).alias("source"), _int(c, 3).alias("target"), _weight().alias("weight"))


def graph_faults(nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """fault, src, dst: edges with an unknown end and, for an undirected graph, edges without their reverse; empty if all is well."""
    known = nodes.select(F.col("id"))
    lost = edges.join(known, edges["source"] == known["id"], "left_anti").unionByName(edges.join(known, edges["target"] == known["id"], "left_anti"))
    out = lost.select(F.lit("unknown node").alias("fault"), "source", "target")
    if not directed:
        back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
        out = out.unionByName(edges.select("source", "target").join(back, ["source", "target"], "left_anti").select(F.lit("one way").alias("fault"), "source", "target"))
    return out.distinct()


def read_fasta(spark: SparkSession, path: str | list[str], with_file: bool = False) -> DataFrame:
    """name, seq[, file]: one row per record, split at '>' after a line break, so files are read in parallel."""
    records = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    body = F.regexp_replace("value", "^>", "")
    name = F.regexp_extract(body, r"^(\S*)", 1)
    seq = F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"\s", "")
    return records.select(name.alias("name"), seq.alias("seq"), *([F.col("_metadata.file_path").alias("file")] if with_file else []))


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, seq: a row per four lines, read by the data source ``fastq``."""
    from .records import register

    register(spark)
    return spark.read.format("fastq").load(path).select("name", "seq")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """FASTA or FASTQ by the file's ending."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("fa", "fasta", "fna"):
        return read_fasta(spark, path)
    if ending in ("fastq", "fq"):
        return read_fastq(spark, path)
    raise ValueError(f"neither FASTA nor FASTQ: {path}")


GENBANK = "seqname string, kind string, start int, end int, ori string, product string, protein_id string, sequence string, exons array<struct<seqname:string,start:int,end:int,ori:string>>"


def genbank_rows(text: str) -> list[dict]:
    """The rows (GENBANK) of one record."""
    record = record_of(text)
    if record is None:
        return []
    name, genes, bases = record
    rows = [{"seqname": name, "kind": "gene", "start": g.start, "end": g.end, "ori": g.ori, "product": g.product, "protein_id": g.protein_id, "sequence": g.protein, "exons": [{"seqname": e.remote or name, "start": e.start, "end": e.end, "ori": e.ori} for e in g.exons]} for g in genes]
    return [*rows, {"seqname": name, "kind": "sequence", "sequence": bases}]


GENBANK_ARROW = pa.schema([("seqname", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("ori", pa.string()), ("product", pa.string()), ("protein_id", pa.string()), ("sequence", pa.string()), ("exons", pa.list_(pa.struct([("seqname", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("ori", pa.string())])))])


def read_genbank(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of kind 'gene' (CDS with extent, product, protein and exons in reading order) and 'sequence' (the record's bases) of GenBank files.

    Files are split between records; a record is read in one task. A location that does not follow the grammar, or lies on other sequences
    only, is an error.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.column(0).to_pylist():
                if rows := genbank_rows(record):
                    yield pa.RecordBatch.from_pylist(rows, GENBANK_ARROW)

    return spark.read.option("lineSep", "\n//").text(path).mapInArrow(records, GENBANK)
