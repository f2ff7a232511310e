"""Text lines of the formats written: GFA, GFF3, PAF, BLAST tables, FASTA, CSV; and files of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import rendered
from ..storage import cleaned, one_file


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def gfa_segments(nodes: DataFrame, sequence: str | None = None) -> DataFrame:
    """value, rank of S lines; nodes: id, coverage."""
    seq = F.coalesce(F.col(sequence), F.lit("")) if sequence else F.lit("")
    return nodes.select(F.concat_ws("\t", F.lit("S"), _s("id"), seq, F.concat(F.lit("FC:i:"), _s("coverage"))).alias("value"), _s("id").alias("rank"))


def gfa_links(edges: DataFrame) -> DataFrame:
    """value, rank of L lines; strands are always +. edges: src, dst, coverage."""
    return edges.select(F.concat_ws("\t", F.lit("L"), _s("src"), F.lit("+"), _s("dst"), F.lit("+"), F.lit(""), F.concat(F.lit("FC:i:"), _s("coverage"))).alias("value"), F.concat_ws("\t", _s("src"), _s("dst")).alias("rank"))


def gfa_paths(paths: DataFrame) -> DataFrame:
    """value, rank of P lines; paths: name, path, size."""
    return paths.select(F.concat_ws("\t", F.lit("P"), "name", rendered(F.col("path")), _s("size")).alias("value"), F.col("name").alias("rank"))


def gfa_graph(header: str, nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """value, section, rank: header, segments by id, links, paths."""
    spark = nodes.sparkSession
    width = 12  # digits, so that ranks sort as numbers
    segments = gfa_segments(nodes).withColumn("rank", F.lpad("rank", width, "0"))
    parts = [spark.createDataFrame([(f"H\t{header}", "")], "value string, rank string"), segments, gfa_links(edges), gfa_paths(paths)]
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("section", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def write_lines(lines: DataFrame, path: str, *order: str, single: bool = False, compression: str = "none") -> None:
    """Text files whose names sort as their lines do; each holds a range of the order. With ``single`` one file at path, of the same lines in the same order, and not compressed."""
    with cleaned(lines.sparkSession):
        (lines.orderBy(*order) if order else lines).select("value").write.option("compression", "none" if single else compression).text(f"{path}.parts" if single else path)
    if single:
        one_file(lines.sparkSession, f"{path}.parts", path)


def gff_lines(genes: DataFrame, feature: Column | None = None) -> DataFrame:
    """GFF3 lines (start counted from 1) of genes: ref, gstart, gend, ori, description, gene_id."""
    attributes = F.concat(F.lit("protein_id="), "gene_id", F.lit(";product="), "description")
    return genes.select(F.concat_ws("\t", "ref", F.lit("."), feature if feature is not None else F.lit("CDS"), (F.col("gstart") + 1).cast("string"), _s("gend"), F.lit("."), "ori", F.lit("."), attributes).alias("value"))


def description_lines(genes: DataFrame) -> DataFrame:
    """id, reference, start from 1, end, orientation, description, gene id."""
    return genes.select(F.concat_ws("\t", _s("id"), "ref", (F.col("gstart") + 1).cast("string"), _s("gend"), "ori", "description", "gene_id").alias("value"))


def paf_lines(aln: DataFrame) -> DataFrame:
    length = F.coalesce(F.col("ref_length"), F.lit(0)) if "ref_length" in aln.columns else F.lit(0)
    return aln.select(F.concat_ws("\t", "qname", _s("query_length"), _s("qstart"), _s("qend"), "ori", "rname", length.cast("string"), _s("rstart"), _s("rend"), F.lit("0"), _s("align_length"), _s("mapq")).alias("value"))


def blast_lines(pairs: DataFrame) -> DataFrame:
    """Ten-column BLAST table lines; the orientation shows in the order of the subject's start and end."""
    forward = F.col("ori") == "+"
    start, end = F.when(forward, F.lit(1)).otherwise(F.col("rlength")), F.when(forward, F.col("rlength")).otherwise(F.lit(1))
    return pairs.select(F.concat_ws("\t", _s("q"), _s("qlength"), _s("r"), _s("rlength"), start.cast("string"), end.cast("string"), F.least("qlength", "rlength").cast("string"), F.lit("90.0"), _s("eval"), _s("bitscore")).alias("value"))


def fasta_lines(sequences: DataFrame, name: str, seq: str) -> DataFrame:
    return sequences.select(F.concat(F.lit(">"), _s(name), F.lit("\n"), F.col(seq)).alias("value"))


def write_table(df: DataFrame, path: str, sep: str = "\t", header: bool = False, quote_all: bool = False, single: bool = False, compression: str = "none") -> None:
    """A folder of delimited text, or with ``single`` one file at path, its header once and not compressed."""
    out = df.write.option("sep", sep).option("quoteAll", quote_all).option("emptyValue", "")
    with cleaned(df.sparkSession):
        if not single:
            out.option("header", header).option("compression", compression).csv(path)
            return
        out.csv(f"{path}.parts")
    quoted = [f'"{c}"' if quote_all else c for c in df.columns]
    one_file(df.sparkSession, f"{path}.parts", path, sep.join(quoted) if header else None)


def write_store(sequences: DataFrame, path: str, table: str | None = None, buckets: int = 64) -> None:
    """The id -> sequence store: Parquet in ranges of ids, sorted, so that a look-up of ids skips files and row groups.

    With ``table``, the catalog knows it under that name, bucketed and sorted by id: joins on id read it without a shuffle, and look-ups
    one bucket of ``buckets``.
    """
    if table is None:
        sequences.repartitionByRange("id").sortWithinPartitions("id").write.option("parquet.block.size", 8 << 20).parquet(path)
        return
    sequences.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(table)
