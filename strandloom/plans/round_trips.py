"""Registered queries over files in the shared folder: tables written in a format and read back, or put through a command over files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import architectures as R
from ..operators import graph as G
from ..sources import adapters as D
from ..sources import formats, records, writers
from ..storage import cleaned, materialize, passing, remove, scratch
from . import files

ROUND_TRIPS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def round_trip(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    ROUND_TRIPS[f.__name__] = f
    return f


def _put(lines: DataFrame, path: str, compression: str = "none", most: int = 0) -> str:
    """Compressed files are read whole by a task: ``most`` lines go into one, if there is no other bound."""
    with cleaned(lines.sparkSession):
        lines.write.option("compression", compression).option("maxRecordsPerFile", most).text(path)
    return path


def _put_pairs(s: SparkSession, d: str, out: str, lines: Callable[[DataFrame], DataFrame], dna: Callable[[DataFrame], DataFrame] | None = None) -> Iterator[tuple[str, str | None]]:
    """Files of the lines of pairs, and of their DNA alignments, in portions: pairs are many times as many as there are genes, and a portion's files go when the next is asked for.

    They are compressed: their parts, of some PAIRS lines each, are read whole by a task.
    """
    for k, pairs in enumerate(D.homology_portions(s, d)):
        yield _put(lines(pairs), f"{out}/x-{k}", "lz4"), _put(dna(pairs), f"{out}/dna-{k}", "lz4") if dna else None
        remove(s, f"{out}/x-{k}")
        remove(s, f"{out}/dna-{k}")


def _tabbed(*columns) -> Column:
    return F.concat_ws("\t", *[c if isinstance(c, Column) else F.col(c).cast("string") for c in columns]).alias("value")


def _dna(s: SparkSession, d: str) -> DataFrame:
    return D.dna(s, d).select("id", F.coalesce("seq", F.lit("")).alias("seq"))


def _fasta(s: SparkSession, d: str, path: str) -> str:
    return _put(writers.fasta_lines(_dna(s, d), "id", "seq"), path)


def _gff(s: SparkSession, d: str, path: str, where: str = "true") -> str:
    return _put(writers.gff_lines(D.genes(s, d).where(where).orderBy("id")), path)


def _descriptions(s: SparkSession, d: str, path: str) -> str:
    return _put(writers.description_lines(D.genes(s, d)), path)


@round_trip
def text_lines_numbered(s, d):
    """Sorted lines, numbered as they stand in their files."""
    out = scratch(s)
    writers.write_lines(D.genes(s, d).select("id", F.col("gene_id").alias("value")), f"{out}/x", "id")
    return formats.number_lines(formats.read_lines(s, f"{out}/x")).select("line_no", "value")


@round_trip
def fasta_files(s, d):
    return formats.read_sequences(s, _fasta(s, d, f"{scratch(s)}/x.fasta"))


@round_trip
def fastq_files(s, d):
    read = F.concat(F.lit("@"), F.col("id").cast("string"), F.lit(" read\n"), F.col("seq"), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")))
    return formats.read_sequences(s, _put(_dna(s, d).select(read.alias("value")), f"{scratch(s)}/x.fq"))


@round_trip
def gff_file_list(s, d):
    """Two GFF3 files of one name, in the order of a list of files."""
    out = scratch(s)
    paths = [_gff(s, d, f"{out}/b/genes.gff", "id % 2 = 0"), _gff(s, d, f"{out}/a/genes.gff", "id % 2 = 1")]
    s.createDataFrame([(p,) for p in paths], "value string").coalesce(1).write.text(f"{out}/list")
    return formats.read_gff(s, formats.read_file_list(s, f"{out}/list"))


@round_trip
def description_files(s, d):
    out = scratch(s)
    files.gff2descriptions(s, [_gff(s, d, f"{out}/x.gff")], out)
    return formats.parse_descriptions(formats.read_lines(s, f"{out}/gene_description"))


@round_trip
def gene_family_files(s, d):
    rows = D.genes(s, d).select(_tabbed("id", (F.col("id") % 7).cast("string")))
    return formats.parse_gene_families(formats.read_lines(s, _put(rows.unionByName(rows), f"{scratch(s)}/x")))


@round_trip
def label_files(s, d):
    rows = D.genes(s, d).select(_tabbed((F.col("id") % 50).cast("string"), "description", "gene_id"))
    return formats.parse_labels(formats.read_lines(s, _put(rows, f"{scratch(s)}/x")))


@round_trip
def mapping_files(s, d):
    """Two lines for every gene, of which the last one counts."""
    both = D.genes(s, d).select("id", F.explode(F.array(F.lit("old"), F.lit("new"))).alias("kind")).select("id", "kind", _tabbed("id", F.concat("kind", F.col("id").cast("string"))))
    out = scratch(s)
    writers.write_lines(both, f"{out}/x", "id", F.desc("kind"))
    return formats.last_wins(formats.parse_pairs(formats.read_lines(s, f"{out}/x"), "old", "new"), "old", "new")


def _families(s: SparkSession, d: str) -> str:
    out = scratch(s)
    files.graph_family(s, _descriptions(s, d, f"{out}/genes"), _put_pairs(s, d, out, writers.blast_lines), out)
    return out


def _members(s: SparkSession, out: str) -> DataFrame:
    return s.read.option("sep", "\t").schema("id int, canonical int").csv(f"{out}/gene_families")


@round_trip
def family_files(s, d):
    return _members(s, _families(s, d))


@round_trip
def family_graph_files(s, d):
    return formats.gfa_edge_table(formats.read_lines(s, f"{_families(s, d)}/graph.gfa"))


@round_trip
def family_connectivity_files(s, d):
    found = s.read.option("sep", "\t").schema("n_degree double, cc_size bigint").csv(f"{_families(s, d)}/homology_connectivity")
    return found.select(F.round("n_degree", 6).alias("n_degree"), "cc_size")


def _local_paf(pairs: DataFrame, q: str = "q", r: str = "r") -> DataFrame:
    """PAF lines of pairs of genes, named by gene_id."""
    columns = [F.concat(F.lit("P"), F.col(q).cast("string")).alias("qname"), F.col(q[0] + "length").alias("query_length"), F.lit(0).alias("qstart"), F.col(q[0] + "length").alias("qend"), "ori", F.concat(F.lit("P"), F.col(r).cast("string")).alias("rname"), F.col(r[0] + "length").alias("ref_length"), F.lit(0).alias("rstart"), F.col(r[0] + "length").alias("rend"), F.least("qlength", "rlength").alias("align_length"), F.lit(60).alias("mapq")]
    return writers.paf_lines(pairs.select(*columns))


@round_trip
def family_paf_files(s, d):
    out = scratch(s)
    files.graph_family(s, _descriptions(s, d, f"{out}/genes"), _put_pairs(s, d, out, _local_paf), out, blast=False, local_ids=True)
    return _members(s, out)


@round_trip
def family_split_files(s, d):
    """Protein alignments whose orientations come from DNA alignments the other way round, where there are any."""
    out = scratch(s)
    both = _put_pairs(s, d, out, writers.blast_lines, lambda pairs: _local_paf(pairs.where("bitscore < 80"), "r", "q"))
    files.graph_family(s, _descriptions(s, d, f"{out}/genes"), both, out, split_ori=True, dna_local_ids=True)
    return _members(s, out)


def _paf(s: SparkSession, d: str, path: str) -> str:
    with passing():
        return _put(writers.paf_lines(D.alignments(s, d).orderBy("line_no")), path, "lz4", 1 << 21)


@round_trip
def graph_files(s, d):
    """The links of the graph that the command over GFF3 and PAF files writes."""
    out = scratch(s)
    files.graph_alignment(s, [_gff(s, d, f"{out}/x.gff")], _paf(s, d, f"{out}/x.paf"), out)
    return formats.gfa_edge_table(formats.read_lines(s, f"{out}/graph.gfa"))


@round_trip
def graph_single_file(s, d):
    """The links of the graph in one file."""
    out = scratch(s)
    files.graph_alignment(s, [_gff(s, d, f"{out}/x.gff")], _paf(s, d, f"{out}/x.paf"), out, single=True)
    return formats.gfa_edge_table(formats.read_lines(s, f"{out}/graph.gfa"))


@round_trip
def spilled_edge_coverage(s, d):
    """Edge coverage of path steps that were written to the shared folder and read again."""
    return G.edge_coverage(materialize(D.read_steps(s, d)))


@round_trip
def fasta_source_files(s, d):
    """FASTA files through the data source, in small splits."""
    records.register(s)
    return s.read.format("fasta").option("splitSize", 1 << 16).load(_fasta(s, d, f"{scratch(s)}/x.fasta"))


def _gfa(s: SparkSession, d: str, out: str) -> str:
    steps = D.read_steps(s, d)
    paths = R.gathered(steps).select("name", "path", F.size("path").alias("size"))
    writers.write_lines(writers.gfa_graph("Gene-graph", G.node_coverage(steps), G.edge_coverage(steps), paths), f"{out}/x.gfa", "section", "rank")
    return f"{out}/x.gfa"


@round_trip
def path_metrics_files(s, d):
    out = scratch(s)
    files.path_metrics(s, _gfa(s, d, out), out, directed=True)
    return files.read_architectures(s, out)


@round_trip
def gfa_converter_files(s, d):
    out = scratch(s)
    labels = G.graph_nodes(D.read_steps(s, d)).where("id % 2 = 0").select(_tabbed("id", F.concat(F.lit("label "), F.col("id").cast("string"))))
    files.gfa_converter(s, _gfa(s, d, out), out, labels=_put(labels, f"{out}/labels"))
    nodes, edges = (formats.read_lines(s, f"{out}/{k}").select(F.lit(k).alias("file"), "value") for k in ("nodes", "edges"))
    return nodes.unionByName(edges)


@round_trip
def extract_gene_files(s, d):
    out = scratch(s)
    spans = D.gene_spans(s, d, ordered=True).select(F.col("seq_key").cast("string").alias("ref"), "gstart", "gend", "ori", F.lit("x").alias("description"), F.lit("y").alias("gene_id"))
    files.extract_genes(s, [_put(writers.gff_lines(spans), f"{out}/x.gff")], _fasta(s, d, f"{out}/x.fa"), out)
    fna, faa = (formats.read_fasta(s, f"{out}/genes.{k}").select(F.col("name").alias("id"), F.col("seq").alias(k)) for k in ("fna", "faa"))
    return fna.join(faa, "id")


def _fetched(s: SparkSession, d: str) -> str:
    """Every sequence: a third whole, a third by a window inside, a third by one at the start and one that goes round; empty ones whole."""
    out, dna = scratch(s), _dna(s, d)
    n = F.length("seq")
    whole = dna.where((F.col("id") % 3 == 0) | (n == 0)).select(F.concat(F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, F.lit("\t")).otherwise(F.lit(""))).alias("value"))
    part = lambda k: F.floor(n / k)
    inside = F.array(F.struct(part(4).alias("a"), (part(4) + part(2) + 1).alias("b")))
    ends = F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.ceil(n / 2).alias("b")), F.struct((n - F.greatest(F.lit(1), part(3))).alias("a"), (n + part(4)).alias("b")))
    asked = dna.where((F.col("id") % 3 > 0) & (n > 0)).select("id", F.explode(F.when(F.col("id") % 3 == 1, inside).otherwise(ends)).alias("w"))
    windows = asked.select(_tabbed("id", "w.a", "w.b", F.lit("further column")))
    spans = F.array(*[F.struct(F.lit(f).alias("f"), a.alias("a"), b.alias("b")) for f, a, b in (("tRNA", part(3) + 1, part(2) + 1), ("CDS", F.lit(1).cast("bigint"), part(3) + 1), ("exon", n - part(5), n.cast("bigint")))])
    lines = dna.select("id", F.explode(spans).alias("x")).select(_tabbed("id", F.lit("x"), "x.f", "x.a", "x.b", F.lit("0.5"), F.lit("+"), F.lit("2"), F.concat(F.lit("ID="), F.col("id").cast("string"))))
    config, gff = _put(whole.unionByName(windows), f"{out}/config"), _put(lines, f"{out}/x.gff")
    files.fetch_subsequences(s, _fasta(s, d, f"{out}/x.fa"), config, out, gff=gff, normalize=True)
    return out


@round_trip
def fetch_sequence_files(s, d):
    return formats.read_fasta(s, f"{_fetched(s, d)}/subsequences.fa")


@round_trip
def fetch_gff_files(s, d):
    return formats.read_lines(s, f"{_fetched(s, d)}/subsequences.gff").select("value")


@round_trip
def fetch_key_files(s, d):
    out = scratch(s)
    files.fetch_keys(s, _descriptions(s, d, f"{out}/genes"), ["red", "small,ring", "blue bolt"], out)
    return s.read.schema("id int").csv(f"{out}/ids")


@round_trip
def sequence_store_files(s, d):
    """Sequences named by gene id, stored by number."""
    out = scratch(s)
    genes = _dna(s, d).select("id", F.lit("x").alias("ref"), F.lit(0).alias("gstart"), F.lit(1).alias("gend"), F.lit("+").alias("ori"), F.lit("y").alias("description"), F.concat(F.lit("D"), F.col("id").cast("string")).alias("gene_id"))
    fasta = _put(writers.fasta_lines(_dna(s, d).select(F.concat(F.lit("D"), F.col("id").cast("string")).alias("name"), "seq"), "name", "seq"), f"{out}/x.fa")
    files.sequence_store(s, fasta, out, descriptions=_put(writers.description_lines(genes), f"{out}/genes"))
    return s.read.parquet(f"{out}/sequences")


@round_trip
def sequence_graph_files(s, d):
    """Segments and links of the graph of all families, each family in a folder of its own."""
    out = scratch(s)
    rows = D.msa(s, d)
    line = F.concat(F.lit(">"), F.col("seqname").cast("string"), F.lit("\n"), F.coalesce("aligned", F.lit("")))
    with cleaned(s):
        rows.select("gene_id", line.alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", 1 << 13).partitionBy("gene_id").text(f"{out}/msa")
    families = [r.gene_id for r in s.read.text(f"{out}/msa").select("gene_id").distinct().collect()]
    files.sequence_graph(s, {k: f"{out}/msa/gene_id={k}" for k in families}, out, compression="gzip")
    return formats.read_lines(s, f"{out}/graph.gfa").where(F.substring("value", 1, 1).isin("S", "L")).select("value")


@round_trip
def alignment_metrics_files(s, d):
    """The lines of the six reports."""
    out = scratch(s)
    reads = s.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("name"), F.repeat(F.lit("A"), F.lit(1300)).alias("seq"))
    files.alignment_metrics(s, _put(writers.fasta_lines(reads, "name", "seq"), f"{out}/reads.fa", "lz4", 1 << 17), _paf(s, d, f"{out}/x.paf"), f"{out}/reports", compression="lz4")
    found = None
    for name in ("read_length", "alignment_sizes", "breakpoints", "multimapping", "unmapped_reads", "unaligned"):
        table = s.read.option("sep", "\t").option("header", True).csv(f"{out}/reports/{name}")
        rows = table.select(F.lit(name).alias("report"), _tabbed(*table.columns))
        found = rows if found is None else found.unionByName(rows)
    return found


def _genbank(s: SparkSession, d: str) -> str:
    """A record of every sequence, with a gene at a place of one of eight forms; shorter than four bases: all of it; none on an empty one."""
    out, n, name = scratch(s), F.length("seq"), F.col("id").cast("string")
    a, b, c = ((1 + F.floor(n * k / 4)).cast("string") for k in (1, 2, 3))
    end = n.cast("string")
    forms = [[a, "..", c], ["complement(", a, "..", c, ")"], ["join(", c, "..", end, ",1..", a, ")"], ["complement(join(", a, "..", b, ",order(", c, "..", end, ")))"]]
    forms += [["join(complement(", c, "..", end, "),complement(", a, "..", b, "))"], ["join(X00001.1:5..9,", a, "..", c, ")"], ["join(<", a, "..(", b, ".", c, "),", c, "..>", end, ")"], ["order(one-of(", a, ",", b, ")..", b, ",complement(", c, "^", end, "))"]]
    place = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        place = F.when(F.col("id") % 8 == k, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in form])).otherwise(place)
    place = F.when(n < 4, F.concat(F.lit("1.."), end)).otherwise(place)
    mark = "\n" + " " * 21
    gene = F.when(n > 0, F.concat(F.lit("     CDS             "), place, F.lit(mark + '/product="p '), name, F.lit('"' + mark + '/translation="MK' + mark + 'L"\n'))).otherwise(F.lit(""))
    record = F.concat(F.lit("LOCUS       D"), name, F.lit("   "), end, F.lit(" bp\nFEATURES             Location/Qualifiers\n"), gene, F.lit("ORIGIN\n        1 "), F.col("seq"), F.lit("\n//"))
    files.genbank_converter(s, _put(_dna(s, d).select(record.alias("value")), f"{out}/x.gb"), out)
    return out


@round_trip
def genbank_gene_files(s, d):
    return formats.read_lines(s, f"{_genbank(s, d)}/genes.gff").select("value")


@round_trip
def genbank_sequence_files(s, d):
    return formats.read_fasta(s, f"{_genbank(s, d)}/sequences.fasta")


@round_trip
def genbank_protein_files(s, d):
    return formats.read_fasta(s, f"{_genbank(s, d)}/proteins.fasta")
