"""Registered queries: every operator applied to the domain frames of a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import paths as P
from ..functions import sequences as S
from ..operators import alignments as A
from ..operators import architectures as R
from ..operators import graph as G
from ..operators import intervals as N
from ..operators import projection as J
from ..operators import residues as Q
from ..operators import text as T
from ..operators.components import connected_components
from ..operators.numbering import number_rows
from ..sources import adapters as D
from ..sources import formats, writers
from ..storage import materialize
from . import commands
from .round_trips import ROUND_TRIPS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEY_LINES = ["red", "small,ring", "blue bolt"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _kept(s: SparkSession, d: str) -> DataFrame:
    return D.alignments(s, d).where("mapq >= 10")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return G.across_references(G.homology_pairs(D.homology(s, d, placed=True)), D.genes(s, d)).drop(*D.CELL)


# Filters


@query
def paf_mapq_filter(s, d):
    return _kept(s, d)


@query
def gff_feature_filter(s, d):
    """Genes rendered as GFF3 lines, parsed again, CDS features only."""
    return formats.parse_gff(writers.gff_lines(D.genes(s, d), feature=F.when(F.col("id") % 3 == 0, "exon").otherwise("CDS")), features=["CDS"]).select("ref", "gstart", "gend", "ori", "description", "gene_id")


@query
def gff_parse(s, d):
    lines = writers.gff_lines(D.genes(s, d)).unionByName(s.createDataFrame([("# a comment",), ("short\trow",)], "value string"))
    return formats.parse_gff(lines).select("ref", "gstart", "gend", "ori", "description", "gene_id")


@query
def paf_parse(s, d):
    return formats.parse_paf(writers.paf_lines(D.alignments(s, d)))


@query
def blast_parse(s, d):
    return formats.parse_blast(writers.blast_lines(D.homology(s, d)))


@query
def homology_pair_filter(s, d):
    return G.homology_pairs(D.homology(s, d))


@query
def homology_pair_filter_dna(s, d):
    return G.homology_pairs(D.homology(s, d), max_eval=None, min_bitscore=None)


@query
def homology_cross_ref(s, d):
    return _pairs(s, d)


@query
def homology_split_ori(s, d):
    return G.across_references(G.homology_pairs(D.homology(s, d, placed=True)), D.genes(s, d), same_orientation=True).drop(*D.CELL)


@query
def exclude_sequences(s, d):
    out = s.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 10 = 0").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("qname"))
    return _kept(s, d).join(out, "qname", "left_anti").select("line_no", "qname")


@query
def boundary_cov_filter(s, d):
    kept = J.project_genes_filtered(_kept(s, d), D.genes(s, d), min_coverage=0.75)
    return kept.groupBy("rname").agg(F.count("*").alias("n"), F.sum("g_id").alias("sum_id"))


@query
def path_min_length(s, d):
    return R.gathered(D.read_steps(s, d)).withColumn("size", F.size("path")).where("size >= 3").select("name", P.rendered(F.col("path")).alias("path"), "size")


@query
def keyword_match(s, d):
    return T.keyword_match(D.genes(s, d), KEY_LINES)


@query
def keyword_match_mapped(s, d):
    families = G.families(_pairs(s, d)).select(F.col("id").alias("old"), F.col("canonical").alias("new"))
    return T.remapped(T.keyword_match(D.genes(s, d), KEY_LINES).select("id"), families)


@query
def generate_labels(s, d):
    """The label edges of every path; files.generate_labels takes the names of some."""
    return T.label_edges(R.gathered(D.read_steps(s, d)).select("name", P.rendered(F.col("path")).alias("path")))


@query
def unmapped_reads(s, d):
    reads = s.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("qname"))
    return reads.join(_kept(s, d), "qname", "left_anti")


@query
def first_orientation(s, d):
    pairs = D.homology(s, d, placed=True, held=True)
    within = [c for c in D.CELL if c in pairs.columns]
    both = F.inline(F.array(F.struct("ori", "bitscore"), F.struct(F.lit("*").alias("ori"), (F.col("bitscore") + 1000).alias("bitscore"))))
    return G.first_orientation(pairs.select("q", "r", *within, both), "bitscore", within)


# Joins


@query
def project_genes(s, d):
    return J.project_genes(_kept(s, d), D.genes(s, d)).select("line_no", "g_id")


@query
def project_genes_filtered(s, d):
    return J.project_genes_filtered(_kept(s, d), D.genes(s, d)).select("line_no", "g_id")


@query
def syntenic_anchors(s, d):
    return J.syntenic_anchors(_between_references(s, d), D.genes(s, d))


@query
def syntenic_anchors_same_ori(s, d):
    return J.syntenic_anchors(_between_references(s, d), D.genes(s, d), same_orientation=True)


def _between_references(s: SparkSession, d: str) -> DataFrame:
    """Alignments of a brand's sequence to another brand's, at the read's place: one from every gene."""
    own = D.genes(s, d).select(F.col("id").alias("k"), F.col("ref").alias("qref"), F.col("gstart").alias("qstart"), (F.col("gstart") + 200).alias("qend"))
    there = D.genes(s, d).select((F.col("id") - 25).alias("k"), F.col("ref").alias("rname"), F.col("gstart").alias("rstart"), (F.col("gstart") + 210).alias("rend"))
    return own.join(there, "k").where("qref <> rname").withColumnRenamed("k", "line_no")


@query
def gff_contained(s, d):
    return J.contained(D.genes(s, d), D.fetch_windows(s, d)).select("id", "ref", "wstart", "wend")


@query
def gff_contained_normalized(s, d):
    c = J.contained(D.genes(s, d), D.fetch_windows(s, d))
    return c.select("id", F.concat_ws("_", "ref", F.col("wstart").cast("string"), F.col("wend").cast("string")).alias("name"), (F.col("gstart") - F.col("wstart")).alias("gstart"), (F.col("gend") - F.col("wstart")).alias("gend"))


@query
def multimapping_report(s, d):
    return A.multimapping_report(_kept(s, d))


@query
def pair_orientation(s, d):
    pairs = D.homology(s, d, placed=True, held=True)
    within = [c for c in D.CELL if c in pairs.columns]
    known = pairs.where("bitscore < 80").select(F.col("r").alias("q"), F.col("q").alias("r"), *within, "ori")
    return G.pair_orientation(pairs.select("q", "r", *within), known, within)


@query
def all_pairwise(s, d):
    return R.all_pairwise(D.genes(s, d), "ref")


@query
def multimap_intervals(s, d):
    return A.multimap_intervals(_kept(s, d))


@query
def family_sequences(s, d):
    families = s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").cast("int").alias("id"), (F.col("doc_id") % 7).cast("int").alias("family_no"))
    return families.join(D.dna(s, d).select("id", "seq"), "id").select("family_no", "id", F.length("seq").alias("n"), "seq")


# Aggregations


@query
def node_coverage(s, d):
    return G.node_coverage(D.read_steps(s, d))


@query
def edge_coverage_directed(s, d):
    return G.edge_coverage(D.read_steps(s, d))


@query
def edge_coverage_undirected(s, d):
    return G.edge_coverage(D.read_steps(s, d), directed=False)


@query
def gene_graph_edges(s, d):
    return G.graph_edges(D.read_steps(s, d))


@query
def gene_graph_edges_undirected(s, d):
    return G.graph_edges(D.read_steps(s, d), directed=False)


@query
def gene_graph_nodes(s, d):
    return G.graph_nodes(D.read_steps(s, d))


@query
def graph_totals(s, d):
    return G.graph_totals(D.read_steps(s, d))


@query
def homology_graph(s, d):
    return G.homology_graph(_pairs(s, d), once=D.parts_once(s, d))


@query
def connected_components_sizes(s, d):
    found = connected_components(_pairs(s, d), "q", "r", contract=True)
    return found.groupBy("component").agg(F.count("*").alias("n"))


@query
def canonical_ids(s, d):
    return G.families(_pairs(s, d))


QUERIES["connected_components"] = canonical_ids


@query
def homology_connectivity(s, d):
    pairs = _pairs(s, d)
    return G.homology_connectivity(pairs, G.families(pairs), once=D.parts_once(s, d)).select("id", F.round("n_degree", 6).alias("n_degree"), "cc_size")


@query
def cc_summary(s, d):
    sizes = G.families(_pairs(s, d)).groupBy("canonical").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_components"), F.round(F.avg("n"), 6).alias("mean_size"))


@query
def genome_paths(s, d):
    return G.genome_steps(D.genes(s, d), G.families(_pairs(s, d)))


@query
def path_architectures(s, d):
    return R.architectures(R.canonical_paths(R.gathered(D.read_steps(s, d))))


@query
def path_architecture_names(s, d):
    """All paths of the architectures of path_architectures."""
    canonical = R.canonical_paths(R.gathered(D.read_steps(s, d)))
    return R.architecture_names(canonical, R.architectures(canonical))


@query
def edge_labels(s, d):
    return G.edge_labels(D.read_steps(s, d))


@query
def seq_node_coverage(s, d):
    return Q.seq_node_coverage(Q.msa_nodes(D.msa(s, d)))


@query
def seq_edge_coverage(s, d):
    return Q.msa_edge_coverage(D.msa(s, d))


@query
def seq_lengths(s, d):
    return D.dna(s, d).select("id", F.length("seq").alias("n"))


@query
def genome_sizes(s, d):
    return D.dna(s, d).groupBy("family").agg(F.sum(F.length("seq").cast("bigint")).alias("size")).orderBy(F.desc("size"), "family")


@query
def mapped_pct(s, d):
    reads = s.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("qname"))
    return commands.mapped_pct(D.alignments(s, d), reads)


# Ordered sequences


@query
def path_edges(s, d):
    return G.path_edges(D.read_steps(s, d))


@query
def merged_intervals(s, d):
    return N.merged_intervals(_kept(s, d), "qname", "qstart", "qend")


@query
def breakpoint_clusters(s, d):
    ends = _kept(s, d).select("qname", F.explode(F.array("qstart", "qend")).alias("value"))
    return N.value_clusters(ends, ["qname"], "value", 20)


@query
def multimap_clusters(s, d):
    return A.multimap_clusters(_kept(s, d))


@query
def paf_read_groups(s, d):
    kept = number_rows(_kept(s, d).select("qname", "line_no"), ["line_no"], "rank")
    return A.read_groups(kept, consecutive=True)


@query
def unaligned_regions(s, d):
    return N.unaligned_regions(_kept(s, d), "qname", "qstart", "qend", "query_length")


@query
def alignment_breakpoints(s, d):
    return A.alignment_breakpoints(_kept(s, d))


@query
def multimap_fraction(s, d):
    return A.multimap_runs(_kept(s, d), 0.3)


@query
def canonical_regions(s, d):
    return A.canonical_regions(_kept(s, d))


@query
def assign_gene_ids(s, d):
    return number_rows(D.genes(s, d).select("ref", "gstart", "gend", "gene_id"), ["ref", "gstart", "gend", "gene_id"], "number")


# Scalars


@query
def alignment_sizes(s, d):
    share = I.size(F.col("qstart"), F.col("qend")) / F.col("query_length").cast("double")
    return _kept(s, d).select("line_no", "qname", "rname", "rstart", "rend", I.size(F.col("rstart"), F.col("rend")).alias("size"), "mapq", F.round(share, 2).alias("align_cov"))


@query
def interval_algebra(s, d):
    a = D.alignments(s, d)
    q, r = (F.col("qstart"), F.col("qend")), (F.col("rstart"), F.col("rend"))
    return a.select("line_no", I.size(*q).alias("size"), I.overlap(*q, *r).alias("overlap"), I.contains(*q, *r).alias("contains"), F.round(I.coverage(*q, *r), 6).alias("coverage"))


@query
def normalize_position(s, d):
    return D.alignments(s, d).select("line_no", I.rescale(F.col("rstart"), F.col("rend"), F.col("qstart"), F.col("qend"), F.col("qstart") + F.col("mapq")).alias("position"))


@query
def orient_paths(s, d):
    return R.gathered(D.read_steps(s, d)).select("name", P.rendered(P.reversed_path(F.col("path"))).alias("path"))


@query
def canonical_path(s, d):
    return R.canonical_paths(R.gathered(D.read_steps(s, d))).select("name", P.rendered(F.col("path")).alias("path"))


def _id_paths(s: SparkSession, d: str) -> DataFrame:
    """Distinct id sequences, numbered by their rendering."""
    ids = R.gathered(D.read_steps(s, d)).select(P.ids(F.col("path")).alias("ids")).distinct()
    named = ids.select(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("rendered"), "ids")
    return materialize(number_rows(named, ["rendered"], "id").select("id", "ids"))


@query
def path_edit_distance(s, d):
    return R.path_distances(_id_paths(s, d), both=True, only="edits")


def _norm_distances(named: DataFrame) -> DataFrame:
    return R.path_distances(named, both=True, digits=6, only="distance")


@query
def path_norm_distance(s, d):
    return _norm_distances(_id_paths(s, d))


@query
def path_distance_matrix(s, d):
    """Every id sequence against all, itself too."""
    named = _id_paths(s, d)
    return _norm_distances(named).unionByName(named.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance")))


@query
def reverse_complement(s, d):
    return D.dna(s, d).select("id", S.reverse_complement(F.col("seq")).alias("seq"))


@query
def dna2protein(s, d):
    return D.dna(s, d).select("id", S.protein(F.col("seq")).alias("protein"))


@query
def fetch_subsequences(s, d):
    """Windows of 25 bases over the whole of every sequence, the last one read round the end; a shorter sequence is one window."""
    n = F.length("seq")
    starts = D.dna(s, d).where(n > 0).select("id", "seq", F.explode(F.sequence(F.lit(0), n - 1, F.lit(25))).alias("start"))
    return starts.select("id", "start", S.subsequence(F.col("seq"), F.col("start"), F.col("start") + F.least(F.lit(25), n)).alias("seq"))


@query
def extract_genes(s, d):
    """Genes end to end over the whole of every sequence."""
    wanted = D.gene_spans(s, d).select(F.concat_ws("_", F.col("seq_key").cast("string"), F.col("gstart").cast("string")).alias("id"), "seq_key", "gstart", "gend", "ori")
    return Q.extract_genes(wanted, D.dna(s, d).select(F.col("id").alias("seq_key"), "seq"))


@query
def msa_nodes(s, d):
    return Q.msa_nodes(D.msa(s, d))


@query
def gfa_to_csv(s, d):
    """The gene graph written as GFA lines, read back as weighted nodes."""
    lines = writers.gfa_segments(G.node_coverage(D.read_steps(s, d)))
    return formats.gfa_node_table(lines).select("id", "weight", "label")


@query
def gfa_edges_to_csv(s, d):
    return formats.gfa_edge_table(writers.gfa_links(G.edge_coverage(D.read_steps(s, d))))


@query
def gfa_paths(s, d):
    """Paths written as GFA lines and parsed back into steps."""
    paths = R.gathered(D.read_steps(s, d)).select("name", "path", F.size("path").alias("size"))
    return formats.parse_gfa_paths(writers.gfa_paths(paths)).select("name", P.rendered(F.col("path")).alias("path"), "size")


# Commands


@query
def graph_alignment_edges(s, d):
    return commands.graph_alignment(D.alignments(s, d), D.genes(s, d)).edges


@query
def graph_alignment_as_is(s, d):
    return commands.graph_alignment(D.alignments(s, d), D.genes(s, d), min_multimap=0).edges


@query
def graph_family_edges(s, d):
    return commands.graph_family(D.homology(s, d, placed=True), D.genes(s, d)).edges


@query
def whole_genome_graph(s, d):
    return commands.whole_genome_graph(D.genes(s, d), _pairs(s, d))


@query
def native_gene_graph(s, d):
    return commands.native_graph(D.genes(s, d))


QUERIES.update(ROUND_TRIPS)
