"""The toolkit's commands as functions of frames, with the defaults of the command line they replace."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import size
from ..operators import alignments as A
from ..operators import architectures as R
from ..operators import graph as G
from ..operators import intervals as N
from ..operators import projection as J
from ..operators import residues as Q
from ..sources import writers
from ..storage import deal_by, materialize


@dataclass
class Graph:
    """steps: name, pos, id, ori; nodes: id, coverage; edges: src, dst, coverage; links: the edges without what a graph leaves out."""

    steps: DataFrame
    nodes: DataFrame
    edges: DataFrame
    links: DataFrame
    paths: DataFrame | None = None  # name, path, where they are at hand

    def gfa(self, header: str = "Gene-graph", paths: DataFrame | None = None) -> DataFrame:
        """The graph's GFA lines with ``section`` and ``rank`` to order them by."""
        return writers.gfa_graph(header, self.nodes, self.links, paths if paths is not None else R.gathered(self.steps).select("name", "path", F.size("path").alias("size")))


def _graph(steps: DataFrame, directed: bool) -> Graph:
    edges = G.edge_coverage(steps, directed)
    return Graph(steps, G.node_coverage(steps), edges, edges.where("src <> dst") if directed else edges)


def _graph_of_paths(paths: DataFrame) -> Graph:
    """The directed graph of gathered paths (name, path)."""
    steps = paths.select("name", F.posexplode("path").alias("pos", "_s")).select("name", "pos", "_s.id", "_s.ori")
    edges = G.edge_coverage_of_paths(paths)
    return Graph(steps, G.node_coverage(steps), edges, edges.where("src <> dst"), paths)


def graph_alignment(aln: DataFrame, genes: DataFrame, *, min_mapq: int = 10, min_multimap: int = 100, min_dist: int = 100, min_alignment_cov: float = 0.5, exclude: DataFrame | None = None) -> Graph:
    """The directed gene graph of reads: genes projected onto uniquely mapped intervals, in read order.

    min_multimap below 1 takes alignments as they are. exclude: qname. The intervals are written, as the join with genes looks at them
    twice; and the paths, that nodes, edges and paths are read from.
    """
    kept = aln.where(F.col("mapq") >= min_mapq)
    if exclude is not None:
        kept = kept.join(exclude, "qname", "left_anti")
    if min_multimap >= 1:
        cells = A.multimap_intervals(kept, min_multimap, min_dist).where("n_aln = 1 and rstart is not null and rend is not null")
        kept = cells.select("qname", F.col("istart").alias("qstart"), F.col("iend").alias("qend"), "line_no", "ori", "rname", "rstart", "rend")
        by = ["qname", "line_no", "qstart"]
    else:
        by = ["qname", "line_no"]
    kept = materialize(kept.select("qname", "line_no", "qstart", "qend", "ori", "rname", "rstart", "rend"))
    # Dealt by read once: the windows over its alignments, over its steps and the paths follow from there.
    projected = deal_by(J.project_genes(kept, genes), "qname").withColumn("_end", F.col("rend") + 1)
    return _graph_of_paths(materialize(R.gathered(J.oriented_steps(J.boundary_filter(projected, by, "rstart", "_end", min_alignment_cov)))))


def homologous(pairs: DataFrame, genes: DataFrame, *, min_cov: float = 0.75, min_eval: float = 1e-6, min_bitscore: float = 50.0, protein: bool = True, split_ori: bool = False, orientations: DataFrame | None = None) -> DataFrame:
    """The pairs that make families. orientations (q, r, ori), of DNA alignments, stand for those of protein alignments where split_ori asks."""
    kept = G.homology_pairs(pairs, min_cov=min_cov, max_eval=min_eval if protein else None, min_bitscore=min_bitscore if protein else None)
    if split_ori and orientations is not None:
        kept = G.pair_orientation(kept, orientations).withColumn("ori", F.col("known")).select(pairs.columns)
    return G.across_references(kept, genes, split_ori)


def family_graph(genes: DataFrame, members: DataFrame) -> Graph:
    """The undirected graph of families (id, canonical) along each reference."""
    return _graph(G.genome_steps(genes, members), directed=False)


def graph_family(pairs: DataFrame, genes: DataFrame, **options) -> Graph:
    """The undirected graph of gene families along each reference; options as homologous has them."""
    return family_graph(genes, G.families(homologous(pairs, genes, **options)))


def path_metrics(paths: DataFrame, *, min_length: int = 1) -> DataFrame:
    """id, path, single_ori, n, first_name of the architectures of paths (name, path, size)."""
    return R.architectures(R.canonical_paths(paths, min_length))


def path_names(paths: DataFrame, metrics: DataFrame, *, min_length: int = 1) -> DataFrame:
    """id, name: all paths of each architecture that path_metrics gave with the same min_length."""
    return R.architecture_names(R.canonical_paths(paths, min_length), metrics)


def alignment_metrics(aln: DataFrame, reads: DataFrame, *, min_mapq: int = 10, min_clipping: int = 300) -> dict[str, DataFrame]:
    """The six reports. reads: qname, length."""
    kept = aln.where(F.col("mapq") >= min_mapq).drop("query_length").join(reads.withColumnRenamed("length", "query_length"), "qname")
    share = size(F.col("qstart"), F.col("qend")) / F.nullif(F.col("query_length"), F.lit(0)).cast("double")
    return {
        "read_length": reads,
        "alignment_sizes": kept.select("qname", "rname", "rstart", "rend", size(F.col("rstart"), F.col("rend")).alias("size"), "mapq", F.round(share, 2).alias("align_cov")),
        "breakpoints": A.alignment_breakpoints(kept, min_clipping),
        "multimapping": A.multimapping_report(kept),
        "unmapped_reads": reads.join(kept, "qname", "left_anti"),
        "unaligned": N.unaligned_regions(kept, "qname", "qstart", "qend", "query_length"),
    }


def mapped_pct(aln: DataFrame, reads: DataFrame, *, min_mapq: int = 10) -> DataFrame:
    """pct: how many in a hundred of the reads have an alignment that is kept; one row, null without reads."""
    mapped = aln.where(F.col("mapq") >= min_mapq).agg(F.countDistinct("qname").alias("m"))
    return reads.agg(F.count("*").alias("n")).crossJoin(mapped).select(F.round(F.col("m") / F.nullif(F.col("n"), F.lit(0)) * 100, 6).alias("pct"))  # one row each


def sequence_graph(msa: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the residue graph of aligned families."""
    return Q.seq_node_coverage(Q.msa_nodes(msa)), Q.msa_edge_coverage(msa)


def whole_genome_graph(genes: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst: the undirected graph along references after ids become families; of a family's repeats on a reference, the first counts."""
    steps = G.genome_steps(genes, G.families(pairs))
    seen = F.row_number().over(Window.partitionBy("name", "id").orderBy("pos"))
    once = steps.withColumn("_k", seen).where("_k = 1").select("name", "pos", "id", F.lit("+").alias("ori"))
    return G.graph_edges(once, directed=False)


def native_graph(genes: DataFrame) -> DataFrame:
    """src, dst: neighbours along each reference, both ways."""
    order = Window.partitionBy("ref").orderBy("gstart", "gend", "id")
    steps = genes.select(F.col("ref").alias("name"), (F.row_number().over(order) - 1).alias("pos"), "id", "ori")
    return G.graph_edges(steps, directed=False)
