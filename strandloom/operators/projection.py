"""Genes projected onto alignments, syntenic anchors, and annotations inside windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import coverage, rescale
from .intervals import overlap_join


def project_genes(aln: DataFrame, genes: DataFrame, width: int = 512) -> DataFrame:
    """Alignment columns with g_id, g_start, g_end, g_ori of every gene that overlaps [rstart, rend + 1) on its reference.

    ``width``, that of a bin, is best near the size of a gene: an alignment is then sent about as often as it has genes.
    """
    g = genes.select(F.col("ref").alias("g_ref"), F.col("id").alias("g_id"), F.col("gstart").alias("g_start"), F.col("gend").alias("g_end"), F.col("ori").alias("g_ori"))
    joined = overlap_join(aln, g, ("rname", "g_ref"), (F.col("rstart"), F.col("rend") + 1), (F.col("g_start"), F.col("g_end")), width)
    return joined.drop("g_ref")


def boundary_filter(projected: DataFrame, by: list[str], start: str, end: str, min_coverage: float = 0.5) -> DataFrame:
    """Drops the first and the last gene of each alignment if it is covered too little; inner genes stay."""
    order = Window.partitionBy(*by).orderBy("g_start", "g_end", "g_id")
    share = coverage(F.col("g_start"), F.col("g_end"), F.col(start), F.col(end))
    ranked = projected.withColumns({"_before": F.lag("g_id").over(order), "_after": F.lead("g_id").over(order), "_share": share})
    at_end = F.col("_before").isNull() | F.col("_after").isNull()
    return ranked.where(~(at_end & (F.col("_share") < min_coverage))).drop("_before", "_after", "_share")


def project_genes_filtered(aln: DataFrame, genes: DataFrame, min_coverage: float = 0.5, by: str = "line_no", width: int = 512) -> DataFrame:
    """project_genes, then boundary_filter over the window [rstart, rend + 1)."""
    projected = project_genes(aln, genes, width).withColumn("_end", F.col("rend") + 1)
    return boundary_filter(projected, [by], "rstart", "_end", min_coverage).drop("_end")


def syntenic_anchors(aln: DataFrame, genes: DataFrame, min_coverage: float = 0.5, same_orientation: bool = False) -> DataFrame:
    """line_no, q_id, g_id: genes of the query sequence and the genes of the reference at their projected place.

    aln names its query sequence in ``qref``; coordinates of both sides are on their sequences.
    """
    g = genes.select(F.col("ref").alias("g_ref"), F.col("id").alias("g_id"), F.col("gstart").alias("g_start"), F.col("gend").alias("g_end"), F.col("ori").alias("g_ori"))
    own = overlap_join(aln, g, ("qref", "g_ref"), (F.col("qstart"), F.col("qend")), (F.col("g_start"), F.col("g_end")))
    own = boundary_filter(own, ["line_no"], "qstart", "qend", min_coverage)

    def placed(x: str):
        return rescale(F.col("rstart"), F.col("rend"), F.col("qstart"), F.col("qend"), F.col(x))

    moved = own.select("line_no", "rname", F.col("g_id").alias("q_id"), F.col("g_ori").alias("q_ori"), placed("g_start").alias("p_start"), placed("g_end").alias("p_end"))
    there = overlap_join(moved, g, ("rname", "g_ref"), (F.col("p_start"), F.col("p_end")), (F.col("g_start"), F.col("g_end")))
    anchors = boundary_filter(there, ["line_no", "q_id"], "p_start", "p_end", min_coverage)
    if same_orientation:
        odd = F.max((F.col("g_ori") != F.col("q_ori")).cast("int")).over(Window.partitionBy("line_no", "q_id"))
        anchors = anchors.withColumn("_odd", odd).where("_odd = 0")
    return anchors.select("line_no", "q_id", "g_id")


def contained(genes: DataFrame, windows: DataFrame, width: int = 4096) -> DataFrame:
    """Genes that lie inside a window of their sequence (the window's end plus one counts), with wstart and wend.

    Windows are dealt to every bin they touch with that end, genes to the bin of their start.
    """
    bins = F.explode(F.sequence(F.floor(F.col("wstart") / width), F.floor((F.col("wend") + 1) / width)))
    w = windows.select(F.col("ref").alias("w_ref"), "wstart", "wend", bins.alias("_bin"))
    g = genes.withColumn("_gbin", F.floor(F.col("gstart") / width))
    inside = (F.col("wstart") <= F.col("gstart")) & (F.col("wend") + 1 >= F.col("gend"))
    return g.join(w, (F.col("ref") == F.col("w_ref")) & (F.col("_gbin") == F.col("_bin")) & inside).drop("w_ref", "_bin", "_gbin")


def oriented_steps(projected: DataFrame, name: str = "qname") -> DataFrame:
    """name, pos, id, ori: the genes of each read in read order; an alignment on '-' is read backwards, its genes flipped."""
    forward = F.col("ori") == "+"
    step = F.when(forward, F.col("g_start")).otherwise(-F.col("g_end"))
    order = Window.partitionBy(name).orderBy("qstart", "qend", "line_no", step, F.when(forward, F.col("g_id")).otherwise(-F.col("g_id")))
    turned = F.when(forward, F.col("g_ori")).otherwise(F.when(F.col("g_ori") == "+", "-").otherwise("+"))
    return projected.select(F.col(name).alias("name"), (F.row_number().over(order) - 1).alias("pos"), F.col("g_id").alias("id"), turned.alias("ori"))
