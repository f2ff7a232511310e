"""Alignments of a read: multi-mapping clusters and grids, breakpoints, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import overlap, rescale, size
from ..storage import deal_by
from .intervals import chained_islands


def with_clusters(aln: DataFrame, min_overlap: int = 100) -> DataFrame:
    """aln with ``cluster``: alignments in query order join the current cluster as long as one of its members overlaps them enough.

    A closed cluster is forgotten, so what matters of the current one is its largest end. An alignment shorter than
    min_overlap always opens a cluster, whatever was before. From there to the next such one, an alignment that opens a
    cluster ends beyond all before it, so that the running maximum of ends is the current cluster's: two windows will do.
    """
    order = ["qstart", "qend", F.desc("line_no")]
    short = F.col("qend") - F.col("qstart") < min_overlap
    running = Window.partitionBy("qname").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parted = deal_by(aln, "qname").withColumn("_part", F.sum(short.cast("int")).over(running))
    reach = F.max("qend").over(Window.partitionBy("qname", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    opens = short | F.coalesce(reach - F.col("qstart") < min_overlap, F.lit(True))
    opened = parted.withColumn("_opens", opens.cast("int"))
    return opened.withColumn("cluster", (F.sum("_opens").over(running) - 1).cast("int")).drop("_part", "_opens")


def multimap_clusters(aln: DataFrame, min_overlap: int = 100) -> DataFrame:
    """qname, line_no, cluster"""
    return with_clusters(aln.select("qname", "qstart", "qend", "line_no"), min_overlap).select("qname", "line_no", "cluster")


def multimap_intervals(aln: DataFrame, min_overlap: int = 100, max_dist: int = 100) -> DataFrame:
    """qname, cluster, istart, iend, line_no, ori, rname, rstart, rend, n_aln: the grid between canonical breakpoints of each
    cluster of two or more alignments, with the alignments that reach into each cell and their projected coordinates;
    a cluster of one alignment is its own cell.

    Breakpoints of a cluster are numbered in order, and cell k lies between k and k + 1. Each alignment is sent to its cells, each
    breakpoint to the two cells it bounds, and they meet in a window: all windows are within reads, so reads are shuffled once.
    """
    keys = ["qname", "cluster"]
    own = ["line_no", "qstart", "qend", "ori", "rname", "rstart", "rend"]
    placed = with_clusters(aln.select("qname", *own), min_overlap)
    sized = placed.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    ends = F.explode(F.array(F.struct(F.col("qstart").alias("value"), F.lit(True).alias("first")), F.struct(F.col("qend").alias("value"), F.lit(False).alias("first"))))
    points = sized.withColumn("_p", ends).select(*keys, *own, "_n", "_p.*")
    # Breakpoints by single linkage, as value_clusters has them.
    order = Window.partitionBy(*keys).orderBy("value")
    apart = F.coalesce(F.col("value") - F.lag("value").over(order) > max_dist, F.lit(True))
    linked = points.withColumn("_new", apart.cast("int"))
    linked = linked.withColumn("_k", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = Window.partitionBy(*keys, "_k")
    mean = (F.sum(F.col("value").cast("bigint")).over(whole) / F.count("*").over(whole)).cast("int")
    known = linked.withColumn("_canonical", mean)
    alignment = Window.partitionBy(*keys, "line_no")
    known = known.withColumns({"_from": F.min(F.when(F.col("first"), F.col("_k"))).over(alignment), "_to": F.max(F.when(~F.col("first"), F.col("_k"))).over(alignment)})
    one = F.struct(*own)
    nothing = F.lit(None).cast("bigint")
    none = F.lit(None).cast("struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in aln.select(*own).schema) + ">")
    point = F.col("_canonical").cast("bigint")
    bounds = F.when(F.col("_new") == 1, F.array(F.struct(F.col("_k").alias("k"), point.alias("at"), nothing.alias("end"), none.alias("a")), F.struct((F.col("_k") - 1).alias("k"), nothing.alias("at"), point.alias("end"), none.alias("a"))))
    cells = F.when(F.col("first") & (F.col("_from") < F.col("_to")), F.transform(F.sequence(F.col("_from"), F.col("_to") - 1), lambda k: F.struct(k.alias("k"), nothing.alias("at"), nothing.alias("end"), one.alias("a"))))
    alone = F.when((F.col("_n") == 1) & F.col("first"), F.array(F.struct(F.lit(0).cast("bigint").alias("k"), F.col("qstart").cast("bigint").alias("at"), F.col("qend").cast("bigint").alias("end"), one.alias("a"))))
    parts = F.when(F.col("_n") == 1, F.array(alone)).otherwise(F.array(bounds, cells))
    sent = known.select(*keys, "_n", F.explode(F.flatten(F.filter(parts, lambda x: x.isNotNull()))).alias("_c")).select(*keys, "_n", "_c.*")
    cell = Window.partitionBy(*keys, "k")
    met = sent.withColumns({"istart": F.max("at").over(cell).cast("int"), "iend": F.max("end").over(cell).cast("int"), "n_aln": F.count("a").over(cell)}).where("a is not null").select(*keys, "_n", "istart", "iend", "n_aln", "a.*")

    def at(x: str, whole: str) -> Column:
        return F.when(F.col("_n") == 1, F.col(whole)).otherwise(rescale(F.col("rstart"), F.col("rend"), F.col("qstart"), F.col("qend"), F.col(x))).alias(whole)

    return met.select(*keys, "istart", "iend", "line_no", "ori", "rname", at("istart", "rstart"), at("iend", "rend"), "n_aln")


def _turned(first: bool) -> Column:
    """The reference coordinate at the alignment's first or last base, seen along the read."""
    a, b = ("rstart", "rend") if first else ("rend", "rstart")
    return F.when(F.col("ori") == "+", F.col(a)).otherwise(F.col(b))


def alignment_breakpoints(aln: DataFrame, min_clip: int = 300) -> DataFrame:
    """qname, ref, position: where the read leaves its reference, at clipped ends and between adjacent alignments."""
    order = Window.partitionBy("qname").orderBy("qstart", "qend", F.desc("line_no"))
    seen = aln.select("qname", "rname", _turned(True).alias("a"), _turned(False).alias("b"), F.lag("line_no").over(order).alias("_before"), F.lead("line_no").over(order).alias("_after"))
    inner = seen.select("qname", F.explode(F.filter(F.array(
        F.when(F.col("_before").isNotNull(), F.struct(F.col("rname").alias("ref"), F.col("a").alias("position"))),
        F.when(F.col("_after").isNotNull(), F.struct(F.col("rname").alias("ref"), F.col("b").alias("position"))),
    ), lambda x: x.isNotNull())).alias("p")).select("qname", "p.*")
    tie = -F.col("line_no")
    ends = aln.groupBy("qname").agg(
        F.min_by(F.struct("rname", _turned(True).alias("at"), "qstart"), F.struct("qstart", "qend", tie)).alias("l"),
        F.max_by(F.struct("rname", _turned(False).alias("at"), "qend"), F.struct(F.col("qend"), -F.col("qstart"), F.col("line_no"))).alias("r"),
        F.max("query_length").alias("n"),
    )
    left = ends.where(F.col("l.qstart") >= min_clip).select("qname", F.col("l.rname").alias("ref"), F.col("l.at").alias("position"))
    right = ends.where(F.col("n") - F.col("r.qend") + 1 >= min_clip).select("qname", F.col("r.rname").alias("ref"), F.col("r.at").alias("position"))
    return inner.unionByName(left).unionByName(right)


def multimapping_report(aln: DataFrame) -> DataFrame:
    """qname, ostart, oend, ref, rstart, rend, osize: for every ordered pair of different alignments of a read that overlap,
    the overlap and its estimated place on the first one's reference.

    Overlaps are local, so pairs meet by (read, bin of the query coordinate) and are kept in the first bin they share.
    """
    width = 512
    columns = ["qstart", "qend", "rname", "ori", "rstart", "rend", "mapq"]

    def binned(p: str) -> DataFrame:
        spread = F.explode(F.sequence(F.floor(F.col("qstart") / width), F.floor(F.col("qend") / width)))
        return aln.select("qname", spread.alias("_bin"), *(F.col(c).alias(p + c) for c in columns))

    s, t = binned("s_"), binned("t_")
    different = F.lit(False)
    for c in columns:
        different = different | (F.col("s_" + c) != F.col("t_" + c))
    a, b = F.greatest("s_qstart", "t_qstart"), F.least("s_qend", "t_qend")
    pairs = s.join(t, ["qname", "_bin"]).where(different & (b - a > 0) & (F.col("_bin") == F.floor(a / width)))
    n = size(a, b)
    forward = F.col("s_ori") == "+"
    rs, re = F.col("s_rstart"), F.col("s_rend")
    at_start, at_end = a == F.col("s_qstart"), b == F.col("s_qend")
    first = F.when(at_start & ~at_end, F.when(forward, rs).otherwise(re - n)).when(~at_start & at_end, F.when(forward, re - n).otherwise(rs)).when(at_start & at_end, rs).otherwise(rs + a - 1)
    last = F.when(at_start & ~at_end, F.when(forward, rs + n).otherwise(re)).when(~at_start & at_end, F.when(forward, re).otherwise(rs + n)).when(at_start & at_end, re).otherwise(b)
    return pairs.select("qname", a.alias("ostart"), b.alias("oend"), F.col("s_rname").alias("ref"), first.alias("rstart"), last.alias("rend"), n.alias("osize"))


def multimap_runs(aln: DataFrame, min_fraction: float = 0.5) -> DataFrame:
    """qname, run, line_no: runs of two or more alignments, each overlapping the one before by the fraction of the larger of both."""
    order = Window.partitionBy("qname").orderBy("qstart", "qend", "line_no")
    s, e = F.lag("qstart").over(order), F.lag("qend").over(order)
    shared = overlap(F.col("qstart"), F.col("qend"), s, e)
    larger = F.greatest(size(F.col("qstart"), F.col("qend")), size(s, e))
    joins = s.isNotNull() & (shared >= 0) & (shared / larger.cast("double") >= min_fraction)
    marked = aln.select("qname", "qstart", "qend", "line_no", F.when(joins, 0).otherwise(1).alias("_new"))
    numbered = marked.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.withColumn("_n", F.count("*").over(Window.partitionBy("qname", "run"))).where("_n > 1").select("qname", "run", "line_no")


def canonical_regions(aln: DataFrame, key: str = "rname", start: str = "rstart", end: str = "rend", width: int = 1 << 14) -> DataFrame:
    """key, start, end: alignments of a reference in order, chained while they share more than their ends, each chain merged.

    Bins of ``width`` positions, not references, are what a task holds. An alignment without a position of its own shares nothing.
    """
    rows = aln.select(key, start, end)
    return chained_islands(rows, key, start, end, width).select(key, start, end).unionByName(rows.where(F.col(start) >= F.col(end)).distinct())


def read_groups(aln: DataFrame, consecutive: bool = False) -> DataFrame:
    """qname, run, n_aln, first_line: alignments by read; with ``consecutive``, a read that comes back later in the file is a new run.

    Runs are found from rows at which the read changes, by numbering each read's rows against the file's order:
    rows of one run have the same difference between line and rank when no other read is between them.
    """
    if not consecutive:
        return aln.groupBy("qname").agg(F.lit(0).cast("bigint").alias("run"), F.count("*").alias("n_aln"), F.min("line_no").alias("first_line"))
    rank = F.row_number().over(Window.partitionBy("qname").orderBy("rank"))
    runs = aln.withColumn("_g", F.col("rank") - rank).groupBy("qname", "_g").agg(F.count("*").alias("n_aln"), F.min("line_no").alias("first_line"))
    return runs.select("qname", (F.row_number().over(Window.partitionBy("qname").orderBy("first_line")) - 1).cast("bigint").alias("run"), "n_aln", "first_line")
