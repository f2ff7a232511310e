"""Hand-derived cases of every operator."""

from pyspark.sql import functions as F

from strandloom.functions import intervals as I
from strandloom.functions import paths as P
from strandloom.functions import sequences as S
from strandloom.operators import alignments as A
from strandloom.operators import architectures as R
from strandloom.operators import graph as G
from strandloom.operators import intervals as N
from strandloom.operators import projection as J
from strandloom.operators import residues as Q
from strandloom.operators import text as T
from strandloom.operators.numbering import number_rows
from strandloom.plans import commands
from strandloom.sources import writers

ALN = "line_no long, qname string, query_length int, qstart int, qend int, ori string, rname string, rstart int, rend int, mapq int"
GENES = "id int, ref string, gstart int, gend int, ori string, description string, gene_id string"


def aln(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], ALN)


def genes(spark):
    return spark.createDataFrame([(0, "refA", 0, 100, "+", "DNA-binding protein", "P0"), (1, "refA", 150, 300, "-", "x", "P1"), (2, "refA", 350, 500, "+", "y", "P2"), (3, "refB", 0, 100, "+", "z", "P3")], GENES)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def steps(spark, *paths):
    data = [(f"p{k}", i, int(x[:-1]), x[-1]) for k, p in enumerate(paths) for i, x in enumerate(p.split(","))]
    return spark.createDataFrame(data, "name string, pos int, id int, ori string")


def reads(spark):
    return aln(spark, [("r1", 600, 0, 520, "+", "refA", 0, 520, 60), ("r2", 400, 0, 380, "-", "refA", 130, 510, 60), ("r3", 400, 0, 380, "+", "refA", 0, 380, 5), ("r4", 300, 0, 60, "+", "refA", 60, 120, 60), ("r5", 300, 0, 300, "+", "refA", 0, 300, 60), ("r5", 300, 0, 300, "+", "refB", 0, 300, 60)])


def test_gene_graph_of_reads(spark):
    graph = commands.graph_alignment(reads(spark), genes(spark))
    paths = R.gathered(graph.steps).select("name", P.rendered(F.col("path")).alias("p"))
    assert rows(paths) == [("r1", "0+,1-,2+"), ("r2", "2-,1+")]
    assert rows(graph.nodes) == [(0, 1), (1, 2), (2, 2)]
    assert rows(graph.edges) == rows(graph.links.withColumn("c", F.lit(1))) == [(0, 1, 1), (1, 2, 1), (2, 1, 1)]
    assert rows(G.graph_totals(graph.steps)) == [(3, 3)]
    lines = [r.value for r in graph.gfa().orderBy("section", "rank").collect()]
    assert lines[0] == "H\tGene-graph" and "S\t1\t\tFC:i:2" in lines and "L\t2\t+\t1\t+\t\tFC:i:1" in lines and "P\tr1\t0+,1-,2+\t3" in lines
    without = commands.graph_alignment(reads(spark), genes(spark), exclude=spark.createDataFrame([("r1",)], "qname string"))
    assert rows(without.edges) == [(2, 1, 1)]


def test_path_metrics(spark):
    paths = R.gathered(steps(spark, "0+,1-,2+", "2-,1+", "3-,2-,1-", "2+,1-,2-")).withColumn("size", F.lit(5))
    found = {r.path: (r.single_ori, r.n) for r in commands.path_metrics(paths).collect()}
    assert found == {"0+,1-,2+": (1, 1), "1-,2+": (1, 1), "1+,2+,3+": (0, 1), "2+,1-,2-": (1, 1)}
    assert commands.path_metrics(paths.withColumn("size", F.lit(-1))).count() == 0


def test_intervals(spark):
    spans = spark.createDataFrame([("a", 1, 5), ("a", 5, 8), ("a", 9, 12), ("b", 0, 9), ("b", 2, 3), ("b", 8, 11)], "k string, s int, e int")
    assert rows(N.merged_intervals(spans, "k", "s", "e")) == [("a", 1, 8), ("a", 9, 12), ("b", 0, 11)]
    values = spark.createDataFrame([("a", v) for v in (0, 0, 90, 300, 310)], "k string, v int")
    assert rows(N.value_clusters(values, ["k"], "v", 100)) == [("a", 0, 30), ("a", 90, 30), ("a", 300, 305), ("a", 310, 305)]
    covered = spark.createDataFrame([("a", 10, 40, 100), ("a", 50, 80, 100), ("b", 0, 100, 100)], "k string, s int, e int, n int")
    assert rows(N.unaligned_regions(covered, "k", "s", "e", "n"), "k", "s", "e") == [("a", 1, 10), ("a", 41, 49), ("a", 81, 100)]
    one = spark.range(1).select(I.rescale(F.lit(100), F.lit(200), F.lit(0), F.lit(50), F.lit(25)), I.coverage(F.lit(0), F.lit(100), F.lit(60), F.lit(121)), I.rescale(F.lit(1), F.lit(2), F.lit(3), F.lit(3), F.lit(3)))
    assert tuple(one.first()) == (150, 40 / 101, None)


def test_binned_join_equals_the_plain_one(spark):
    a = spark.range(200).selectExpr("id as i", "concat('k', id % 3) as ka", "id * 37 % 500 as sa", "id * 37 % 500 + 1 + id * 7 % 90 as ea")
    b = spark.range(150).selectExpr("id as j", "concat('k', id % 3) as kb", "id * 53 % 500 as sb", "id * 53 % 500 + 1 + id * 11 % 60 as eb")
    plain = a.join(b, F.expr("ka = kb and sa < eb and sb < ea")).select("i", "j")
    for width in (7, 64, 4096):
        assert rows(N.overlap_join(a, b, ("ka", "kb"), (F.col("sa"), F.col("ea")), (F.col("sb"), F.col("eb")), width), "i", "j") == rows(plain)


def clusters(spark, *spans):
    data = aln(spark, [("q", 1000, s, e, "+", "r", s, e, 60) for s, e in spans])
    return [c for _, c in rows(A.multimap_clusters(data), "line_no", "cluster")]


def test_multimap_clusters(spark):
    assert clusters(spark, (0, 1000), (100, 150), (200, 900)) == [0, 1, 2]
    assert clusters(spark, (0, 500), (100, 400), (450, 700)) == [0, 0, 1]


def test_multimap_grid(spark):
    data = aln(spark, [("q", 1000, 0, 500, "+", "r", 0, 500, 60), ("q", 1000, 100, 400, "+", "s", 10, 310, 60)])
    cells = A.multimap_intervals(data, 100, 50).groupBy("istart", "iend").agg(F.max("n_aln"), F.count("*"))
    assert rows(cells) == [(0, 100, 1, 1), (100, 400, 2, 2), (400, 500, 1, 1)]


def test_breakpoints_and_reports(spark):
    for ori, want in (("+", [("A", 100), ("A", 400)]), ("-", [("A", 100), ("A", 400)])):
        assert rows(A.alignment_breakpoints(aln(spark, [("q", 1000, 350, 650, ori, "A", 100, 400, 60)])), "ref", "position") == want
    pair = aln(spark, [("q", 1000, 0, 100, "+", "A", 10, 110, 60), ("q", 1000, 60, 200, "-", "B", 0, 140, 60)])
    assert rows(A.multimapping_report(pair)) == [("q", 60, 100, "A", 69, 110, 41), ("q", 60, 100, "B", 99, 140, 41)]
    assert rows(A.multimap_runs(pair, 0.2), "run", "line_no") == [(0, 1), (0, 2)] and A.multimap_runs(pair, 0.5).count() == 0
    assert rows(A.canonical_regions(aln(spark, [("q", 9, 0, 1, "+", "A", 0, 10, 9), ("q", 9, 0, 1, "+", "A", 5, 20, 9), ("q", 9, 0, 1, "+", "A", 20, 30, 9)]))) == [("A", 0, 20), ("A", 20, 30)]


def test_read_groups(spark):
    data = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 4)], "qname string, line_no long").withColumn("rank", F.col("line_no"))
    assert rows(A.read_groups(data, consecutive=True)) == [("a", 0, 2, 1), ("a", 1, 1, 4), ("b", 0, 1, 3)]
    assert rows(A.read_groups(data), "qname", "n_aln") == [("a", 3), ("b", 1)]


def test_graph_operators(spark):
    one = steps(spark, "1+,2+,1+")
    assert rows(G.edge_coverage(one, directed=False)) == [(1, 2, 2), (2, 1, 2)] and rows(G.node_coverage(one)) == [(1, 2), (2, 1)]
    loop = steps(spark, "5+,5+")
    assert rows(G.edge_coverage(loop)) == [(5, 5, 1)] and G.graph_edges(loop).count() == 0 and rows(G.graph_edges(loop, keep_self_edges=True)) == [(5, 5)]
    assert rows(G.edge_coverage(loop, directed=False)) == [(5, 5, 2)] and rows(G.graph_edges(loop, directed=False)) == [(5, 5)]
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "q int, r int")
    members = G.families(pairs)
    assert rows(members) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    assert rows(G.homology_connectivity(pairs, members)) == [(1, 1 / 3, 3), (2, 2 / 3, 3), (3, 1 / 3, 3), (7, 0.5, 2), (8, 0.5, 2)]
    known = spark.createDataFrame([(1, 2, "-"), (8, 7, "-")], "q int, r int, ori string")
    assert rows(G.pair_orientation(pairs, known), "q", "known") == [(1, "-"), (2, "+"), (7, "-")]
    labels = rows(G.edge_labels(steps(spark, "1+,2-")))
    assert labels == [(1, "+", 2, "-", "p0"), (2, "-", 1, "+", "p0")]


def test_families_along_references(spark):
    pairs = spark.createDataFrame([(1, 3, 100, 100, "+", 1e-9, 80.0), (0, 1, 100, 100, "+", 1e-9, 80.0), (2, 3, 100, 50, "+", 1e-9, 80.0)], "q int, r int, qlength int, rlength int, ori string, eval double, bitscore double")
    graph = commands.graph_family(pairs, genes(spark))
    assert rows(graph.steps, "name", "pos", "id") == [("refA", 0, 0), ("refA", 1, 1), ("refA", 2, 2), ("refB", 0, 1)]
    assert rows(graph.edges) == [(0, 1, 1), (1, 0, 1), (1, 2, 1), (2, 1, 1)]
    assert commands.graph_family(pairs, genes(spark), split_ori=True).nodes.count() == 4
    assert rows(commands.native_graph(genes(spark))) == [(0, 1), (1, 0), (1, 2), (2, 1)]


def test_paths(spark):
    df = spark.createDataFrame([("2+,1-,2-",), ("1+,2-,3+",), ("",)], "t string").withColumn("p", P.parsed(F.col("t")))
    assert [r[0] for r in df.select(P.rendered(P.reversed_path(F.col("p")))).collect()] == ["2+,1+,2-", "3-,2+,1-", ""]
    d = spark.range(1).select(P.edit_distance(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(2), F.lit(3), F.lit(400))), P.normalised_distance(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1))), P.normalised_distance(F.array(F.lit(1)), F.array(F.lit(2))))
    assert tuple(d.first()) == (2, 0.0, 1.0)


def test_sequences(spark):
    one = spark.range(1).select(S.reverse_complement(F.lit("AACGN")), S.reverse_complement(F.lit("acg")), S.protein(F.lit("ATGTAAAAATG")), S.subsequence(F.lit("ACGTA"), F.lit(3), F.lit(7)), S.subsequence(F.lit("ACGTA"), F.lit(1), F.lit(3)))
    assert tuple(one.first()) == ("NCGTT", "NNN", "MK", "TAAC", "CG")
    cut = Q.extract_genes(spark.createDataFrame([(1, "s", 0, 6, "-"), (2, "s", 3, 9, "+")], "id int, seq_key string, gstart int, gend int, ori string"), spark.createDataFrame([("s", "ATGAAA")], "seq_key string, seq string"))
    assert rows(cut) == [(1, "ATGAAA", "FH")]
    msa = spark.createDataFrame([(1, "x", "A-C"), (1, "y", "A-C"), (1, "z", "---")], "gene_id int, seqname string, aligned string")
    nodes, edges = commands.sequence_graph(msa)
    assert rows(nodes) == [(1, 0, "A", 1, 2), (1, 2, "C", 1, 2)] and rows(edges) == [(1, 0, "A", 2, "C", 2)]


def test_text(spark):
    assert rows(T.keyword_match(genes(spark), ["binding,dna", "x", "dna y"])) == [(0, "binding,dna"), (1, "x")]
    paths = spark.createDataFrame([("p", "1+,2-,3+"), ("q", "1+")], "name string, path string")
    assert rows(T.label_edges(paths), "source", "target") == [("1", "2"), ("2", "3+")] and rows(T.label_edges(paths, True), "target") == [("2",), ("3",)]
    assert rows(T.remapped(spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(1, 9), (2, 9)], "old int, new int"))) == [(3,), (9,)]


def test_windows_and_anchors(spark):
    windows = spark.createDataFrame([("refA", 0, 300), ("refA", 340, 499)], "ref string, wstart int, wend int")
    assert rows(J.contained(genes(spark), windows, width=64), "id", "wstart") == [(0, 0), (1, 0), (2, 340)]
    between = spark.createDataFrame([(1, "refA", 0, 320, "refB", 0, 320)], "line_no long, qref string, qstart int, qend int, rname string, rstart int, rend int")
    assert rows(J.syntenic_anchors(between, genes(spark))) == [(1, 0, 3)]


def test_alignment_reports(spark):
    lengths = spark.createDataFrame([("r1", 600), ("r2", 400), ("r9", 50)], "qname string, length int")
    reports = commands.alignment_metrics(reads(spark), lengths)
    assert set(reports) == {"read_length", "alignment_sizes", "breakpoints", "multimapping", "unmapped_reads", "unaligned"}
    assert rows(reports["unmapped_reads"]) == [("r9", 50)] and rows(reports["unaligned"], "qname", "qstart", "qend") == [("r1", 521, 600), ("r2", 381, 400)]
    assert rows(reports["alignment_sizes"], "qname", "size", "align_cov") == [("r1", 521, 0.87), ("r2", 381, 0.95)]


def test_numbers(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 as x", "id % 3 as y")
    assert all(r.x + 5 == r.n for r in number_rows(df, ["x"], "n", first=5).collect())
    assert number_rows(df.where("x < 0"), ["x"], "n").count() == 0


def test_lines(spark):
    assert [r.value for r in writers.gff_lines(genes(spark)).limit(1).collect()] == ["refA\t.\tCDS\t1\t100\t.\t+\t.\tprotein_id=P0;product=DNA-binding protein"]
