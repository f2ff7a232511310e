import pytest
from pyspark.sql import functions as F

from strandloom.functions import paths as P
from strandloom.operators import architectures as R
from strandloom.operators import graph as G
from strandloom.sources import formats, genbank, writers
from strandloom.streaming import coverage


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_gff_files_get_running_ids(spark, tmp_path):
    (tmp_path / "b.gff").write_text("# c\ns1\t.\tCDS\t1\t9\t.\t+\t.\tprotein_id=a;product=kinase\nshort\trow\ns1\t.\tgene\t1\t9\t.\t+\t.\tx\n")
    (tmp_path / "a.gff").write_text("s2\t.\tCDS\t5\t9\t.\t-\t.\tID=z\ns2\t.\tCDS\t11\t19\t.\t+\t.\tproduct=p=q\n")
    got = formats.read_gff(spark, [str(tmp_path / "b.gff"), str(tmp_path / "a.gff")])
    assert rows(got) == [(0, "s1", 0, 9, "+", "kinase", "a"), (1, "s2", 4, 9, "-", "null", "null"), (2, "s2", 10, 19, "+", "p=q", "null")]
    with pytest.raises(Exception, match="not a proper gene"):
        formats.parse_gff(lines(spark, "s\t.\tCDS\t9\t8\t.\t+\t.\tx")).collect()


def test_gff_files_of_one_name_keep_the_order_given(spark, tmp_path):
    for folder, row in (("b", "s1\t.\tCDS\t1\t9\t.\t+\t.\tprotein_id=first\n"), ("a", "s2\t.\tCDS\t5\t9\t.\t-\t.\tprotein_id=second\n"), ("xa", "s3\t.\tCDS\t5\t9\t.\t-\t.\tprotein_id=third\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "genes file.gff").write_text(row)
    got = formats.read_gff(spark, [str(tmp_path / "b" / "genes file.gff"), str(tmp_path / "a" / "genes file.gff"), str(tmp_path / "xa")])
    assert rows(got, "id", "gene_id") == [(0, "first"), (1, "second"), (2, "third")]


def test_paf_and_blast(spark):
    paf = formats.parse_paf(lines(spark, "q x\t10\t1\t9\t+\tr\t20\t2\t8\t5\t6\t60\ttp:A:P"))
    assert rows(paf) == [("q", 10, 1, 9, "+", "r", 20, 2, 8, 6, 60)]
    blast = formats.parse_blast(lines(spark, "1\t10\t2\t20\t9\t3\t7\t99.5\t1e-9\t80"))
    assert rows(blast) == [(1, 10, 2, 20, "-", 7, 99.5, 1e-9, 80.0)]


def test_gfa_round_trip(spark, tmp_path):
    steps = spark.createDataFrame([("p", 0, 1, "+"), ("p", 1, 2, "-"), ("p", 2, 1, "+"), ("q", 0, 12, "+")], "name string, pos int, id int, ori string")
    paths = R.gathered(steps).withColumn("size", F.size("path"))
    written = writers.gfa_graph("Gene-graph", G.node_coverage(steps), G.edge_coverage(steps), paths)
    writers.write_lines(written, str(tmp_path / "g.gfa"), "section", "rank")
    back = formats.read_lines(spark, str(tmp_path / "g.gfa"))
    assert [r.value for r in back.orderBy("file", "at").collect()][:3] == ["H\tGene-graph", "S\t1\t\tFC:i:2", "S\t2\t\tFC:i:1"]
    nodes, edges = formats.gfa_node_table(back), formats.gfa_edge_table(back)
    assert rows(nodes, "id", "weight") == [(1, 2), (2, 1), (12, 1)] and rows(edges) == [(1, 2, 1), (2, 1, 1)]
    assert rows(formats.parse_gfa_paths(back).select("name", P.rendered(F.col("path")), "size")) == [("p", "1+,2-,1+", 3), ("q", "12+", 1)]
    labels = spark.createDataFrame([(2, "kinase")], "id int, label string")
    assert rows(formats.gfa_node_table(back, labels), "id", "label") == [(1, "None"), (2, "kinase"), (12, "None")]
    assert formats.graph_faults(nodes, edges, directed=False).count() == 0
    odd = spark.createDataFrame([(1, 12, 1), (1, 99, 1)], "source int, target int, weight int")
    assert rows(formats.graph_faults(nodes, odd, directed=False), "fault", "target") == [("one way", 12), ("one way", 99), ("unknown node", 99)]
    with pytest.raises(Exception, match="four columns"):
        formats.parse_gfa_paths(lines(spark, "P\tx\t1+")).collect()


def test_sequences(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">a first\nACGT\nAC\n\n>b\nGG>G\n>c\n")
    assert rows(formats.read_sequences(spark, str(tmp_path / "x.fasta"))) == [("a", "ACGTAC"), ("b", "GG>G"), ("c", "")]
    (tmp_path / "x.fq").write_text("@r1 d\nACGT\n+\n@@@@\n@r2\nGG\n+\n##\n")
    assert rows(formats.read_sequences(spark, str(tmp_path / "x.fq"))) == [("r1", "ACGT"), ("r2", "GG")]
    with pytest.raises(ValueError, match="neither"):
        formats.read_sequences(spark, "x.txt")
    writers.fasta_lines(spark.createDataFrame([(1, "ACG"), (2, "T")], "id int, seq string"), "id", "seq").write.text(str(tmp_path / "out.fa"))
    assert rows(formats.read_fasta(spark, str(tmp_path / "out.fa"))) == [("1", "ACG"), ("2", "T")]


def test_genbank(spark, tmp_path):
    (tmp_path / "x.gb").write_text(
        "LOCUS       NC_1   30 bp\nFEATURES             Location/Qualifiers\n"
        "     CDS             complement(4..9)\n                     /product=\"long\n                     name\"\n                     /translation=\"MK\n                     L\"\n"
        "     CDS             join(25..30,1..3)\n                     /translation=\"M\"\n                     /product=\"p\"\n"
        "ORIGIN\n        1 acgtacgtac gtacgtacgt\n       21 acgtacgtac\n//\n"
    )
    got = formats.read_genbank(spark, str(tmp_path / "x.gb"))
    genes = rows(got.where("kind = 'gene'"), "seqname", "start", "end", "ori", "product", "sequence")
    assert genes == [("NC_1", 3, 9, "-", "long name", "MKL"), ("NC_1", 24, 33, "+", "p", "M")]
    assert rows(got.where("kind = 'sequence'"), "sequence") == [("acgtacgtac" + "gtacgtacgt" + "acgtacgtac",)]


def test_genbank_locations():
    assert genbank.genbank_extent("7") == (6, 7, "+") and genbank.genbank_extent("<3..>9") == (2, 9, "+")
    assert genbank.genbank_extent("join(1..6,20..25,40..45)") == (0, 45, "+")
    assert genbank.genbank_extent("complement(join(25..30,1..3))") == (24, 33, "-")
    assert genbank.genbank_extent("join(complement(20..25),complement(28..30),complement(1..3))") == (19, 33, "-")
    assert genbank.genbank_extent("join(J00194.1:100..202,1..245)") == (0, 245, "+")
    with pytest.raises(ValueError, match="no place"):
        genbank.genbank_extent("J00194.1:100..202")


def test_genbank_grammar():
    place = lambda text: [(e.start, e.end, e.ori, e.remote) for e in genbank.exons(text)]
    assert place("complement(join(2691..4571,4918..5163))") == place("join(complement(4918..5163),complement(2691..4571))") == [(4917, 5163, "-", None), (2690, 4571, "-", None)]
    assert place("order( 1..2 , complement(AB_1.2:7..9) )") == [(0, 2, "+", None), (6, 9, "-", "AB_1.2")]
    assert place("join(complement(order(1,3)),complement(complement(5^6)))") == [(2, 3, "-", None), (0, 1, "-", None), (4, 6, "+", None)]
    assert place("(5.9)..(12.20)") == [(4, 20, "+", None)] and place("one-of(3,<5,8)..>11") == [(2, 11, "+", None)] and place("102.110") == [(101, 110, "+", None)]
    for text in ("", "9..3", "0..4", "join(1..2", "join(1..2))", "complement()", "1..2,3..4", "gap(5)", "bond(1,2)", "..5", "x", "1..2 junk", "join(1..2,)", "12-14"):
        with pytest.raises(ValueError, match="not a location"):
            genbank.exons(text)


def test_genbank_extents_by_length():
    """Circular only where an exon ends with the sequence and the next begins with it."""
    at = genbank.genbank_extent
    assert at("join(complement(4918..5163),complement(2691..4571))", 6000) == (2690, 5163, "-")
    assert at("join(25..30,1..3)", 40) == (0, 30, "+") and at("join(25..30,1..3)", 30) == (24, 33, "+")
    assert at("complement(join(25..30,1..3))", 30) == at("join(complement(1..3),complement(25..30))", 30) == (24, 33, "-")
    assert at("join(20..22,25..30,1..3,5..6)", 30) == (19, 36, "+") and at("join(5..6,1..3)", 30) == (0, 6, "+")
    assert at("join(1..3,complement(8..9))", 30) == (0, 9, "+")


def test_genbank_exons(spark, tmp_path):
    (tmp_path / "x.gb").write_text("LOCUS       N   30 bp\n     CDS             complement(join(4..9,\n                     Z.1:2..3,12..20))\nORIGIN\n        1 acgt\n//\nLOCUS       M   9 bp\n     CDS             7-9\nORIGIN\n//\n")
    got = formats.read_genbank(spark, str(tmp_path / "x.gb"))
    with pytest.raises(Exception, match="not a location: 7-9"):
        got.collect()
    (tmp_path / "y.gb").write_text((tmp_path / "x.gb").read_text().split("LOCUS       M")[0])
    (gene,) = formats.read_genbank(spark, str(tmp_path / "y.gb")).where("kind = 'gene'").collect()
    assert (gene.start, gene.end, gene.ori) == (3, 20, "-") and list(map(tuple, gene.exons)) == [("N", 11, 20, "-"), ("Z.1", 1, 3, "-"), ("N", 3, 9, "-")]


def test_genbank_files_are_split_between_records(spark, tmp_path):
    one = "LOCUS       N{0}   6 bp\nFEATURES\n     CDS             1..6\n                     /product=\"p{0}\"\nORIGIN\n        1 acgta{1}\n//\n"
    (tmp_path / "x.gb").write_text("".join(one.format(i, "acgt"[i % 4]) for i in range(40)))
    got = formats.read_genbank(spark, str(tmp_path / "x.gb"))
    assert rows(got.where("kind = 'gene'"), "seqname", "product") == sorted((f"N{i}", f"p{i}") for i in range(40))
    assert rows(got.where("kind = 'sequence'"), "seqname", "sequence") == sorted((f"N{i}", "acgta" + "acgt"[i % 4]) for i in range(40))


def test_small_tables(spark, tmp_path):
    (tmp_path / "labels.tsv").write_text("1\ta\n2\tb\n1\tc\n")
    pairs = formats.parse_pairs(formats.read_lines(spark, str(tmp_path / "labels.tsv")), "id", "label")
    assert rows(formats.last_wins(pairs, "id", "label")) == [("1", "c"), ("2", "b")]
    assert rows(formats.parse_fetch_config(lines(spark, "a", "b\t1\t9")).fillna(-1)) == [("a", -1, -1), ("b", 1, 9)]
    assert rows(formats.parse_fetch_config(lines(spark, "a b\t", "b\t1\t9\tname\t", "c\t\t")).fillna(-1)) == [("a b", -1, -1), ("b", 1, 9), ("c", -1, -1)]
    (tmp_path / "families.tsv").write_text("1\t7\n2\t7\n1\t7\n3\t3\n")
    assert rows(formats.parse_gene_families(formats.read_lines(spark, str(tmp_path / "families.tsv")))) == [(3, 3), (7, 1), (7, 2)]
    assert rows(formats.parse_labels(lines(spark, "1\ta", "1\tb\tx", "1\ta"))) == [(1, "a"), (1, "b")]
    repeated = "".join(f"P\tx\t{k}+\t1\n" for k in (1, 2)) + "P\tx\t\t1\n"
    (tmp_path / "paths.gfa").write_text(repeated)
    assert rows(formats.parse_gfa_paths(formats.read_lines(spark, str(tmp_path / "paths.gfa"))).select("name", P.rendered(F.col("path")))) == [("x", "2+")]
    with pytest.raises(Exception, match="start and end"):
        formats.parse_fetch_config(lines(spark, "b\t1")).collect()
    with pytest.raises(Exception, match="two columns"):
        formats.parse_pairs(lines(spark, "b"), "a", "b").collect()
    text = writers.description_lines(spark.createDataFrame([(1, "r", 0, 9, "+", "d", "g")], "id int, ref string, gstart int, gend int, ori string, description string, gene_id string"))
    assert rows(formats.parse_descriptions(text)) == [(1, "r", 1, 9, "+", "d", "g")]
    writers.write_table(spark.createDataFrame([(1, "a"), (2, None)], "id int, label string"), str(tmp_path / "t.csv"), sep=";", header=True)
    assert rows(spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "t.csv"))) == [("1", "a"), ("2", None)]


def test_streamed_coverage_equals_batch(spark, tmp_path):
    schema = "name string, path array<struct<id:int,ori:string>>"
    one = spark.createDataFrame([("a", [(1, "+"), (2, "+"), (1, "-")]), ("b", [(3, "+")]), ("c", [])], schema)
    one.repartition(3).write.json(str(tmp_path / "in"))
    steps = one.select("name", F.posexplode("path").alias("pos", "g")).select("name", "pos", "g.*")
    for name, stream, batch in (("nodes", coverage.node_coverage, G.node_coverage(steps)), ("edges", coverage.edge_coverage, G.edge_coverage(steps)), ("both", lambda p: coverage.edge_coverage(p, directed=False), G.edge_coverage(steps, directed=False))):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = stream(source).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert rows(spark.table(name)) == rows(batch)
