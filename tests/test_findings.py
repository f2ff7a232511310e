"""Cases of the findings of round 3."""

from pyspark.sql import functions as F

from strandloom import storage
from strandloom.operators import alignments as A
from strandloom.operators import architectures as R
from strandloom.operators import graph as G
from strandloom.operators import projection as J
from strandloom.plans import files
from strandloom.plans.queries import QUERIES
from strandloom.sources import adapters as D
from strandloom.sources import formats, records


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_windows_listed_twice_and_annotations_behind_a_bin(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">s\nA\n")
    (tmp_path / "config").write_text("s\t0\t1\ns\t0\t1\n")
    (tmp_path / "x.gff").write_text("s\tx\tCDS\t1\t1\t.\t+\t.\tID=s\n")
    p = str(tmp_path)
    files.fetch_subsequences(spark, f"{p}/x.fa", f"{p}/config", f"{p}/out", gff=f"{p}/x.gff", normalize=True)
    assert [r.value for r in spark.read.text(f"{p}/out/subsequences.gff").collect()] == ["s_0_1\tx\tCDS\t1\t1\t.\t+\t.\tID=s"] * 2
    genes = spark.createDataFrame([("s", 64, 64), ("s", 65, 65)], "ref string, gstart int, gend int")
    windows = spark.createDataFrame([("s", 0, 63)], "ref string, wstart int, wend int")
    assert rows(J.contained(genes, windows, width=64), "gstart", "gend", "wend") == [(64, 64, 63)]


def test_lines_of_an_architecture_are_joined_again(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "g.gfa").write_text("S\t1\t\tFC:i:1\n" + "".join(f"P\tr{i}\t1+\t9\n" for i in range(12)))
    files.path_metrics(spark, f"{p}/g.gfa", f"{p}/out", directed=True, names_per_line=5)
    names = ",".join(sorted(f"r{i}" for i in range(12)))
    assert rows(files.read_architectures(spark, f"{p}/out")) == [(0, "1+", 0, 12, names)]


def test_homology_pairs_are_dealt_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "SIDE", 4)
    monkeypatch.setattr(D, "PAIRS", 16)
    parts = [(k, "red" if k % 3 else None if k == 9 else "blue", "t", k % 7, f"b{k % 4}") for k in range(40)]
    for name, table in (("once", parts), ("again", [*parts, (5, "blue", "t", 2, "b0")])):
        spark.createDataFrame(table, "p_partkey int, p_name string, p_type string, p_size int, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/{name}/part.parquet")
        got = D.homology(spark, f"{tmp_path}/{name}", placed=True)
        assert rows(got, "q", "r") == sorted((a[0], b[0]) for a in table for b in table if a[0] < b[0] and a[1] == b[1] and a[1])
        assert got.rdd.getNumPartitions() > 16 and ("q_ref" in got.columns) == (name == "once")
    pairs = D.homology(spark, f"{tmp_path}/once", placed=True)
    across = G.across_references(pairs, None)
    assert rows(across, "q", "r") == sorted((a[0], b[0]) for a in parts for b in parts if a[0] < b[0] and a[1] == b[1] and a[1] and a[4] != b[4])
    assert rows(G.homology_graph(across, once=True)) == rows(G.homology_graph(across))
    both = pairs.unionByName(pairs.withColumns({"ori": F.lit("*"), "bitscore": F.col("bitscore") + 1000}))
    assert rows(G.first_orientation(both, "bitscore", D.CELL)) == rows(pairs, "q", "r", "ori")
    plan = G.first_orientation(pairs, "bitscore", D.CELL)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(q" not in plan


def test_orientations_of_pairs_are_found_where_the_pairs_lie(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "SIDE", 4)
    parts = [(k, "red" if k % 3 else "blue", "t", k % 7, f"b{k % 4}") for k in range(40)]
    spark.createDataFrame(parts, "p_partkey int, p_name string, p_type string, p_size int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["pair_orientation"](spark, str(tmp_path))
    pairs = [(a[0], b[0]) for a in parts for b in parts if a[0] < b[0] and a[1] == b[1]]
    assert rows(got) == sorted((q, r, "-" if 30 + (q + r) % 100 < 80 and (q + r) % 3 == 0 else "+") for q, r in pairs)
    assert "hashpartitioning(q" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(_low" not in plan
    # Both ways round, a pair of one gene, orientations of one way, both or none.
    pairs = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 3, 4), (0, 5, 5), (0, 7, 6), (0, 8, 9)], "cell int, q int, r int")
    known = spark.createDataFrame([(0, 1, 2, "-"), (0, 2, 1, "+"), (0, 4, 3, "-"), (0, 5, 5, "-"), (0, 7, 6, "-"), (0, 8, 9, None), (0, 20, 21, "-")], "cell int, q int, r int, ori string")
    want = [(1, 2, "-"), (2, 1, "+"), (3, 4, "-"), (5, 5, "-"), (7, 6, "-"), (8, 9, "+")]
    assert rows(G.pair_orientation(pairs, known, ["cell"])) == rows(G.pair_orientation(pairs, known), "q", "r", "known") == want


def test_long_paths_have_distances_beyond_a_byte():
    for n in (3, 200):
        a, b = [(1, list(range(n)))], [(2, list(range(n, 2 * n)))]
        (_, _, _, edits, distance), = R._block_distances(a, b, False)
        assert edits.tolist() == [n] and distance.tolist() == [1.0]


def test_many_splits_are_read_by_a_bounded_number_of_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr(records, "MOST", 4)
    (tmp_path / "x.fa").write_text("".join(f">s{i}\nACGT\n" for i in range(50)))
    reader = records.FastaReader({"path": str(tmp_path / "x.fa"), "splitSize": "20"})
    found = reader.partitions()
    assert len(reader.splits()) > 4 >= len(found)
    assert [n for p in found for b in reader.read(p) for n in b.column("name").to_pylist()] == [f"s{i}" for i in range(50)]


def test_reads_are_dealt_once_and_by_the_size_of_the_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "DEALT", 100)
    spark.range(400).select(F.concat(F.lit("r"), F.col("id") % 50).alias("qname"), F.col("id").cast("int").alias("qstart"), (F.col("id") + 150).cast("int").alias("qend"), F.col("id").alias("line_no")).write.parquet(f"{tmp_path}/aln")
    aln = spark.read.parquet(f"{tmp_path}/aln")
    got = A.with_clusters(aln)
    assert got.rdd.getNumPartitions() > 20 and got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    assert got.count() == 400
    paths = spark.createDataFrame([("p", [(1, "+"), (2, "-"), (2, "+")]), ("q", [(1, "+"), (2, "+")]), ("e", [])], "name string, path array<struct<id:int,ori:string>>")
    assert rows(G.edge_coverage_of_paths(paths)) == [(1, 2, 2), (2, 2, 1)]


def test_lines_are_split_once_and_pairs_are_not_joined_by_id_after_by_name(spark, tmp_path):
    (tmp_path / "x.blast").write_text("a\t30\tb\t32\t1\t32\t30\t90.0\t1e-10\t75.0\n" * 2 + "a\t30\tc\t32\t1\t32\t30\t90.0\t1e-10\t75.0\n")
    (tmp_path / "genes").write_text("0\tx\t1\t20\t+\td\ta\n1\ty\t1\t20\t+\td\tb\n2\tx\t30\t50\t+\td\tc\n3\tz\t1\t20\t+\td\tb\n")
    p = str(tmp_path)
    genes = formats.parse_descriptions(formats.read_lines(spark, f"{p}/genes"))
    lines = formats.parse_blast(formats.read_lines(spark, f"{p}/x.blast"), local_ids=True)
    kept = G.homology_pairs(lines)
    assert kept._jdf.queryExecution().executedPlan().toString().count("split(") == 1
    # The later gene of a name, with its own place, in pairs that need no further join.
    pairs = files._alignments_of_genes(spark, f"{p}/x.blast", True, genes, True)
    assert rows(G.across_references(pairs, None), "q", "r") == [(0, 3), (0, 3)]
    files.graph_family(spark, f"{p}/genes", f"{p}/x.blast", f"{p}/out", local_ids=True)
    assert sorted(r.value for r in spark.read.text(f"{p}/out/gene_families").collect()) == ["0\t0", "3\t0"]


def test_genes_of_sequences_are_sorted_by_their_lengths_and_cut_once(spark, tmp_path, monkeypatch):
    texts = [(k, "s", "acgtnx" * (k * 7 % 60)) for k in (9, 3, 30, 12, 0, 81, 45)]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in D.gene_spans(spark, str(tmp_path), ordered=True).collect()]
    assert got == sorted(got) == rows(D.gene_spans(spark, str(tmp_path))) and len(got) > 10
    cut = []
    monkeypatch.setattr(files, "materialize", lambda df: cut.append(df.columns) or storage.materialize(df))
    (tmp_path / "x.fa").write_text(">s\nACGTACGTA\n")
    (tmp_path / "x.gff").write_text("s\tx\tCDS\t1\t6\t.\t+\t.\tproduct=a;protein_id=b\ns\tx\tCDS\t4\t9\t.\t-\t.\tproduct=a;protein_id=c\n")
    files.extract_genes(spark, [f"{tmp_path}/x.gff"], f"{tmp_path}/x.fa", f"{tmp_path}/out")
    assert cut == [["id", "fna", "faa"]]
    assert rows(formats.read_fasta(spark, f"{tmp_path}/out/genes.fna")) == [("0", "ACGTAC"), ("1", "TACGTA")]


def test_lines_of_a_sequence_graph_are_made_once(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(files, "materialize", lambda df: made.append(df.columns) or storage.materialize(df))
    (tmp_path / "a.fa").write_text(">s\nA-C\n>t\nA-G\n")
    files.sequence_graph(spark, {1: f"{tmp_path}/a.fa"}, f"{tmp_path}/out", single=True)
    assert made == [["value", "rank", "section"]]
    want = ["H\tSequence-graph", "S\t1_0_A\t\tFC:i:1", "S\t1_2_C\t\tFC:i:1", "S\t1_2_G\t\tFC:i:1", "L\t1_0_A\t+\t1_2_C\t+\t\tFC:i:1", "L\t1_0_A\t+\t1_2_G\t+\t\tFC:i:1", "P\ts\t1_0_A+,1_2_C+\t2", "P\tt\t1_0_A+,1_2_G+\t2"]
    assert (tmp_path / "out/graph.gfa").read_text().splitlines() == want
