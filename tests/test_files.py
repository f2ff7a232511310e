"""Commands over files, end to end."""

import glob

import pytest
from pyspark.sql import functions as F

from strandloom.plans import commands, files
from strandloom.sources import formats, writers


def written(folder):
    out = []
    for name in sorted(glob.glob(f"{folder}/part-*")):
        out += open(name).read().splitlines()
    return out


@pytest.fixture
def inputs(tmp_path):
    (tmp_path / "x.gff").write_text(
        "refA\t.\tCDS\t1\t100\t.\t+\t.\tproduct=DNA-binding protein;protein_id=P0\nrefA\t.\tCDS\t151\t300\t.\t-\t.\tproduct=x;protein_id=P1\nrefA\t.\tCDS\t351\t500\t.\t+\t.\tproduct=y;protein_id=P2\nrefB\t.\tCDS\t1\t100\t.\t+\t.\tproduct=z;protein_id=P3\n"
    )
    rows = [("r1", 600, 0, 520, "+", "refA", 0, 520, 60), ("r2", 400, 0, 380, "-", "refA", 130, 510, 60), ("r3", 400, 0, 380, "+", "refA", 0, 380, 5), ("r4", 300, 0, 60, "+", "refA", 60, 120, 60), ("r5", 300, 0, 300, "+", "refA", 0, 300, 60), ("r5", 300, 0, 300, "+", "refB", 0, 300, 60)]
    (tmp_path / "x.paf").write_text("".join(f"{q}\t{n}\t{a}\t{b}\t{o}\t{r}\t600\t{c}\t{d}\t0\t{b - a}\t{m}\n" for q, n, a, b, o, r, c, d, m in rows))
    (tmp_path / "x.fa").write_text(">refA\n" + "ACGTAACCGGTT" * 50 + "\n>refB\n" + "ATGAAATTT" * 12 + "\n")
    return tmp_path


def test_graph_of_alignments_and_its_reports(spark, inputs, tmp_path):
    p = str(tmp_path)
    files.graph_alignment(spark, [f"{p}/x.gff"], f"{p}/x.paf", f"{p}/out")
    assert written(f"{p}/out/graph.gfa") == ["H\tGene-graph", "S\t0\t\tFC:i:1", "S\t1\t\tFC:i:2", "S\t2\t\tFC:i:2", "L\t0\t+\t1\t+\t\tFC:i:1", "L\t1\t+\t2\t+\t\tFC:i:1", "L\t2\t+\t1\t+\t\tFC:i:1", "P\tr1\t0+,1-,2+\t600", "P\tr2\t2-,1+\t400", "P\tr4\t\t300", "P\tr5\t\t300"]
    assert written(f"{p}/out/gene_description")[1] == "1\trefA\t151\t300\t-\tx\tP1"
    files.path_metrics(spark, f"{p}/out/graph.gfa", f"{p}/out", directed=True)
    assert written(f"{p}/out/architectures") == ["ID\tPath\tSingleOri\tCount\tNames", "0\t0+,1-,2+\t1\t1\tr1", "1\t1-,2+\t1\t1\tr2"]
    with pytest.raises(ValueError, match="not a proper graph"):
        files.path_metrics(spark, f"{p}/out/graph.gfa", f"{p}/again")
    files.gfa_converter(spark, f"{p}/out/graph.gfa", f"{p}/csv")
    assert written(f"{p}/csv/nodes") == ["Id;Weight", "0;1", "1;2", "2;2"] and written(f"{p}/csv/edges") == ["Source;Target;Weight", "0;1;1", "1;2;1", "2;1;1"]
    (tmp_path / "labels.tsv").write_text("1\tx\n1\tkinase\n9\tz\n")
    files.gfa_converter(spark, f"{p}/out/graph.gfa", f"{p}/csv2", labels=f"{p}/labels.tsv")
    assert written(f"{p}/csv2/nodes") == ["Id;Weight;Label", '0;1;"None"', '1;2;"kinase"', '2;2;"None"']
    (tmp_path / "odd.gfa").write_text("S\t7\t\nS\t8\tACGT\tFC:i:3\nL\t7\t+\t8\t+\t\n")
    files.gfa_converter(spark, f"{p}/odd.gfa", f"{p}/csv3")
    assert written(f"{p}/csv3/nodes") == ["Id;Weight", "7", "8;3"] and written(f"{p}/csv3/edges") == ["Source;Target;Weight", "7;8"]
    assert sorted((r.Source, r.Target) for r in files.generate_labels(spark, f"{p}/out/graph.gfa", ["r1"]).collect()) == [("0", "1"), ("1", "2+")]


def test_other_commands(spark, inputs, tmp_path):
    p = str(tmp_path)
    files.gff2descriptions(spark, [f"{p}/x.gff"], p)
    (tmp_path / "x.blast").write_text("1\t150\t3\t150\t1\t150\t150\t90\t1e-20\t99\n2\t150\t3\t40\t1\t40\t40\t90\t1e-20\t99\n")
    files.graph_family(spark, f"{p}/gene_description", f"{p}/x.blast", f"{p}/fam")
    assert sorted(written(f"{p}/fam/gene_families")) == ["1\t1", "3\t1"] and "P\trefB\t1+\t-1" in written(f"{p}/fam/graph.gfa")
    assert files.alignment_metrics(spark, f"{p}/x.fa", f"{p}/x.paf", f"{p}/met").first().pct == 200.0  # four mapped reads by two sequences
    assert set(written(f"{p}/met/unmapped_reads")) == {"qname\tlength", "refA\t600", "refB\t108"}
    files.extract_genes(spark, [f"{p}/x.gff"], f"{p}/x.fa", f"{p}/genes")
    got = {r.name: r.seq for r in formats.read_fasta(spark, f"{p}/genes/genes.fna").collect()}
    assert got["3"] == ("ATGAAATTT" * 12)[:100] and len(got) == 4
    files.fetch_keys(spark, f"{p}/gene_description", ["dna,binding"], f"{p}/keys")
    assert written(f"{p}/keys/ids") == ["0"]
    (tmp_path / "want.tsv").write_text("refB\nrefA\t100\t320\n")
    files.fetch_subsequences(spark, f"{p}/x.fa", f"{p}/want.tsv", f"{p}/sub", gff=f"{p}/x.gff", normalize=True)
    assert {r.name: len(r.seq) for r in formats.read_fasta(spark, f"{p}/sub/subsequences.fa").collect()} == {"refB": 108, "refA_100_320": 220}
    assert sorted(x.split("\t")[0] + x.split("\t")[3] for x in written(f"{p}/sub/subsequences.gff")) == ["refA_100_32051", "refB1"]
    (tmp_path / "own.gff").write_text("##gff\nrefA\tx\ttRNA\t100\t321\t0.5\t-\t2\tID=t\nrefA\tx\tCDS\t99\t120\t.\t+\t0\tID=u\nrefA\tx\texon\t200\t322\t.\t?\t0\tID=v\nrefC\tx\tCDS\t1\t9\t.\t+\t0\tID=w\n")
    for normalize, line in ((False, "refA\tx\ttRNA\t100\t321\t0.5\t-\t2\tID=t"), (True, "refA_100_320\tx\ttRNA\t0\t221\t0.5\t-\t2\tID=t")):
        files.fetch_subsequences(spark, f"{p}/x.fa", f"{p}/want.tsv", f"{p}/own{normalize}", gff=f"{p}/own.gff", normalize=normalize)
        assert written(f"{p}/own{normalize}/subsequences.gff") == [line]
    files.sequence_store(spark, f"{p}/genes/genes.fna", f"{p}/db")
    assert spark.read.parquet(f"{p}/db/sequences").count() == 4
    (tmp_path / "m.fa").write_text(">x\nA-C\n>y\nA-C\n")
    files.sequence_graph(spark, {7: f"{p}/m.fa"}, f"{p}/res")
    assert written(f"{p}/res/graph.gfa") == ["H\tSequence-graph", "S\t7_0_A\t\tFC:i:1", "S\t7_2_C\t\tFC:i:1", "L\t7_0_A\t+\t7_2_C\t+\t\tFC:i:2", "P\tx\t7_0_A+,7_2_C+\t2", "P\ty\t7_0_A+,7_2_C+\t2"]
    (tmp_path / "x.gb").write_text('LOCUS       N1\nFEATURES\n     CDS             1..6\n                     /product="k"\n                     /translation="MK"\nORIGIN\n        1 atgaaa\n//\n')
    files.genbank_converter(spark, f"{p}/x.gb", f"{p}/gb")
    assert written(f"{p}/gb/genes.gff") == ["N1\t.\tCDS\t1\t6\t.\t+\t.\tprotein_id=N1_0;product=k"] and written(f"{p}/gb/proteins.fasta") == [">N1_0", "MK"]
    (tmp_path / "list.txt").write_text("a.gff\nb.gff\n\n")
    assert formats.read_file_list(spark, f"{p}/list.txt") == ["a.gff", "b.gff"]


def test_families_by_options_local_names_paf_and_dna_orientations(spark, inputs, tmp_path):
    p = str(tmp_path)
    files.gff2descriptions(spark, [f"{p}/x.gff"], p)
    blast = "{}\t{}\t{}\t{}\t1\t9\t50\t90\t1e-20\t99\n"
    (tmp_path / "near.blast").write_text(blast.format(1, 100, 3, 60))
    for k, (cov, want) in enumerate(((0.75, []), (0.5, ["1\t1", "3\t1"]))):
        files.graph_family(spark, f"{p}/gene_description", f"{p}/near.blast", f"{p}/f{k}", min_cov=cov)
        assert sorted(written(f"{p}/f{k}/gene_families")) == want and len(written(f"{p}/f{k}/homology_connectivity")) == len(want)
    (tmp_path / "local.blast").write_text(blast.format("P2", 100, "P3", 90))
    files.graph_family(spark, f"{p}/gene_description", f"{p}/local.blast", f"{p}/local", local_ids=True, metrics=False)
    assert sorted(written(f"{p}/local/gene_families")) == ["2\t2", "3\t2"] and not glob.glob(f"{p}/local/homology_connectivity")
    paf = "{}\t100\t0\t90\t{}\t{}\t100\t0\t90\t80\t90\t60\n"
    (tmp_path / "x2.paf").write_text(paf.format(0, "+", 3) + paf.format(1, "+", 1))
    files.graph_family(spark, f"{p}/gene_description", f"{p}/x2.paf", f"{p}/paf", blast=False)
    assert sorted(written(f"{p}/paf/gene_families")) == ["0\t0", "3\t0"]
    # Genes 1 (-) and 3 (+) agree only if their DNA aligns on -; the first of a pair's alignments counts, in either direction.
    (tmp_path / "pair.blast").write_text(blast.format(1, 100, 3, 100) + blast.format(0, 100, 3, 100))
    (tmp_path / "dna.paf").write_text(paf.format("P3", "-", "P1") + paf.format("P3", "+", "P1"))
    files.graph_family(spark, f"{p}/gene_description", f"{p}/pair.blast", f"{p}/split", split_ori=True, dna=f"{p}/dna.paf", dna_local_ids=True)
    assert sorted(written(f"{p}/split/gene_families")) == ["0\t0", "1\t0", "3\t0"]
    (tmp_path / "dna2.paf").write_text(paf.format("P3", "+", "P1"))
    files.graph_family(spark, f"{p}/gene_description", f"{p}/pair.blast", f"{p}/split2", split_ori=True, dna=f"{p}/dna2.paf", dna_local_ids=True)
    assert sorted(written(f"{p}/split2/gene_families")) == ["0\t0", "3\t0"]
    with pytest.raises(ValueError, match="DNA alignments"):
        files.graph_family(spark, f"{p}/gene_description", f"{p}/pair.blast", f"{p}/none", split_ori=True)


def test_names_of_an_architecture_in_several_lines(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "g.gfa").write_text("S\t1\t\tFC:i:1\nS\t2\t\tFC:i:1\nL\t1\t+\t2\t+\t\tFC:i:1\n" + "".join(f"P\tr{i}\t1+,2+\t9\n" for i in range(5)) + "P\tz\t2+\t9\nP\tr0\t2+\t9\n")
    files.path_metrics(spark, f"{p}/g.gfa", f"{p}/out", directed=True, names_per_line=3)
    assert written(f"{p}/out/architectures")[1:] == ["0\t1+,2+\t0\t4\tr1,r2,r3", "0\t1+,2+\t0\t4\tr4", "1\t2+\t0\t2\tr0,z"]


def test_single_files_hold_the_folders_lines_in_order(spark, tmp_path):
    lines = spark.createDataFrame([(i, f"line {i} é") for i in range(500)], "id int, value string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_lines(lines, f"{tmp_path}/folder", "id")
        writers.write_lines(lines, f"{tmp_path}/one.txt", "id", single=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted(p for p in (tmp_path / "folder").iterdir() if p.name.startswith("part-"))
    assert len(parts) > 1 and (tmp_path / "one.txt").is_file() and not (tmp_path / "one.txt.parts").exists()
    assert (tmp_path / "one.txt").read_text() == "".join(p.read_text() for p in parts) == "".join(f"line {i} é\n" for i in range(500))
    table = spark.createDataFrame([(2, "b\tc"), (1, None)], "x int, y string").orderBy("x")
    writers.write_table(table, f"{tmp_path}/t.tsv", header=True, single=True)
    assert (tmp_path / "t.tsv").read_text() == 'x\ty\n1\t\n2\t"b\tc"\n'
    writers.write_table(table.limit(0), f"{tmp_path}/none.tsv", header=True, quote_all=True, single=True)
    assert (tmp_path / "none.tsv").read_text() == '"x"\t"y"\n'


def test_a_store_is_pruned_and_joined_without_a_shuffle(spark, tmp_path):
    seqs = spark.range(5000).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("ACGT"), F.col("id").cast("string")).alias("seq"))
    writers.write_store(seqs, f"{tmp_path}/ranges")
    files_read = spark.read.parquet(f"{tmp_path}/ranges").where("id = 7").select(F.input_file_name()).distinct().collect()
    assert len(files_read) == 1
    bounds = [(min(b), max(b)) for b in ([r.id for r in spark.read.parquet(str(p)).collect()] for p in (tmp_path / "ranges").glob("part-*")) if b]
    assert all(a[1] < b[0] for a, b in zip(sorted(bounds), sorted(bounds)[1:]))
    writers.write_store(seqs, f"{tmp_path}/buckets", table="store_of_test", buckets=4)
    try:
        store = spark.table("store_of_test")
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan shows the buckets
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(store.where("id = 7")._jdf.queryExecution(), "formatted")
        assert "SelectedBucketsCount: 1 out of 4" in plan
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        asked = spark.createDataFrame([(i,) for i in range(0, 5000, 9)], "id int")
        joined = asked.join(store, "id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and joined.count() == 556
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.sql("drop table store_of_test")


def test_reports_without_reads(spark):
    aln = spark.createDataFrame([("r", 5, 0, 4, "+", "x", 9, 0, 4, 4, 60, 1)], "qname string, query_length int, qstart int, qend int, ori string, rname string, ref_length int, rstart int, rend int, align_length int, mapq int, line_no long")
    none = spark.createDataFrame([], "qname string, length int")
    assert [r.pct for r in commands.mapped_pct(aln, none).collect()] == [None]
    assert [r.align_cov for r in commands.alignment_metrics(aln, spark.createDataFrame([("r", 0)], "qname string, length int"))["alignment_sizes"].collect()] == [None]
