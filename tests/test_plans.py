"""What plans move, and how rows are spread: numbering, bins of levels, chains of one hot reference."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.operators import alignments, intervals, numbering, residues
from strandloom.sources import formats


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_numbered_where_they_stand(spark, tmp_path):
    """Files of several splits: numbers follow the files' order, and no line is sorted or shuffled."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        for k, n in enumerate((700, 3, 0, 400)):
            (tmp_path / f"f{k}.txt").write_text("".join(f"{k}:{i}\n" for i in range(n)))
        lines = formats.read_lines(spark, str(tmp_path))
        assert lines.select(F.spark_partition_id()).distinct().count() >= 4
        numbered = formats.number_lines(lines)
        got = [r.value for r in numbered.orderBy("line_no").collect()]
        assert got == [f"{k}:{i}" for k, n in enumerate((700, 3, 0, 400)) for i in range(n)]
        assert [r.line_no for r in numbered.orderBy("line_no").collect()] == list(range(1, 1104))
        plan = plan_of(numbered)
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Window" not in plan
        odd = numbering.number_in_place(lines.where(~F.col("value").endswith("7")), "n")
        assert [r.n for r in odd.orderBy("n").collect()] == list(range(odd.count()))
        assert [r.value for r in odd.orderBy("n").collect()] == [v for v in got if not v.endswith("7")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("within", [(), ("g",)])
def test_ranges_are_numbered_in_one_shuffle(spark, within):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, "a", "b"]), rnd.randrange(40), rnd.choice([None, 1.5])) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, y double").repartition(5)
    numbered = numbering.number_rows(df, ["x", F.desc("y")], "n", first=3, within=within)
    groups = {}
    for r in numbered.collect():
        groups.setdefault(r.g if within else 0, []).append((r.n, (r.x, r.y is None)))
    for found in groups.values():
        found.sort()
        assert [n for n, _ in found] == list(range(3, 3 + len(found))) and [k for _, k in found] == sorted(k for _, k in found)
    assert Counter((r.g, r.x, r.y) for r in numbered.collect()) == Counter(rows)
    assert "Window" not in plan_of(numbered)


def spans(rnd, n, lengths):
    out = []
    for i in range(n):
        start = rnd.randrange(0, 3_000_000)
        out.append((i, rnd.choice("xy"), start, start + rnd.choice(lengths)))
    return out


def test_spans_of_all_lengths_meet(spark):
    rnd = random.Random(2)
    for a_lengths, b_lengths in (([1, 50, 600], [10, 90]), ([0, 40, 5000, 200_000, 2_500_000], [1, 300, 70_000]), ([30], [3_000_000, 20])):
        a, b = spans(rnd, 120, a_lengths), spans(rnd, 120, b_lengths)
        left, right = spark.createDataFrame(a, "i long, k string, s int, e int"), spark.createDataFrame(b, "j long, h string, p int, q int")
        got = Counter((r.i, r.j) for r in intervals.overlap_join(left, right, ("k", "h"), (F.col("s"), F.col("e")), (F.col("p"), F.col("q")), 64).collect())
        assert got == Counter((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])


def test_a_long_alignment_makes_a_few_rows(spark):
    left = spark.createDataFrame([(1, "x", 10, 5_000_010)], "i long, k string, s int, e int")
    right = spark.createDataFrame([(j, "x", j * 1000, j * 1000 + 60) for j in range(6000)], "j long, h string, p int, q int")
    joined = intervals.overlap_join(left, right, ("k", "h"), (F.col("s"), F.col("e")), (F.col("p"), F.col("q")))
    assert joined.count() == sum(j * 1000 + 60 > 10 and j * 1000 < 5_000_010 for j in range(6000))
    low, high = 10 // (512 * 4096), 5_000_009 // (512 * 4096)
    assert high - low + 1 <= 4  # bins of the alignment's own level, in place of 9,766 of the lowest


def chained_by_hand(rows):
    """Folded in order, reference by reference."""
    out = Counter()
    for key in {r[0] for r in rows}:
        now = None
        for _, s, e in sorted(r for r in rows if r[0] == key and r[1] < r[2]):
            if now and now[1] > s:
                now = (now[0], max(now[1], e))
            else:
                if now:
                    out[key, *now] += 1
                now = (s, e)
        if now:
            out[key, *now] += 1
    return out


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_chains_of_one_hot_reference(spark, width):
    rnd = random.Random(3)
    rows = [("hot", s, s + rnd.choice([1, 3, 9, 200])) for s in [rnd.randrange(4000) for _ in range(600)]] + [("hot", 7, 9)] * 300 + [("cold", 5, 9), ("cold", 9, 12), ("cold", 8, 9), ("hot", 4500, 9000), ("hot", 5000, 5001), ("hot", 8999, 9500), ("hot", 9500, 9600)]
    df = spark.createDataFrame(rows, "rname string, rstart int, rend int").repartition(4)
    found = alignments.canonical_regions(df, width=width)
    assert Counter(map(tuple, found.collect())) == chained_by_hand(rows)


def test_no_task_holds_a_reference(spark):
    """The rows of one reference are windowed in as many groups as it has bins; by reference alone there is one row per bin."""
    rows = [("hot", s, s + 5) for s in range(0, 20_000, 2)]
    df = spark.createDataFrame(rows, "rname string, rstart int, rend int")
    windows = [line for line in plan_of(alignments.canonical_regions(df, width=100)).splitlines() if "Window [" in line]
    per_row = [w for w in windows if "_own" in w]
    assert per_row and all("_bin" in w.split("], [")[1] for w in per_row)
    assert alignments.canonical_regions(df, width=100).count() == 1


def test_adjacent_residues_of_wide_rows(spark):
    """Gaps and letters that do not fit the packed key are counted all the same."""
    rows = [(1, "a", "A-CG"), (1, "b", "A-CG"), (2, "c", "A" + "-" * 70_000 + "é漢"), (1, "d", ""), (2, "e", None), (1, "f", "---"), (2, "g", "T")]
    df = spark.createDataFrame(rows, "gene_id int, seqname string, aligned string")
    got = Counter(map(tuple, residues.msa_edge_coverage(df).select("gene_id", "src", "src_aa", "dst", "dst_aa", "coverage").collect()))
    assert got == Counter([(1, 0, "A", 2, "C", 2), (1, 2, "C", 3, "G", 2), (2, 0, "A", 70_001, "é", 1), (2, 70_001, "é", 70_002, "漢", 1)])
    assert residues.msa_edge_coverage(df.limit(0)).count() == 0
