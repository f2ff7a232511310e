"""Cases of the findings of round 4."""

import gzip
import os
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandloom import storage
from strandloom.operators import architectures as R
from strandloom.operators import graph as G
from strandloom.plans import files, round_trips
from strandloom.plans.queries import QUERIES
from strandloom.sources import adapters as D

from .test_whole import LINES, edits, norm, orders, steps_of


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_distances_of_every_path_to_every_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 5)
    d = orders(spark, tmp_path)
    named = dict(enumerate(sorted({tuple(i for i, _ in p) for p in steps_of().values()}, key=lambda x: ",".join(map(str, x)))))
    pairs = [(a, b) for a in named for b in named if a != b]
    assert rows(QUERIES["path_edit_distance"](spark, d)) == sorted((a, b, edits(named[a], named[b])) for a, b in pairs)
    far = [(a, b, round(norm(named[a], named[b]), 6)) for a, b in pairs]
    assert rows(QUERIES["path_norm_distance"](spark, d)) == sorted(far)
    assert rows(QUERIES["path_distance_matrix"](spark, d)) == sorted([*far, *((a, a, 0.0) for a in named)])


def test_distances_are_compared_once_for_both_ways_and_rounded_as_spark_does(spark, monkeypatch):
    seen = Counter()
    made = R._block_distances
    monkeypatch.setattr(R, "_edits", lambda *x, f=R._edits: seen.update(edits=x[0].shape[0] * x[2].shape[0]) or f(*x))
    a, b = [(k, [k, 1]) for k in range(6)], [(k, [k]) for k in range(6, 9)]
    list(made(a, b, False, turn=False))
    assert seen["edits"] == 18
    x = np.array([k / n for n in (1, 3, 7, 64, 128, 640, 1280, 6400) for k in range(n)] + [0.0000005, 0.0000015, 0.0000025, 12.3456785, 1e3 + 0.0000005])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(1).select(F.round("x", 6)).collect()]
    assert R._rounded(x, 6).tolist() == want


PART = "p_partkey int, p_name string, p_type string, p_size int, p_brand string"


def test_files_of_pairs_are_written_read_and_removed_in_portions(spark, tmp_path, monkeypatch):
    parts = [(k, "red" if k % 3 else "blue", "t", k % 7, f"b{k % 4}") for k in range(40)]
    spark.createDataFrame(parts, PART).write.parquet(f"{tmp_path}/part.parquet")
    names = ["family_connectivity_files", "family_split_files"]
    whole = {n: rows(QUERIES[n](spark, str(tmp_path))) for n in names}
    monkeypatch.setattr(D, "SIDE", 4)
    monkeypatch.setattr(D, "PORTION", 150)
    portions = [rows(x, "q", "r") for x in D.homology_portions(spark, str(tmp_path))]
    pairs = sorted((a[0], b[0]) for a in parts for b in parts if a[0] < b[0] and a[1] == b[1])
    assert len(portions) == -(-len(pairs) // 150) > 2 and sorted(x for p in portions for x in p) == pairs
    put, there = round_trips._put, []
    monkeypatch.setattr(round_trips, "_put", lambda lines, path, *c: there.append((path, sum(os.path.exists(p) for p, _ in there if "/x-" in p))) or put(lines, path, *c))
    for n in names:
        assert rows(QUERIES[n](spark, str(tmp_path))) == whole[n]
    written = [(p, n) for p, n in there if "/x-" in p]
    assert len(written) == 2 * len(portions) and not any(n for _, n in written) and not any(os.path.exists(p) for p, _ in written)


def test_a_pair_of_keys_that_come_again_is_in_one_portion(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "PORTION", 10)
    parts = [(k // 2, "red" if k % 2 else "blue", "t", k % 7, f"b{k % 4}") for k in range(40)]
    spark.createDataFrame(parts, PART).write.parquet(f"{tmp_path}/part.parquet")
    assert len(D.homology_portions(spark, str(tmp_path))) == 1


def test_degrees_count_different_pairs_whichever_way_round(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (1, 3), (4, 4)], "q int, r int")
    assert rows(G.degrees(pairs)) == [(1, 2), (2, 1), (3, 1), (4, 1)]


def test_lines_of_paths_are_made_where_they_are_written(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(files, "materialize", lambda df: kept.append(storage.materialize(df)) or kept[-1])
    monkeypatch.setattr(files, "release", lambda *tables: None)
    (tmp_path / "a.fa").write_text("".join(f">s{k:02}\nA-{'CG'[k % 2]}\n" for k in range(20, 0, -1)))
    files.sequence_graph(spark, {1: f"{tmp_path}/a.fa"}, f"{tmp_path}/out", compression="gzip")
    files.sequence_graph(spark, {1: f"{tmp_path}/a.fa"}, f"{tmp_path}/one", single=True, compression="gzip")
    assert not any(r.value.startswith("P") for t in kept for r in t.collect()) and len(kept) == 2
    parts = sorted((tmp_path / "out/graph.gfa").glob("part-*"))
    lines = [x for p in parts for x in gzip.open(p, "rt").read().splitlines()]
    assert lines == (tmp_path / "one/graph.gfa").read_text().splitlines()
    assert lines[:2] == ["H\tSequence-graph", "S\t1_0_A\t\tFC:i:1"]
    assert lines[-20:] == [f"P\ts{k:02}\t1_0_A+,1_2_{'CG'[k % 2]}+\t2" for k in range(1, 21)]


def test_alignments_and_reads_are_compressed_and_tables_behind_files_go(spark, tmp_path, monkeypatch):
    d, put = orders(spark, tmp_path), []
    monkeypatch.setattr(round_trips, "_put", lambda *x, f=round_trips._put: put.append(f(*x)) or put[-1])
    there = lambda: {x for x in os.listdir(storage.shared_dir(spark)) if x.startswith("table-")}
    before = there()
    path = round_trips._paf(spark, d, f"{tmp_path}/x.paf")
    assert there() == before
    assert [f.split("\t")[0] for f in (r.value for r in spark.read.text(path).collect())] == [f"r{o}" for o, *_ in sorted(LINES)]
    reports = QUERIES["alignment_metrics_files"](spark, d)
    assert reports.where("report = 'read_length'").count() == 24
    for p in put:
        assert all(x.endswith(".lz4") for x in os.listdir(p) if x.startswith("part-"))


def test_blocks_that_meet_are_dealt_to_tasks_in_turn(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "SIDE", 16)
    monkeypatch.setattr(D, "PAIRS", 1024)
    parts = [(k, "red", "t", k % 7, f"b{k % 4}") for k in range(200)]
    spark.createDataFrame(parts, PART).write.parquet(f"{tmp_path}/part.parquet")
    pairs = D.homology(spark, str(tmp_path), placed=True, held=True)
    assert rows(pairs, "q", "r") == [(q, r) for q in range(200) for r in range(q + 1, 200)]
    # 325 pairs of blocks, of 8 by 8 parts at most, in 85 tasks.
    held = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) > 60 and max(held) <= 4 * 64
    plan = G.first_orientation(pairs, "bitscore", D.CELL)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "hashpartitioning(q" not in plan


def test_parts_are_sent_less_often_where_pairs_are_not_held(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "SIDE", 4)
    spark.createDataFrame([(k, "red", "t", k % 7, f"b{k % 4}") for k in range(64)], PART).write.parquet(f"{tmp_path}/part.parquet")
    far, near = (D.homology(spark, str(tmp_path), held=x) for x in (False, True))
    assert rows(far) == rows(near)
    assert len(rows(far)) == 64 * 63 // 2
