import hashlib
import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from strandloom.llm import sharding


def by_hand(key, tree):
    def draw(name, weight):
        bits = int(hashlib.md5(f"{key}/{name}".encode()).hexdigest()[:12], 16)
        return -math.log((bits + 0.5) / 2**48) / weight

    level = tree
    for at in (0, 1):
        weights = {}
        for leaf in level:
            weights[leaf[at]] = weights.get(leaf[at], 0) + leaf[3]
        won = min(weights, key=lambda n: draw(n, weights[n])) if len(weights) > 1 else next(iter(weights))
        level = [leaf for leaf in level if leaf[at] == won]
    return min(level, key=lambda leaf: draw(f"shard{leaf[2]}", leaf[3]))[2] if len(level) > 1 else level[0][2]


def test_places_as_by_hand(spark):
    tree = sharding.tree_of(18)
    rows = spark.range(500).select(F.col("id"), sharding.place(F.col("id").cast("string"), tree).alias("s")).collect()
    assert all(r.s == by_hand(str(r.id), tree) for r in rows)


def test_growth_moves_rows_only_into_the_new_shard(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    for n in (16, 17, 18):
        moved = keys.select(sharding.place(F.col("k"), sharding.tree_of(n)).alias("a"), sharding.place(F.col("k"), sharding.tree_of(n + 1)).alias("b")).where("a <> b")
        rows = moved.groupBy("b").count().collect()
        assert [r.b for r in rows] == [n] and abs(rows[0]["count"] - 20_000 / (n + 1)) < 250


def test_a_weight_moves_rows_only_through_its_subtrees(spark):
    tree = sharding.tree_of(16)
    heavier = [(g, r, s, 2.0 if s == 5 else w) for g, r, s, w in tree]
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    moved = keys.select(sharding.place(F.col("k"), tree).alias("a"), sharding.place(F.col("k"), heavier).alias("b")).where("a <> b").collect()
    grown_region, grown_rack = {s for g, _, s, _ in tree if g == tree[5][0]}, {s for _, r, s, _ in tree if r == tree[5][1]}
    assert moved and all(m.b in grown_region for m in moved)
    assert all(m.b in grown_rack for m in moved if m.a in grown_region)


def test_query(spark, tmp_path):
    rows = [(i, f"text é {i % 7}", "x") for i in range(300)] + [(7, None, "y"), (None, "a", "z"), (5, "text é 5", "x"), (9, "", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, shard string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op8_hash_tree_shards(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.shard == by_hand("" if r.doc_id is None else str(r.doc_id), sharding.tree_of(16)) and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_one_row_many_times_and_a_long_text(spark, tmp_path):
    rows = [(7, "again")] * 3000 + [(i, "x" * (200_000 if i == 3 else 5)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    placed = sharding.op8_hash_tree_shards(spark, str(tmp_path))
    got = placed.collect()
    assert len(got) == len(rows) and max(r.size for r in got) == 200_001
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    mine = sorted(r.slot for r in got if (r.doc_id, r.size) == (7, 6))
    assert [b - a for a, b in zip(mine, mine[1:], strict=False)].count(1) >= len(mine) - 2


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sharding.op8_hash_tree_shards(spark, str(tmp_path)).count() == 0
