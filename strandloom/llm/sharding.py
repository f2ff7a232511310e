"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions only.

A row descends from the root to a region, a rack and a shard. At each node, every child gets a draw
``-ln(u) / weight`` with u a hash of (row key, child's name) in (0, 1); the least draw wins. A child
therefore gets its weight's share, and when weights change, rows move only into or out of subtrees whose
weights change: a child whose weight grows only gains rows, the order of all others stays.

``tree_of(n)`` is the layout of n shards: the first ``base`` shards fill regions of racks; every further
shard opens a region of its own, so that no older subtree changes its weight and rows move only into the
new shard (the law ``key``).

Slots number the rows of a shard from 0 without gaps, without one task per shard: keys, sizes and checksums
are written once, sorted into ranges, and the sizes of the ranges give each its first slot.

Defined results: a null key is the key "" of its own shard draw; a null text has size 1 and checksum 0; a very
long text is one row like any other, of which only size and checksum are kept; repeated rows share a
shard and get slots of their own, next to each other in any order; equal draws of two children go to the child with the
smaller number; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..storage import materialize

# (region, rack, shard, weight)
Tree = list[tuple[str, str, int, float]]


def tree_of(shards: int, base: int = 16, per_rack: int = 4, racks: int = 2) -> Tree:
    """The layout of ``shards`` shards of weight 1, at least ``base`` of them."""
    if shards < base:
        raise ValueError(f"a tree grows from {base} shards")
    out: Tree = []
    for s in range(base):
        rack = s // per_rack
        out.append((f"region{rack // racks}", f"rack{rack}", s, 1.0))
    return out + [(f"region-of-{s}", f"rack-of-{s}", s, 1.0) for s in range(base, shards)]


def _draw(key: Column, name: Column, weight: Column) -> Column:
    """The exponential draw of a child: the first 48 bits of an MD5, as a fraction inside (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), name).cast("binary")), 1, 12), 16, 10).cast("bigint")
    return -F.log((bits.cast("double") + 0.5) / float(1 << 48)) / weight


def _descend(key: Column, node: Column, children: list[list[tuple[str, float, int]]]) -> Column:
    """The number of the child of ``node`` with the least draw; children: (name, weight, number) of each node."""
    table = F.array(*[F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(k).alias("node")) for n, w, k in own if w > 0]) for own in children])
    draws = F.transform(F.get(table, node), lambda c: F.struct(_draw(key, c["name"], c["weight"]).alias("draw"), c["node"].alias("node")))
    return F.array_min(draws)["node"]


def place(key: Column, tree: Tree) -> Column:
    """The shard of a string key. Weights of inner nodes are sums over their leaves."""
    weights: dict[str, dict[str, dict[int, float]]] = {}
    for region, rack, shard, weight in tree:
        weights.setdefault(region, {}).setdefault(rack, {})[shard] = weight
    racks = [(g, r) for g, own in weights.items() for r in own]
    top = [[(g, sum(sum(s.values()) for s in own.values()), k) for k, (g, own) in enumerate(weights.items())]]
    middle = [[(r, sum(own[r].values()), racks.index((g, r))) for r in own] for g, own in weights.items()]
    leaves = [[(f"shard{s}", w, s) for s, w in weights[g][r].items()] for g, r in racks]
    return _descend(key, _descend(key, _descend(key, F.lit(0), top), middle), leaves)


def slots(placed: DataFrame, order: list[str], shard: str = "shard") -> DataFrame:
    """Adds ``slot``: 0, 1, ... within each shard, by a 32-bit hash of the columns ``order`` and then by these.

    A shard is numbered in ranges of that order, as many as the session's shuffles have partitions. Rows that are equal in
    all of ``order`` may lie in several ranges.
    """
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in order]).cast("binary")
    drawn = placed.withColumn("_draw", F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"))
    return number_rows(drawn, ["_draw", *order], "slot", within=(shard,)).drop("_draw")


def op8_hash_tree_shards(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    """Every document's shard, slot, and shard among one more, by the law ``key``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, tree_of(shards)).cast("int").alias("shard"),
        place(key, tree_of(shards + 1)).cast("int").alias("grown_shard"),
    )
    return slots(materialize(placed), ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
