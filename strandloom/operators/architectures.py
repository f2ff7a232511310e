"""Paths as wholes: gathering, canonical forms, frequencies, distances."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .numbering import number_rows

# Rows of a block of path_distances and all_pairwise, and numbers of a table of distances at once: what a core's cache holds.
BLOCK, CELLS = 1024, 1 << 19
# Pairs of blocks of path_distances in a task, and the most tasks.
MEET, MOST_TASKS = 4, 20_000


def gathered(steps: DataFrame) -> DataFrame:
    """name, path: the steps of each path in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "id", "ori")))
    return steps.groupBy("name").agg(ordered.alias("_s")).select("name", F.transform("_s", lambda s: F.struct(s["id"].alias("id"), s["ori"].alias("ori"))).alias("path"))


def canonical_paths(paths: DataFrame, min_length: int = 1) -> DataFrame:
    """name, path (canonical) of the paths that are not empty; a ``size`` column below min_length drops a path."""
    kept = paths.where(F.size("path") > 0)
    if "size" in paths.columns:
        kept = kept.where(F.col("size") >= min_length)
    return kept.select("name", P.canonical(F.col("path")).alias("path"))


def architectures(canonical: DataFrame) -> DataFrame:
    """id, path, single_ori, n, first_name: distinct canonical paths, numbered from the most frequent on; ties by path."""
    counted = canonical.groupBy("path").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))
    shown = counted.select(P.rendered(F.col("path")).alias("path"), P.both_orientations(F.col("path")).alias("single_ori"), "n", "first_name")
    return number_rows(shown, [F.desc("n"), "path"], "id")


def architecture_names(canonical: DataFrame, numbered: DataFrame) -> DataFrame:
    """id, name: every path of every architecture, one row each; canonical: name, path; numbered: what architectures gave."""
    named = canonical.select("name", P.rendered(F.col("path")).alias("path"))
    return named.join(numbered.select("id", "path"), "path").select("id", "name")


def all_pairwise(ids: DataFrame, column: str) -> DataFrame:
    """a, b: every pair of distinct ids with a < b. The result is quadratic; meant for summaries such as architectures.

    Ids are numbered and cut into blocks; every id is sent to every block, and they meet by an equi-join on the block.
    """
    one = number_rows(ids.select(F.col(column).alias("b")).distinct(), ["b"], "_at").withColumn("_block", F.floor(F.col("_at") / BLOCK).cast("int"))
    blocks = max(1, -(-one.count() // BLOCK))
    # Those from a's own block on: ids before it are no larger.
    sent = one.select(F.col("b").alias("a"), F.explode(F.sequence(F.col("_block"), F.lit(blocks - 1))).alias("_block"))
    return sent.join(one.select("b", "_block"), "_block").where("a < b").select("a", "b")


def _edits(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levenshtein distances of all rows of a with all of b, and whether they share a value; padding of a and b differs."""
    n, m = len(a), len(b)
    kind = np.uint8 if a.shape[1] + b.shape[1] < 255 else np.int32  # the narrowest that holds every distance
    before = np.broadcast_to(np.arange(b.shape[1] + 1, dtype=kind)[:, None, None], (b.shape[1] + 1, n, m)).copy()
    now, out, apart = np.empty_like(before), np.broadcast_to(b_size.astype(np.int32), (n, m)).copy(), np.ones((n, m), bool)
    least, differ, other = np.empty((n, m), kind), np.empty((n, m), bool), np.ascontiguousarray(b.T)
    ones = differ.view(np.uint8)
    for i in range(1, a.shape[1] + 1):
        now[0] = i
        for j in range(1, b.shape[1] + 1):
            np.not_equal(a[:, i - 1, None], other[j - 1], out=differ)
            apart &= differ
            np.minimum(before[j], now[j - 1], out=least)
            least += 1
            np.add(before[j - 1], ones, out=now[j], casting="unsafe")
            np.minimum(now[j], least, out=now[j])
        ended = np.flatnonzero(a_size == i)
        for size in np.unique(b_size) if len(ended) else ():
            there = np.flatnonzero(b_size == size)
            out[np.ix_(ended, there)] = now[size][np.ix_(ended, there)]
        before, now = now, before
    return out, ~apart


def _padded(ids: list[list[int]], fill: int, back: bool = False, kind: type = np.int32) -> np.ndarray:
    out = np.full((len(ids), max(map(len, ids), default=0)), fill, kind)
    for k, x in enumerate(ids):
        out[k, : len(x)] = x[::-1] if back else x
    return out


def _block_distances(a: list, b: list, same: bool, turn: bool = True):
    """Index arrays and distances of the pairs of two blocks of (id, ids); for a block with itself, of each pair in one order.

    Without ``turn`` ids are not read backwards, and there are no distances but the edits.
    """
    names = {x: k for k, x in enumerate(sorted({x for x, _ in a + b}))}
    code: dict = {}
    b_ids = [[code.setdefault(x, len(code)) for x in ids] for _, ids in b]
    a_ids = [[code.setdefault(x, len(code)) for x in ids] for _, ids in a]
    b_rank, b_size = np.array([names[x] for x, _ in b]), np.array([len(x) for x in b_ids])
    kind = np.int8 if len(code) < 128 else np.int32  # codes are counted from 0
    forward, backward = _padded(b_ids, -2, False, kind), _padded(b_ids, -2, True, kind) if turn else None
    step = max(1, CELLS // ((forward.shape[1] + 1) * len(b)))
    for at in range(0, len(a), step):
        part = a_ids[at : at + step]
        size, padded = np.array([len(x) for x in part]), _padded(part, -1, False, kind)
        rank = np.array([names[x] for x, _ in a[at : at + step]])
        # Reading both ids backwards changes nothing, so two of the four forms are enough.
        edits, shared = _edits(padded, size, forward, b_size)
        i, j = np.nonzero(rank[:, None] < b_rank[None, :] if same else rank[:, None] != b_rank[None, :])
        distance = None
        if turn:
            turned, _ = _edits(padded, size, backward, b_size)
            distance = np.where(shared, np.minimum(edits, turned) / np.maximum(np.minimum(size[:, None], b_size[None, :]), 1), 1.0)[i, j]
        yield i + at, j, rank[i] > b_rank[j], edits[i, j], distance


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """x >= 0 rounded as Spark's round does, halves of the written number upwards."""
    scaled = x * 10.0**digits + 0.5
    whole = np.floor(scaled)
    out = whole / 10.0**digits
    close = np.abs(scaled - np.round(scaled)) < 1e-3  # as near to a half as a product may be off
    if close.any():
        values, at = np.unique(x[close], return_inverse=True)
        unit = Decimal(1).scaleb(-digits)
        out[close] = np.array([float(Decimal(repr(float(v))).quantize(unit, ROUND_HALF_UP)) for v in values])[at]
    return out


def path_distances(named: DataFrame, queries: DataFrame | None = None, *, both: bool = False, digits: int | None = None, only: str | None = None) -> DataFrame:
    """a, b, edits, distance over all pairs of rows (id, ids: array) with a < b; or, with queries (rows of named), of each of these, as a, with all others.

    With ``both``, every pair comes both ways round, and is compared once. ``digits`` rounds the distance; ``only`` is the one column, edits or distance, that is
    made. As all_pairwise, quadratic in what it returns, or the product of both sizes. Rows are numbered by length and cut into blocks; each
    pair of blocks is one group of an equi-join on the two blocks' numbers, so every row is sent once per block of the other side.
    """
    kind = named.schema["id"].dataType.simpleString()

    def numbered(df: DataFrame) -> tuple[DataFrame, int]:
        rows = number_rows(df.select("id", "ids").withColumn("_n", F.size("ids")), ["_n", "id"], "_at")
        return rows.select("id", "ids", F.floor(F.col("_at") / BLOCK).cast("int").alias("own")), max(1, -(-rows.count() // BLOCK))

    rows, blocks = numbered(named)
    if queries is None:
        others = blocks
        each = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        sent = each.select("id", "ids", (F.col("own") != F.least("own", "other")).alias("right"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    else:
        asked, others = numbered(queries)
        left = asked.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "ids", F.lit(False).alias("right"), F.col("own").alias("i"), "j")
        sent = left.unionByName(rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select("id", "ids", F.lit(True).alias("right"), "i", F.col("own").alias("j")))
    whole = queries is None
    kinds = {k: v for k, v in (("edits", "int"), ("distance", "double")) if only in (None, k)}

    def pairs(table: pa.Table) -> pa.Table:
        same = whole and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        ids = list(zip(table.column("id").to_pylist(), table.column("ids").to_pylist(), table.column("right").to_pylist(), strict=True))
        first = [(x, v) for x, v, r in ids if same or not r]
        second = first if same else [(x, v) for x, v, r in ids if r]
        typ = table.schema.field("id").type
        ends = pa.concat_arrays([pa.array([x for x, _ in side], typ) for side in (first, second)])
        schema = pa.schema([("a", typ), ("b", typ), *((k, pa.int32() if k == "edits" else pa.float64()) for k in kinds)])
        out = []
        for x, y, swap, e, d in _block_distances(first, second, same, "distance" in kinds):
            y = y + len(first)
            cells = {"edits": e, "distance": d if d is None or digits is None else _rounded(d, digits)}
            if both:
                ways = [(x, y), (y, x)]
            elif whole:
                ways = [(np.where(swap, y, x), np.where(swap, x, y))]
            else:
                ways = [(x, y)]
            out += [pa.record_batch([ends.take(pa.array(a)), ends.take(pa.array(b)), *(pa.array(cells[k], schema.field(k).type) for k in kinds)], schema=schema) for a, b in ways]
        return pa.Table.from_batches(out, schema)

    cores = named.sparkSession.sparkContext.defaultParallelism
    met = blocks * (others + 1) // 2 if whole else blocks * others
    dealt = sent.repartition(max(cores, min(MOST_TASKS, met // MEET)), "i", "j")
    return dealt.groupBy("i", "j").applyInArrow(pairs, ", ".join([f"a {kind}, b {kind}", *(f"{k} {v}" for k, v in kinds.items())]))


def distance_matrix(distances: DataFrame, ids: DataFrame) -> DataFrame:
    """a, b, distance in long form: symmetric, 0 on the diagonal."""
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = distances.select(ways.alias("w"), "distance").select("w.a", "w.b", "distance")
    return both.unionByName(ids.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance")))
