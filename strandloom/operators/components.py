"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, release

PART = 1 << 20  # edges that are contracted at once


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _least(pairs: DataFrame) -> DataFrame:
    """src, low: the least of each node and its neighbours.

    Written before it is joined, so that the join's two sides are shuffled on their own and the rows of a
    node with very many neighbours can be split, or the small side be broadcast.
    """
    return materialize(pairs.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low")))


def _mark(edges: DataFrame) -> tuple:
    """Number and checksum of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0 .. n - 1 that each is connected to by the edges (a, b)."""
    low = np.arange(n)
    while len(a):
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        while (low != low[low]).any():
            low = low[low]
        apart = low[a] != low[b]
        a, b = a[apart], b[apart]
    return low


def contracted(edges: DataFrame) -> DataFrame:
    """src, dst: stars that connect what the edges (of whole numbers) connect, made where the edges lie.

    Every PART edges of a task leave at most one edge for each node they touch, from it to the least node it is connected to there, and self-loops once.
    """
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def star() -> pa.RecordBatch:
            ends = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1)]
            nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
            low = _labels(len(nodes), at[: len(ends[0])], at[len(ends[0]) :])
            hit = np.flatnonzero(low != np.arange(len(nodes)))
            loops = np.unique(ends[0][ends[0] == ends[1]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([nodes[hit], loops])), pa.array(np.concatenate([nodes[low[hit]], loops]))], ["src", "dst"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PART:
                yield star()
                held, size = [], 0
        if size:
            yield star()

    return edges.select("src", "dst").mapInArrow(run, f"src {kind}, dst {kind}")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60, contract: bool = False) -> DataFrame:
    """(id, component) of every node of an edge; component is the least id reachable.

    Rows with a null end and self-loops link nothing (a node with a self-loop alone is its own component).
    Every round's edges are written to the shared folder, so lost executors cost one round at most; the tables of the round
    before are removed. With ``contract``, edges (of whole numbers) are contracted where they lie before the first round; of little use for those that are
    forests already.
    """
    ends = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
    ends = contracted(ends) if contract else ends
    # Written with the self-loops, so that the edges are made once.
    now = written = materialize(ends.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    loops, near = written.where("src = dst").select(F.col("src").alias("id")), written.where("src <> dst")
    mark = _mark(near)
    for _ in range(most_rounds):
        pairs = _both(near)
        least = _least(pairs)
        linked = pairs.join(least, "src").where("dst > src")
        down = materialize(linked.select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct())
        least_down = _least(down)
        linked = down.join(least_down, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        last, now = now, materialize(linked.unionByName(least_down.select("src", F.col("low").alias("dst"))).where("src <> dst").distinct())
        near, before, mark = now, mark, _mark(now)
        release(*([] if last is written else [last]), least, down, least_down)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = now.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("id"), F.col("dst").alias("component")))
    return found.unionByName(loops.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
