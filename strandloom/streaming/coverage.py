"""Node and edge coverage of a stream of paths: additive counts, kept by Structured Streaming.

A row is a whole path (name, path: array of struct<id, ori>), so that adjacent steps are never torn apart by
micro-batches. With a timestamp column and a watermark, counts are per window and late rows beyond the
watermark are left out; without them, the counts run over the whole stream (output mode complete or update).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _grouped(df: DataFrame, keys: list[str], time: str | None, window: str) -> DataFrame:
    by = [F.window(time, window).alias("window")] if time else []
    return df.groupBy(*by, *keys).agg(F.count("*").alias("coverage"))


def _watched(paths: DataFrame, time: str | None, late: str) -> DataFrame:
    return paths.withWatermark(time, late) if time else paths


def node_coverage(paths: DataFrame, time: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """[window,] id, coverage"""
    kept = [time] if time else []
    steps = _watched(paths, time, late).select(*kept, F.explode(F.transform("path", lambda g: g["id"])).alias("id"))
    return _grouped(steps, ["id"], time, window)


def edge_coverage(paths: DataFrame, directed: bool = True, time: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """[window,] src, dst, coverage of adjacent steps; undirected, each traversal counts both ways."""
    kept = [time] if time else []
    n = F.size("path")
    heads, tails = F.slice("path", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("path", F.lit(2), F.greatest(n - 1, F.lit(0)))
    pairs = F.zip_with(heads, tails, lambda a, b: F.struct(a["id"].alias("src"), b["id"].alias("dst")))
    if not directed:
        pairs = F.concat(pairs, F.zip_with(tails, heads, lambda a, b: F.struct(a["id"].alias("src"), b["id"].alias("dst"))))
    edges = _watched(paths, time, late).select(*kept, F.explode(pairs).alias("e")).select(*kept, "e.src", "e.dst")
    return _grouped(edges, ["src", "dst"], time, window)
