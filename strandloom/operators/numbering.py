"""Consecutive numbers over a whole table or within its groups, by prefix sums over ranges: no task sorts or counts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def _written(rows: DataFrame) -> DataFrame:
    """The rows with ``_written_at``: which task wrote a row, and as which of its rows; written, so that counting and numbering see the same."""
    return materialize(rows.withColumn("_written_at", F.monotonically_increasing_id()))


def _shifted(kept: DataFrame, ranges: list[Column], within: tuple[str, ...], name: str, first: int, ranks: DataFrame | None = None) -> DataFrame:
    """Adds ``name``: rows of a range lie next to each other in ``_written_at``; ranges follow each other by their columns, or by ``ranks`` of the first of these before.

    One row per range (and group) says how far its rows' ``_written_at`` are from their numbers; that table is written, so that Spark
    sees whether it is small enough to be broadcast.
    """
    groups, own = [f"_w{k}" for k in range(len(within))], [f"_r{k}" for k in range(len(ranges))]
    cells = dict(zip([*groups, *own], [*map(F.col, within), *ranges], strict=True))
    sizes = kept.select(*(c.alias(n) for n, c in cells.items()), "_written_at").groupBy(*cells).agg(F.count("*").alias("_n"), F.min("_written_at").alias("_from"))
    order = [F.col(n) for n in own]
    if ranks is not None:
        sizes = sizes.join(F.broadcast(ranks.select(F.col("file").alias("_f"), "rank")), F.col("_r0") == F.col("_f"), "left")  # a row per file that the driver has listed
        order = [F.asc_nulls_last("rank"), *order]
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    shifts = materialize(sizes.select(*cells, (F.coalesce(before, F.lit(0)) - F.col("_from") + first).alias("_written_shift")))
    same = F.lit(True)
    for n, c in cells.items():
        same = same & c.eqNullSafe(F.col(n))
    return kept.join(shifts, same).withColumn(name, F.col("_written_at") + F.col("_written_shift")).drop("_written_at", "_written_shift", *cells)


def number_rows(df: DataFrame, order: list, name: str, first: int = 0, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``name``: first, first + 1, ... in the given order; anew in every group of the columns ``within``.

    Rows are dealt to ranges of the order and sorted there, in one shuffle.
    Rows that are equal in every column of the order are told apart by a running id, so that many of them do not
    meet in one range; which of them comes first is left open.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [*within, *order, "_tie"]
    kept = _written(tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie"))
    return _shifted(kept, [F.shiftright("_written_at", 33)], within, name, first)


def number_in_place(rows: DataFrame, name: str, first: int = 0, ranks: DataFrame | None = None) -> DataFrame:
    """Adds ``name`` to rows of read_lines (columns file, at) that were filtered and projected, but not shuffled since: by file, then as they stand in it.

    Nothing is sorted or shuffled but one row per split of a file. With ranks (file, rank), files come by rank, then by name, and those without one last.
    """
    return _shifted(_written(rows), [F.col("file"), F.col("at._block")], (), name, first, ranks)
