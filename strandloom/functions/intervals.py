"""Column expressions over intervals given by a start and an end column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size(start: Column, end: Column) -> Column:
    """end - start + 1, whether or not the end belongs to the interval."""
    return end - start + 1


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """min(ends) - max(starts); 0 when the intervals touch, negative when they lie apart."""
    return F.least(e1, e2) - F.greatest(s1, s2)


def contains(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= s2) & (e1 >= e2)


def coverage(gene_start: Column, gene_end: Column, start: Column, end: Column) -> Column:
    """The share of a gene's size that an alignment covers."""
    return overlap(gene_start, gene_end, start, end) / size(gene_start, gene_end).cast("double")


def rescale(a: Column, b: Column, low: Column, high: Column, x: Column) -> Column:
    """x of [low, high] projected linearly onto [a, b], cut towards 0; null if low = high."""
    a, b, low, high, x = (c.cast("double") for c in (a, b, low, high, x))
    return ((b - a) * (x - low) / F.nullif(high - low, F.lit(0.0)) + a).cast("int")
