"""Column expressions over paths: arrays of struct<id, ori>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flipped(ori: Column) -> Column:
    return F.when(ori == "+", "-").otherwise("+")


def ids(path: Column) -> Column:
    return F.transform(path, lambda g: g["id"])


def reversed_path(path: Column) -> Column:
    """The path read from the other strand."""
    return F.transform(F.reverse(path), lambda g: F.struct(g["id"].alias("id"), flipped(g["ori"]).alias("ori")))


def both_orientations(path: Column) -> Column:
    """0 if all steps have one orientation, 1 if both occur."""
    return F.size(F.array_distinct(F.transform(path, lambda g: g["ori"]))) - 1


def canonical(path: Column) -> Column:
    """One of the two readings: the forward one of a single orientation, else the one with the smaller ids, else as is."""
    back = reversed_path(path)
    single = both_orientations(path) == 0
    return F.when(single & (F.get(path, F.lit(0))["ori"] == "+"), path).when(single, back).when(ids(back) < ids(path), back).otherwise(path)


def rendered(path: Column) -> Column:
    """1+,2-,3+"""
    return F.array_join(F.transform(path, lambda g: F.concat(g["id"].cast("string"), g["ori"])), ",")


def parsed(text: Column) -> Column:
    """The path of 1+,2-,3+; empty for an empty text."""
    steps = F.filter(F.split(text, ","), lambda x: x != "")
    return F.transform(steps, lambda x: F.struct(F.regexp_extract(x, "^(-?[0-9]+)", 1).cast("int").alias("id"), F.right(x, F.lit(1)).alias("ori")))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays, with unit costs: rows of the dynamic programme in a nested fold."""
    start = F.sequence(F.lit(0), F.size(b))

    def row(previous: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            cost = F.least(F.get(previous, j) + 1, F.element_at(acc, -1) + 1, F.get(previous, j - 1) + F.when(F.get(b, j - 1) == x, 0).otherwise(1))
            return F.concat(acc, F.array(cost))

        return F.aggregate(F.filter(F.sequence(F.lit(0), F.size(b)), lambda j: j > 0), F.array(F.get(previous, F.lit(0)) + 1), cell)

    return F.element_at(F.aggregate(a, start, row), -1)


def normalised_distance(a: Column, b: Column) -> Column:
    """Least edit distance over both readings of either id array, by the smaller length; 1 without a common id."""
    forms = [edit_distance(x, y) for x in (a, F.reverse(a)) for y in (b, F.reverse(b))]
    return F.when(F.arrays_overlap(a, b), F.least(*forms) / F.least(F.size(a), F.size(b)).cast("double")).otherwise(F.lit(1.0))
