"""Keyword search over descriptions, id remapping, labels from paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Patterns that part descriptions and rendered paths (fixed values).
WORD_BREAK, STEP_BREAK = r"[\s+\|\W+]", "[+|-],"


def tokens(description: Column) -> Column:
    """Lower-cased pieces between single characters that are no word characters, or + or |."""
    return F.array_distinct(F.filter(F.split(F.lower(description), WORD_BREAK), lambda x: x != ""))


def keyword_match(genes: DataFrame, lines: list[str], key: str = "id", description: str = "description") -> DataFrame:
    """key, line: a row for each gene and key line all of whose words its description has.

    Key lines are a query set given by the caller; each is one array test per row, with no join.
    """
    wanted = F.array(*[F.struct(F.lit(line).alias("line"), tokens(F.lit(line)).alias("keys")) for line in lines])
    hits = F.filter(wanted, lambda w: F.size(F.array_except(w["keys"], F.col("_tokens"))) == 0)
    found = genes.withColumn("_tokens", tokens(F.col(description))).select(key, F.explode(hits).alias("_hit"))
    return found.select(key, F.col("_hit.line").alias("line"))


def remapped(ids: DataFrame, mapping: DataFrame, key: str = "id") -> DataFrame:
    """Distinct ids after mapping (old -> new); ids without a mapping stay."""
    to = mapping.select(F.col("old").alias(key), F.col("new").alias("_new"))
    return ids.join(to, key, "left").select(F.coalesce("_new", key).alias(key)).distinct()


def label_edges(paths: DataFrame, strip_last: bool = False) -> DataFrame:
    """name, source, target: adjacent ids of rendered paths; the last id keeps its sign unless stripped."""
    ids = F.split("path", STEP_BREAK)
    if strip_last:
        ids = F.transform(ids, lambda x: F.regexp_replace(x, "[+-]$", ""))
    pair = F.explode(F.filter(F.arrays_zip(ids.alias("source"), F.slice(ids, F.lit(2), F.size(ids)).alias("target")), lambda p: p["target"].isNotNull()))
    return paths.where(F.size(ids) > 1).select("name", pair.alias("_p")).select("name", "_p.source", "_p.target")
