"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DRAWS = 1 << 40


def labelled(labels: DataFrame, label: str, doc_id: str) -> DataFrame:
    """doc_id, y: every labelled document once per label it has, however often a row is repeated."""
    return labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).distinct()


def least_drawn(known: DataFrame, n: int, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of known (doc_id, y; n rows in all), those with the least hashes of doc_id, and ``draw``, the hash.

    Rows that are hardly among them are left out before they are sorted.
    """
    drawn = known.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(DRAWS)))
    near = min(DRAWS, int(DRAWS * (2 * most + 100) / max(1, n)))
    return drawn.where(F.col("draw") < near).orderBy("draw", "doc_id", "y").limit(most)


def texts_of(docs: DataFrame, drawn: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The columns of drawn, which is bounded, and ``text``: one text of each document, the least where rows share a doc_id."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.join(F.broadcast(drawn), "doc_id").groupBy(drawn.columns).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
