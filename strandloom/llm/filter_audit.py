"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

Every filter stores one table of the ids that fail it. The survivors of a prefix are the base rows left-anti joined with the
tables of its filters; they depend on which filters have run, not on their order, so k filters have 2^k of them. They are one table with
the set of filters as a column, and k joins make it: each adds the survivors of all sets so far with one more filter. The base left-semi joined with
one table gives all that fail it. What is counted are rows per part and set of filters; the rest is arithmetic on sets:
a filter removes the survivors before it less those after it, what fails it and was removed earlier is redundant for it,
and what only it catches is what survives all the others but not it.

A row is named by ``id`` (doc_id, 0 for null) and ``key`` (a hash of the text and of whether doc_id is null), so that rows which share a
doc_id are told apart by their texts. Rows that are equal in all that counts are one row of weight ``n`` before anything is shuffled by key,
and the copies of one text are counted by a hash of it: no group of copies or of repeated rows lands in one task.

Defined results: a null text is empty, and has no word; a null lang is the part ""; rows with a null doc_id count, are labelled by nothing and
neither fail the copy filter nor make others fail it; of rows that share a doc_id and a text none is a copy of the other;
repeated rows count as often as they occur; a document is good (toxic) if any of its labels says 1, and labels of no document count for nothing; very
long texts are judged whole; a value at its limit does not fail; an empty table of documents has no parts and gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, release, spread
from .text import Texts, repeated, slices, sums

KEYS = ["id", "key"]
_CAPITAL, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SYMBOL[list(b"#$%&*|")] = True


def text_filters(texts: Texts) -> dict[str, np.ndarray]:
    """Failure conditions that a text decides on its own; words are ``[^\\x20\\x09-\\x0D]+``, told apart by 64-bit hashes within their text."""
    words, at = texts.words(), texts.offsets
    again = repeated(words.hashes(), words.doc)[1]
    distinct = words.per_doc - np.bincount(words.doc[again], minlength=texts.n)
    return {
        "A": words.per_doc < 100,
        "B": 100 * distinct < 80 * words.per_doc,
        "C": 100 * sums(_CAPITAL[texts.data], at) > 10 * sums((texts.data & 0xC0) != 0x80, at),
        "D": sums(_SYMBOL[texts.data], at) > 0,
    }


def described(docs: DataFrame, filters: Callable[[Texts], dict[str, np.ndarray]] = text_filters, names: str = "ABCD", *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """id, key, doc_id, part, digest, a boolean column for each of the filters (``names``), n: one row for all rows that are equal in these."""
    body = F.coalesce(F.col(text), F.lit(""))
    keys = [F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0)).alias("id"), F.xxhash64(F.col(doc_id).isNull(), body).alias("key")]
    known = [F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.md5(body.cast("binary"))).alias("digest")]
    rows = docs.select(*keys, *known, body.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(batch.num_columns - 1)):
                failed = filters(texts)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], *[pa.array(failed[name]) for name in names]], [*batch.schema.names[:-1], *names])

    kinds = "id bigint, key bigint, doc_id bigint, part string, digest binary, " + ", ".join(f"{name} boolean" for name in names)
    out = rows.mapInArrow(run, kinds)
    return out.groupBy(out.columns).agg(F.count("*").alias("n"))


def copies(rows: DataFrame) -> DataFrame:
    """The rows whose text a smaller doc_id has too."""
    several = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    return rows.join(several, "digest").where("doc_id > first").select(rows.columns)


def labelled(rows: DataFrame, labels: DataFrame, losses: dict[str, Column], doc_id: str = "doc_id") -> DataFrame:
    """Adds for each loss how many of the n rows it holds for: conditions on labels by name."""
    marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("bigint").alias("doc_id")).agg(*[F.max(F.coalesce(c, F.lit(False)).cast("bigint")).alias(name) for name, c in losses.items()])
    known = rows.where("doc_id is not null").join(marks, "doc_id", "left").select(*rows.columns, *[(F.col("n") * F.coalesce(name, F.lit(0))).alias(name) for name in losses])
    return known.unionByName(rows.where("doc_id is null").withColumns({name: F.lit(0).cast("bigint") for name in losses}))


def survivors(base: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """The rows of base once for each set of filters that they survive, told by ``run`` (bit k: the k-th of failing has run).

    What has survived the sets of the filters so far is left-anti joined with the next filter's table; that gives their survivors with it.
    """
    out = base.withColumn("run", F.lit(0))
    for k, table in enumerate(failing.values()):
        without = out if k == 0 else materialize(out)
        out = without.unionByName(without.join(table, KEYS, "left_anti").withColumn("run", F.col("run") + (1 << k)))
    return out


def audit(base: DataFrame, failing: dict[str, DataFrame], losses: list[str]) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, <loss>_lost, shapley.

    base: id, key, part, n and a column for each loss; failing: the ids and keys that fail a filter, by its one-letter name.
    """
    letters, every = list(failing), (1 << len(failing)) - 1
    counts = ["n", *losses]

    def counted(rows: DataFrame, run: Column, failed: int) -> DataFrame:
        return rows.groupBy("part", run.alias("run")).agg(*[F.sum(c).alias(c) for c in counts]).withColumn("failed", F.lit(failed))

    table = counted(survivors(base, failing), F.col("run"), -1)
    for k, ids in enumerate(failing.values()):
        table = table.unionByName(counted(base.join(ids, KEYS, "left_semi"), F.lit(-1), k))
    table = materialize(table)

    def by(column: str, among: str, size: int, name: str) -> Column:
        entries = F.map_from_entries(F.collect_list(F.when(F.col(among) >= 0, F.struct(F.col(among), F.col(column)))))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.element_at(entries, k), F.lit(0))).alias(name)

    parts = table.groupBy("part").agg(*[by(c, "run", every + 1, f"{c}_left") for c in counts], by("n", "failed", len(letters), "fails"))
    plan = [(*_step(order, k), "".join(letters[f] for f in order), k + 1) for order in permutations(range(len(letters))) for k in range(len(order))]
    steps = F.explode(F.from_json(F.lit("[" + ",".join(f'{{"f":{f},"before":{before},"after":{after},"filter_order":"{order}","step":{step}}}' for f, before, after, order, step in plan) + "]"), "array<struct<f:int,before:int,after:int,filter_order:string,step:int>>"))
    rows = parts.select("*", steps.alias("s")).select("*", "s.*")
    at = lambda column, run: F.get(f"{column}_left", run)
    bit = F.expr("shiftleft(1, f)")
    removed = at("n", F.col("before")) - at("n", F.col("after"))
    lost = [(at(c, F.col("before")) - at(c, F.col("after"))).alias(f"{c}_lost") for c in losses]
    # A filter comes right after just the filters of ``run`` in |run|! (k - 1 - |run|)! orders.
    orders = F.transform(F.sequence(F.lit(0), F.lit(every)), lambda run: F.when(run.bitwiseAND(bit) == 0, F.get(F.array(*[F.lit(factorial(n) * factorial(len(letters) - 1 - n)) for n in range(len(letters))]), F.bit_count(run)) * (at("n", run) - at("n", run.bitwiseOR(bit)))).otherwise(0))
    return rows.select(
        "part",
        "filter_order",
        "step",
        at("n", F.col("after")).alias("kept"),
        removed.alias("removed"),
        (F.get("fails", F.col("f")) - removed).alias("redundant"),
        (at("n", F.lit(every).bitwiseXOR(bit)) - at("n", F.lit(every))).alias("unique_fails"),
        *lost,
        F.aggregate(orders, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("shapley"),
    )


def _step(order: tuple[int, ...], k: int) -> tuple[int, int, int]:
    """The k-th filter of the order, and the sets of filters that have run before and after it."""
    before = sum(1 << f for f in order[:k])
    return order[k], before, before | 1 << order[k]


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the text filters and of the copy filter (E), with good and toxic documents as losses."""
    rows = materialize(described(docs))
    failed = {name: rows.where(name).select(KEYS) for name in "ABCD"} | {"E": copies(rows).select(KEYS)}
    failing = {name: materialize(ids) for name, ids in failed.items()}
    base = materialize(labelled(rows, labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}).select(*KEYS, "part", "n", "good", "toxic"))
    release(rows)
    return audit(base, failing, ["good", "toxic"])


def op13_failing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of five filters over all documents, per language."""
    return audit_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
