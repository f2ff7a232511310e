"""Bloom filters of 64-bit hashes, of bounded size, built by Spark and tested inside tasks or by column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS, BITS_EACH, PROBES = 1 << 10, 1 << 28, 32, 6


def _probe(hashes: np.ndarray, i: int, bits: int) -> np.ndarray:
    return (hashes + np.uint64(i) * ((hashes >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)


def built(hashes: DataFrame) -> np.ndarray:
    """The filter of the only column of hashes (bigint), as words of 64 bits: about BITS_EACH bits for each row, at most MOST_BITS in all."""
    wanted = BITS_EACH * hashes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(wanted - 1, 1).bit_length()))

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([_probe(own, i, bits) for i in range(PROBES)]))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["at", "mask"])

    found = hashes.mapInArrow(run, "at int, mask bigint").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[found.column("at").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return table


def inside(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through: all that it was built from, and few others."""
    left = np.arange(len(hashes))
    for i in range(PROBES):
        at = _probe(hashes[left], i, len(table) * 64)
        left = left[(table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    out = np.zeros(len(hashes), bool)
    out[left] = True
    return out


def passing(rows: DataFrame, hashes: Column, table: np.ndarray, through: bool = True) -> DataFrame:
    """The rows whose hash the filter lets through, or the others; without a Python worker. The filter goes to all tasks as one row."""
    name = "_bloom"
    while name in rows.columns:
        name += "_"
    words = pa.table({name: pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), pa.array(table.view(np.int64)))})
    mask = F.lit(len(table) * 64 - 1).cast("bigint")
    step = F.shiftrightunsigned(hashes, 32).bitwiseOR(F.lit(1).cast("bigint")).bitwiseAND(mask)
    hit = F.lit(True)
    for i in range(PROBES):  # as _probe, in parts that stay within a long
        at = (hashes.bitwiseAND(mask) + F.lit(i).cast("bigint") * step).bitwiseAND(mask)
        word = F.get(F.col(name), F.shiftright(at, 6).cast("int"))
        bit = F.element_at(F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("bigint") for k in range(64)]), at.bitwiseAND(F.lit(63).cast("bigint")).cast("int") + 1)
        hit = hit & (word.bitwiseAND(bit) != 0)
    one = rows.sparkSession.createDataFrame(words)
    return rows.crossJoin(F.broadcast(one)).where(F.coalesce(hit, F.lit(False)) if through else ~F.coalesce(hit, F.lit(False))).drop(name)
