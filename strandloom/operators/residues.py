"""Sequence graphs of aligned families, and genes cut from sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import protein, reverse_complement

SLICE = 1 << 21  # letters whose neighbours are counted at once


def msa_nodes(msa: DataFrame) -> DataFrame:
    """gene_id, seqname, seq_id, aa: the residues of every aligned sequence with their columns (from 0); gaps leave none."""
    cells = msa.select("gene_id", "seqname", F.posexplode(F.split("aligned", "")).alias("seq_id", "aa"))
    return cells.where((F.col("aa") != "-") & (F.col("aa") != ""))


def seq_node_coverage(nodes: DataFrame) -> DataFrame:
    """gene_id, seq_id, aa, coverage (always 1: a node is counted once) and n_sequences, how many go through it."""
    return nodes.groupBy("gene_id", "seq_id", "aa").agg(F.lit(1).alias("coverage"), F.count("*").alias("n_sequences"))


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text ends."""
    column = column.fill_null("").cast(pa.large_string())
    ends = np.cumsum(pc.utf8_length(column).to_numpy())
    return np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32), ends


def adjacent_residues(gene: np.ndarray, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """gene, src, dst, first letter, second letter, count of the residues that follow each other in their row, counted together.

    points: the letters of all rows; ends: where each row ends in them; gene: of each row, sorted.
    """
    at = np.flatnonzero(points != ord("-"))
    row = np.searchsorted(ends, at, side="right")
    column = at - np.concatenate([[0], ends])[row]
    same = np.flatnonzero(row[1:] == row[:-1])
    src, dst, a, b = column[same], column[same + 1], points[at[same]].astype(np.int64), points[at[same + 1]].astype(np.int64)
    own, out = gene[row[same]], []
    if not len(own):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    bounds = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
    for low, high in zip(bounds, np.append(bounds[1:], len(own)), strict=True):
        s, gap, x, y = src[low:high], (dst - src)[low:high], a[low:high], b[low:high]
        if gap.max() < 1 << 16 and max(x.max(), y.max()) < 1 << 8:  # column, gap and both letters are one number
            keys, n = np.unique(s << 32 | gap << 16 | x << 8 | y, return_counts=True)
            found = (keys >> 32, keys >> 16 & 0xFFFF, keys >> 8 & 0xFF, keys & 0xFF)
        else:
            keys, n = np.unique(np.stack([s, gap, x, y], 1), axis=0, return_counts=True)
            found = tuple(keys.T)
        out.append((np.full(len(n), own[low]), found[0], found[0] + found[1], found[2], found[3], n))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def msa_edge_coverage(msa: DataFrame) -> DataFrame:
    """gene_id, src, src_aa, dst, dst_aa, coverage of adjacent residues. They are paired and counted within slices of rows: only counts are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy()
            part = np.cumsum(size) // SLICE
            for k in np.unique(part):
                rows = batch.filter(pa.array(part == k)).sort_by("gene_id")
                gene, src, dst, a, b, n = adjacent_residues(rows.column(0).to_numpy(), *_letters(rows.column(1)))
                known, letters = np.unique(np.concatenate([a, b]), return_inverse=True)
                text = pa.array([chr(c) for c in known], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(gene, pa.int64()), pa.array(src.astype(np.int32)), text.take(pa.array(letters[: len(a)])), pa.array(dst.astype(np.int32)), text.take(pa.array(letters[len(a) :])), pa.array(n)], ["gene_id", "src", "src_aa", "dst", "dst_aa", "n"])

    kind = msa.schema["gene_id"].dataType
    counted = msa.select(F.col("gene_id").cast("bigint").alias("gene_id"), F.col("aligned").cast("string").alias("aligned")).where("gene_id is not null").mapInArrow(count, "gene_id bigint, src int, src_aa string, dst int, dst_aa string, n bigint")
    return counted.groupBy("gene_id", "src", "src_aa", "dst", "dst_aa").agg(F.sum("n").alias("coverage")).withColumn("gene_id", F.col("gene_id").cast(kind))


def extract_genes(genes: DataFrame, sequences: DataFrame) -> DataFrame:
    """id, fna, faa of genes that fit their sequence: forward DNA in upper case, and the protein read on the gene's strand.

    genes: id, seq_key, gstart, gend, ori; sequences: seq_key, seq.
    """
    cut = genes.join(sequences, "seq_key").where(F.col("gend") <= F.length("seq"))
    fna = F.upper(F.substring(F.col("seq"), F.col("gstart") + 1, F.col("gend") - F.col("gstart")))
    dna = cut.select("id", "ori", fna.alias("fna"))
    return dna.select("id", "fna", protein(F.when(F.col("ori") == "+", F.col("fna")).otherwise(reverse_complement(F.col("fna")))).alias("faa"))
