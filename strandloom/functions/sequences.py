"""Column expressions over nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code (fixed values): amino acids of the codons in the order of BASES, first base slowest; _ stops.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY__CC_WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}


def reverse_complement(seq: Column) -> Column:
    """Reversed, with bases paired; whatever is not an upper-case base becomes N."""
    return F.translate(F.regexp_replace(F.reverse(seq), "[^ACGT]", "N"), "ACGT", "TGCA")


def protein(seq: Column) -> Column:
    """Codon by codon; stops, unknown and incomplete codons leave nothing."""
    table = F.create_map(*[F.lit(x) for codon, aa in CODONS.items() if aa != "_" for x in (codon, aa)])
    codons = F.regexp_extract_all(seq, F.lit("(.{3})"), F.lit(1))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(""))), "")


def subsequence(seq: Column, start: Column, end: Column) -> Column:
    """[start, end) of a sequence; an end beyond it goes round, as on a circle."""
    n = F.length(seq)
    linear = F.substring(seq, start + 1, end - start)
    return F.when(end <= n, linear).otherwise(F.concat(F.substring(seq, start + 1, n - start), F.substring(seq, F.lit(1), end - n)))
