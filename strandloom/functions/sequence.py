"""Scalar functions over sequences, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """Reversed, with A-T, C-G and the two-base codes exchanged; U is read as T."""
    return F.reverse(F.translate(seq, "ACGTURYKMBVDHacgturykmbvdh", "TGCAAYRMKVBHDtgcaayrmkvbhd"))


def gc_share_within(seq: Column, least: float, most: float) -> Column:
    """Is the share of G and C (U counts with A and T) in [least, most]? False without bases, null for null."""
    return F.when(seq.isNotNull(), F.coalesce(gc_fraction(seq).between(least, most), F.lit(False)))


def gc_fraction(seq: Column) -> Column:
    """Share of G and C among A, C, G, T and U; null if there are none of them."""
    bases = F.length(F.regexp_replace(seq, "(?i)[^ACGTU]", ""))
    return F.length(F.regexp_replace(seq, "(?i)[^GC]", "")) / F.nullif(bases, F.lit(0))


def to_dna(seq: Column) -> Column:
    """U as T, in both cases."""
    return F.translate(seq, "Uu", "Tt")


def to_rna(seq: Column) -> Column:
    """T as U, in both cases."""
    return F.translate(seq, "Tt", "Uu")


#: Characters that a sequence of a kind may hold.
VALID = {"dna": "AGCTN", "rna": "AGCUN", "nuc": "AGCTUNRYSWKMBDHV", "prot": "ACDEFGHIKLMNPQRSTVWYBZX"}


def count_valid(seq: Column, kind: str) -> Column:
    """Characters that the alphabet ``kind`` has, in either case; gaps are not among them. Null for null."""
    return F.length(F.regexp_replace(seq, f"(?i)[^{VALID[kind]}]", ""))


def count_invalid(seq: Column, kind: str) -> Column:
    return F.length(seq) - count_valid(seq, kind)


def guess_type(seq: Column, least: float = 0.9) -> Column:
    """The first of dna, rna, nuc and prot of which ``least`` of the characters are valid; null if none is
    or the sequence is empty or null."""
    n = F.length(seq)
    kinds = [F.when((n > 0) & (count_valid(seq, kind) >= F.lit(least) * n), F.lit(kind)) for kind in VALID]
    return F.coalesce(*kinds)


def words(seq: Column, k: int) -> Column:
    """Every run of k characters in order, as an array; empty if the sequence is shorter, null for null.

    One pass of a pattern that matches nothing but looks ahead; only texts with characters beyond the
    basic plane, at whose halves it would match too, are cut position by position.
    """
    n = F.length(seq)
    starts = F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
    by_place = F.transform(starts, lambda i: F.substring(seq, i, F.lit(k)))
    return F.when(seq.rlike(r"[\x{10000}-\x{10FFFF}]"), by_place).otherwise(F.regexp_extract_all(seq, F.lit(rf"(?s)(?=(.{{{k}}}))"), F.lit(1)))


def kmers(seq: Column, k: int, step: int = 1, only: str | None = None) -> Column:
    """Distinct substrings of k characters, every ``step`` from the start, as 64-bit hashes; empty if
    the sequence is shorter, null for null. ``only``: characters that all of a substring's must be among.
    Longs keep the distinct step linear and the shuffles small."""
    found = words(seq, k)
    if step > 1:
        found = F.filter(found, lambda _, i: i % step == 0)
    if only:
        found = F.filter(found, lambda w: F.translate(w, only, "") == "")
    return F.array_distinct(F.transform(found, lambda w: F.xxhash64(w)))


def qualities(qual: Column, offset: int = 33) -> Column:
    """Phred values of a quality string."""
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - offset)


def info_map(info: Column) -> Column:
    """``key=value; key=value`` as a map."""
    return F.when(F.length(F.trim(info)) > 0, F.str_to_map(F.trim(info), F.lit(r";\s*"), F.lit("=")))


def accuracy_to_phred(accuracy: float) -> float:
    """The Phred value of an accuracy such as 0.99."""
    import math

    return -10 * math.log10(1 - accuracy)


def binomial(n: Column, k: Column, p: float) -> Column:
    """Probability of k successes in n trials, from sums of logarithms; 0 <= k <= n, 0 < p < 1."""
    ratios = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    ways = F.aggregate(ratios, F.lit(0.0), lambda acc, i: acc + F.log((n - k + i) / i))
    return F.exp(ways + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
