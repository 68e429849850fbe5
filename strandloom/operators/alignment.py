"""Alignments: gaps, justification, ambiguity-code consensus, positions and pairing masks.

Edge cases, where an operator doesn't say otherwise: null sequences stay null or take no part; an empty
one has no columns; rows of unequal length count in the columns that they have; an empty table gives an
empty result. Helper columns begin with ``__sl_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matrix import column_counts

#: Sets of bases and their ambiguity codes.
AMBIGUITY = {
    "A": "A", "C": "C", "G": "G", "T": "T", "AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M",
    "CGT": "B", "AGT": "D", "ACT": "H", "ACG": "V", "ACGT": "N",
}


def delete_gaps(seq: Column) -> Column:
    return F.translate(seq, "-~.", "")


def count_gaps(seq: Column) -> Column:
    return F.length(seq) - F.length(delete_gaps(seq))


def justify(rows: DataFrame, seq: str, right: bool = False) -> DataFrame:
    """Sequences padded with - to the longest one's length, which is joined in as one row."""
    width = rows.agg(F.coalesce(F.max(F.length(seq)), F.lit(0)).alias("__sl_width"))
    return rows.join(F.broadcast(width)).withColumn(seq, (F.lpad if right else F.rpad)(F.col(seq), F.col("__sl_width"), F.lit("-"))).drop("__sl_width")


def ambiguous_consensus(alignment: DataFrame, ali: str, seq: str, coverage: float = 0.9) -> DataFrame:
    """Per column the code of its most frequent bases that together reach ``coverage`` of its bases.

    Ordered windows are over a column's counts, four rows at most.
    """
    counts = column_counts(alignment, ali, seq).where(F.col("ch").isin("A", "C", "G", "T"))
    w = Window.partitionBy(ali, "col")
    before = F.sum("n").over(w.orderBy(F.desc("n"), "ch").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    taken = counts.withColumn("before", before).withColumn("total", F.sum("n").over(w)).where(F.col("before") < coverage * F.col("total"))
    codes = F.create_map(*(F.lit(x) for pair in AMBIGUITY.items() for x in pair))
    return taken.groupBy(ali, "col").agg(F.array_join(F.array_sort(F.collect_set("ch")), "").alias("bases")).select(ali, "col", codes[F.col("bases")].alias("code"))


def mask_pairs(masks: DataFrame, key: str, mask: str) -> DataFrame:
    """Positions (from 0) of the pairs that a mask of < and > nests: the k-th opening sign of a depth
    pairs with the k-th closing one. Unpaired signs give none."""
    signs = masks.select(key, F.posexplode(F.split(mask, "")).alias("pos", "ch")).where("ch IN ('<', '>')")
    run = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.col("ch") == "<"
    deep = signs.withColumn("depth", F.sum(F.when(opened, 1).otherwise(-1)).over(run) + F.when(opened, 0).otherwise(1))
    kth = deep.withColumn("k", F.row_number().over(Window.partitionBy(key, "depth", "ch").orderBy("pos")))
    both = kth.groupBy(key, "depth", "k").agg(F.min("pos").alias("beg"), F.max("pos").alias("end"), F.count("*").alias("n"))
    return both.where("n = 2").select(key, "depth", "beg", "end")


def to_sequence_positions(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """key, column and position of every base: its place among the columns and among the bases, from 0."""
    places = F.filter(F.transform(F.split(seq, ""), lambda c, i: F.struct(i.alias("column"), c.alias("c"))), lambda x: ~x["c"].isin("-", "~", ".", ""))
    return rows.select(key, F.posexplode(places).alias("position", "x")).select(key, F.col("x.column").alias("column"), "position")


def column_of(seq: Column, position: Column) -> Column:
    """The column (from 0) in which the base at a position (from 0, gaps not counted) of an aligned sequence
    stands; null beyond its ends."""
    bases = F.filter(F.transform(F.split(seq, ""), lambda c, i: F.struct(c.alias("c"), i.alias("at"))), lambda x: ~x["c"].isin("-", "~", ".", ""))
    return F.when(position >= 0, F.get(bases, position)["at"])


def columns_of_ranges(rows: DataFrame, seq: str, begin: str, end: str) -> DataFrame:
    """``rows`` with first_column and last_column of the range of positions from ``begin`` to ``end``, both counted,
    as far as the sequence goes; null for a range that lies beyond it or ends before it begins."""
    bases = F.length(delete_gaps(F.col(seq)))
    low, high = F.greatest(F.col(begin), F.lit(0)), F.least(F.col(end), bases - 1)
    there = low <= high
    return rows.withColumn("first_column", F.when(there, column_of(F.col(seq), low))).withColumn("last_column", F.when(there, column_of(F.col(seq), high)))


def sub_alignment(rows: DataFrame, seq: str, columns: list[tuple[int, int]]) -> DataFrame:
    """The alignment's columns of ranges (first, last), both counted, from 0, in their order."""
    return rows.withColumn(seq, F.concat(*(F.substring(F.col(seq), a + 1, b - a + 1) for a, b in columns)))


def without_gap_columns(alignment: DataFrame, ali: str, seq: str) -> DataFrame:
    """Alignments without the columns in which all rows have a gap. Null rows stay null."""
    bases = column_counts(alignment, ali, seq).where(~F.col("ch").isin("-", "~", ".")).select(ali, "col").distinct()
    kept = bases.groupBy(F.col(ali).alias("__sl_ali")).agg(F.sort_array(F.collect_list("col")).alias("__sl_cols"))
    joined = alignment.join(kept, alignment[ali].eqNullSafe(kept["__sl_ali"]), "left")
    cut = F.array_join(F.transform("__sl_cols", lambda c: F.substring(F.col(seq), c.cast("int"), F.lit(1))), "")
    return joined.withColumn(seq, F.when(F.col(seq).isNotNull(), F.coalesce(cut, F.lit("")))).drop("__sl_ali", "__sl_cols")


def expand_codes(seq: Column) -> Column:
    """Bases that each character of a sequence stands for: an array of strings, itself where it is no code."""
    codes = F.create_map(*(F.lit(x) for bases, code in AMBIGUITY.items() for x in (code, bases)))
    return F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c: F.coalesce(F.element_at(codes, F.upper(c)), c))


def pair_counts(alignment: DataFrame, ali: str, seq: str, pairs: DataFrame) -> DataFrame:
    """ali, beg, end, base1, base2 and n: what stands in the two columns (from 0) of each pair (ali, beg,
    end) of a pairing mask; rows with a gap in one of them don't count."""
    both = alignment.join(pairs.select(ali, "beg", "end"), ali)
    one, two = (F.translate(F.upper(F.substring(F.col(seq), F.col(c) + 1, F.lit(1))), "T", "U") for c in ("beg", "end"))
    made = both.select(ali, "beg", "end", one.alias("base1"), two.alias("base2")).where("base1 RLIKE '[A-Z]' AND base2 RLIKE '[A-Z]'")
    return made.groupBy(ali, "beg", "end", "base1", "base2").agg(F.count("*").alias("n"))
