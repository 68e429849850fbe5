"""Structure of alignments and folds: covariation of column pairs, measures of fold strings, and
alignments whose rows lie on the left or the right only.

Edge cases. A pair of columns with one kind of pair or none doesn't covary (score 0). Null fold strings
have null measures; those without a loop, or with branches, have a null asymmetry. Null rows and counts
are left out. Helper columns begin with ``__sl_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _covarying_share(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of all two kinds of pairs of a key (base1, base2, n) the rarer one's number counts: as covarying
    if both bases differ, as not if one does (but for the changes between G-C and G-U). keys, share."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "base1", "base2")
    ranked = pairs.withColumn("__sl_k", F.row_number().over(order))
    other = ranked.select(*keys, *(F.col(c).alias(f"__sl_{c}") for c in ("base1", "base2", "n")), F.col("__sl_k").alias("__sl_j"))
    two = ranked.join(other, keys, "left").where("__sl_j > __sl_k OR __sl_j IS NULL OR __sl_j = 1 AND __sl_k = 1")
    first, second = F.col("base1") != F.col("__sl_base1"), F.col("base2") != F.col("__sl_base2")
    wobble = ((F.col("base1") == "G") & (F.col("__sl_base1") == "G") & F.col("base2").isin("C", "U") & F.col("__sl_base2").isin("C", "U")) | ((F.col("base2") == "G") & (F.col("__sl_base2") == "G") & F.col("base1").isin("C", "U") & F.col("__sl_base1").isin("C", "U"))
    later = F.col("__sl_j") > F.col("__sl_k")
    cov = F.sum(F.when(later & first & second, F.col("__sl_n")).otherwise(0))
    uncov = F.sum(F.when(later & (first != second) & ~wobble, F.col("__sl_n")).otherwise(0))
    counted = two.groupBy(*keys).agg(cov.alias("__sl_cov"), uncov.alias("__sl_un"))
    return counted.select(*keys, F.when(F.col("__sl_cov") == 0, 0.0).otherwise(F.col("__sl_cov") / (F.col("__sl_cov") + F.col("__sl_un"))).alias("share"))


def covariation(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and score of column pairs from ``alignment.pair_counts`` (keys, base1, base2, n): twice what the
    observed share of covarying pairs is above that of bases paired at random, 0 to 1."""
    kept = counts.where(F.col("base1").isin(*"ACGU") & F.col("base2").isin(*"ACGU"))
    one = kept.groupBy(*keys, "base1").agg(F.sum("n").alias("__sl_1"))
    two = kept.groupBy(*keys, "base2").agg(F.sum("n").alias("__sl_2"))
    random = one.join(two, keys).select(*keys, "base1", "base2", (F.col("__sl_1") * F.col("__sl_2")).alias("n"))
    both = _covarying_share(kept, keys).withColumnRenamed("share", "__sl_seen").join(_covarying_share(random, keys), keys)
    return both.select(*keys, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * (F.col("__sl_seen") - F.col("share")))).alias("score"))


def _brackets(fold: Column) -> Column:
    """A fold with one kind of brackets."""
    return F.translate(fold, "<>", "()")


def _last_place(fold: Column, sign: str) -> Column:
    """Where a sign stands last, from 1; 0 if nowhere."""
    from_end = F.instr(F.reverse(fold), sign)
    return F.when(from_end > 0, F.length(fold) - from_end + 1).otherwise(0)


def has_branch(fold: Column) -> Column:
    """Does a fold open again after it has closed? That is, does its last opening bracket come after the first
    closing one."""
    one = _brackets(fold)
    closes = F.instr(one, ")")
    return (closes > 0) & (_last_place(one, "(") > closes)


def fold_center(fold: Column) -> Column:
    """The middle of the first hairpin loop with its closing pair, in characters from the start. A loop is what
    lies between an opening bracket and a closing one that comes next, if anything does."""
    signs = F.filter(F.transform(F.split(_brackets(fold), ""), lambda c, i: F.struct(c.alias("c"), i.alias("at"))), lambda x: x["c"].isin("(", ")"))
    start = F.struct(F.lit(None).cast("int").alias("opened"), F.lit(None).cast("double").alias("center"))
    is_open = lambda x: x["c"] == "("
    step = lambda s, x: F.struct(
        F.when(is_open(x), x["at"]).alias("opened"),
        F.coalesce(s["center"], F.when(~is_open(x) & (x["at"] - s["opened"] > 1), (s["opened"] + x["at"] + 1) / 2)).alias("center"),
    )
    return F.aggregate(signs, start, step)["center"]


def fold_asymmetry(fold: Column) -> Column:
    """By how many characters the two sides of an unbranched hairpin differ: from its first opening bracket to the
    last, and from its first closing one to the last."""
    one = _brackets(fold)
    opens, closes = F.instr(one, "("), F.instr(one, ")")
    turn = _last_place(one, "(")
    there = (opens > 0) & (closes > turn + 1) & ~has_branch(fold)
    return F.when(there, F.abs((turn - opens) - (_last_place(one, ")") - closes)))


def lopsided(alignment: DataFrame, ali: str, seq: str, count: str | None = None, least_off: float = 70, least_rows: float = 80, least_balance: float = 10) -> DataFrame:
    """Per alignment the rows on the left and on the right only, and whether it is ``chimeric``: that
    most rows (but for a seed) lie on one side, and enough of them on either.

    A row is on a side if its bases there exceed those of the other by ``least_off`` percent of all.
    ``count``: a column with the reads of a row.
    """
    width = alignment.where(F.col(seq).isNotNull()).groupBy(ali).agg((F.max(F.length(seq)) / 2).cast("int").alias("__sl_mid"))
    rows = alignment.where(F.col(seq).isNotNull()).join(width, ali)
    bases = lambda x: F.length(F.regexp_replace(x, "[^A-Za-z]", ""))
    left, right = bases(F.substring(F.col(seq), F.lit(1), F.col("__sl_mid") + 1)), bases(F.substring(F.col(seq), F.col("__sl_mid") + 2, F.length(seq)))
    off = F.when(left + right > 0, (100 * (left - right) / (left + right)).cast("int"))
    reads = F.coalesce(F.col(count), F.lit(0)) if count else F.lit(1)
    sums = rows.withColumn("__sl_off", off).groupBy(ali).agg(F.sum(F.when(F.col("__sl_off") >= least_off, reads).otherwise(0)).alias("left_only"), F.sum(F.when(F.col("__sl_off") <= -least_off, reads).otherwise(0)).alias("right_only"), F.count("*").alias("rows"))
    all_off = F.col("left_only") + F.col("right_only")
    good = (all_off >= (F.col("rows") - 1) * least_rows / 100) & (F.least("left_only", "right_only") >= all_off * least_balance / 100)
    return sums.withColumn("chimeric", good)
