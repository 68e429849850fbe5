"""Expression profiles, alignment columns, intervals and summaries.

Edge cases, where an operator doesn't say otherwise: rows with a null key or value take no part in
pairs, columns and sums; an empty text has no columns and no words; repeated rows count as often as they
occur; empty tables give empty results. Pairs of all rows (``correlations``, ``differences``) are the
result asked for, so these are for profiles with few rows, such as genes of interest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def correlations(profiles: DataFrame, row: str, condition: str, value: str) -> DataFrame:
    """Pearson correlation of all pairs of rows over their shared conditions, a < b, mapped from [-1, 1]
    to [0, 1] as (r + 1) / 2; null where a row has one condition or doesn't vary.

    A join on the condition and sums per pair; pairs of rows are the result asked for.
    """
    p = profiles.select(row, condition, value)
    x, y = p.select(F.col(row).alias("a"), condition, F.col(value).alias("x")), p.select(F.col(row).alias("b"), condition, F.col(value).alias("y"))
    return x.join(y, condition).where("a < b").groupBy("a", "b").agg(F.round((F.corr("x", "y") + 1) / 2, 6).alias("r"), F.count("*").alias("n"))


def column_counts(alignment: DataFrame, ali: str, seq: str) -> DataFrame:
    """Number of rows with each character in each alignment column (from 1); gaps count too."""
    return alignment.select(ali, F.posexplode(F.split(seq, "")).alias("col", "ch")).where("ch <> ''").groupBy(ali, (F.col("col") + 1).alias("col"), "ch").agg(F.count("*").alias("n"))


def consensus(alignment: DataFrame, ali: str, seq: str) -> DataFrame:
    """The most frequent character of every column (ties: the smaller one) and its share."""
    counts = column_counts(alignment, ali, seq)
    top = counts.groupBy(ali, "col").agg(F.sum("n").alias("rows"), F.max("n").alias("n"))
    first = counts.join(top, [ali, "col", "n"]).groupBy(ali, "col", "n", "rows").agg(F.min("ch").alias("ch"))
    return first.select(ali, "col", "ch", F.round(F.col("n") / F.col("rows"), 6).alias("share"))


def overlaps(intervals: DataFrame, group: str, key: str, begin: str, end: str, width: int) -> DataFrame:
    """Pairs of a group's intervals [begin, end] that overlap, by an equality join on buckets of
    ``width``; a pair is reported in the bucket where the later one begins."""
    b = intervals.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor(F.col(end) / width))))
    x = b.select(group, "bucket", F.col(key).alias("a"), F.col(begin).alias("a_begin"), F.col(end).alias("a_end"))
    y = b.select(group, "bucket", F.col(key).alias("b"), F.col(begin).alias("b_begin"), F.col(end).alias("b_end"))
    meet = (F.col("a") < F.col("b")) & (F.col("a_begin") <= F.col("b_end")) & (F.col("b_begin") <= F.col("a_end"))
    here = F.col("bucket") == F.floor(F.greatest("a_begin", "b_begin") / width)
    return x.join(y, [group, "bucket"]).where(meet & here).select(group, "a", "b", (F.least("a_end", "b_end") - F.greatest("a_begin", "b_begin")).alias("common"))


def n50(lengths: DataFrame, group: str, length: str) -> DataFrame:
    """The largest length such that records of it or longer hold half of a group's total. Lengths
    are counted first, so the ordered pass is over distinct lengths."""
    counts = lengths.groupBy(group, length).agg((F.count("*") * F.col(length)).alias("held"))
    w = Window.partitionBy(group).orderBy(F.desc(length)).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("run", F.sum("held").over(w)).withColumn("total", F.sum("held").over(Window.partitionBy(group)))
    return run.where("2 * run >= total").groupBy(group).agg(F.max(length).cast("long").alias("n50"))


def differences(profiles: DataFrame, row: str, condition: str, value: str) -> DataFrame:
    """Mean relative difference, |x - y| over their mean, of all pairs of rows over shared conditions."""
    p = profiles.select(row, condition, value)
    x, y = p.select(F.col(row).alias("a"), condition, F.col(value).alias("x")), p.select(F.col(row).alias("b"), condition, F.col(value).alias("y"))
    dif = F.when(F.col("x") + F.col("y") == 0, 0.0).otherwise(F.abs(F.col("x") - F.col("y")) / ((F.col("x") + F.col("y")) / 2))
    return x.join(y, condition).where("a < b").groupBy("a", "b").agg(F.round(F.avg(dif), 6).alias("dif"))


def transposed(rows: DataFrame, key: str, columns: list[str], keys: list[str]) -> DataFrame:
    """Columns as rows and the stated keys as columns."""
    return rows.unpivot(key, columns, "col", "v").groupBy("col").pivot(key, keys).agg(F.first("v"))


def word_frequencies(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Words of three letters or more, lower-cased, with their number in a text of 1000 words."""
    words = rows.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"))).alias("word"))
    counts = words.groupBy(key, "word").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    return counts.select(key, "word", F.round(1000 * F.col("n") / total, 4).alias("per_1000"))
