"""Merging of intervals, as-of lookups, suppression of overlaps and chains of matches.

Edge cases: a null group is a group of its own where rows are only grouped and meets nothing where they
are joined; intervals with a null end take no part; equal intervals are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .agglomerate import groups
from .matrix import overlaps
from .similarity import greedy_clusters


def condense(intervals: DataFrame, group: str, begin: str, end: str, gap: int = 0) -> DataFrame:
    """A group's intervals merged where they overlap or lie at most ``gap`` apart, with how many
    each holds. Equal begins are merged before the ordered pass."""
    own = intervals.groupBy(group, begin).agg(F.max(end).alias(end), F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(begin)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = own.withColumn("__sl_new", F.when(reach.isNull() | (F.col(begin) > reach + gap), 1).otherwise(0))
    islands = islands.withColumn("__sl_island", F.sum("__sl_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(group, "__sl_island").agg(F.min(begin).alias(begin), F.max(end).alias(end), F.sum("n").alias("n")).drop("__sl_island")


def as_of(left: DataFrame, right: DataFrame, key: str, group: str, at: str, value: str, width: int) -> DataFrame:
    """Each left row (key, group, at) with the time and value of the latest right row (group, at,
    value) of its group not after it; of right rows at one time, that of the largest value.

    Times are split into buckets of ``width``. Rows meet within a bucket; what earlier buckets leave
    comes from one row per bucket. So a hot group is spread over its buckets.
    """
    bucket = F.floor(F.col(at) / width).alias("__sl_b")
    found = F.struct(F.col(at).alias("t"), F.col(value).alias("v"))
    r = right.select(group, at, bucket, found.alias("__sl_f"))
    last = r.groupBy(group, "__sl_b").agg(F.max("__sl_f").alias("__sl_f"))
    l = left.select(key, group, at, bucket)
    some = l.select(group, "__sl_b").distinct().withColumn("__sl_f", F.lit(None).cast(last.schema["__sl_f"].dataType)).unionByName(last)
    earlier = Window.partitionBy(group).orderBy("__sl_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = some.groupBy(group, "__sl_b").agg(F.max("__sl_f").alias("__sl_f")).withColumn("__sl_c", F.max("__sl_f").over(earlier)).drop("__sl_f")
    both = l.withColumn("__sl_f", F.lit(None).cast(last.schema["__sl_f"].dataType)).unionByName(r.withColumn(key, F.lit(None).cast(left.schema[key].dataType)))
    here = both.withColumn("__sl_h", F.max("__sl_f").over(Window.partitionBy(group, "__sl_b").orderBy(at))).where(F.col(key).isNotNull()).drop("__sl_f")
    out = here.join(carried, [group, "__sl_b"], "left").withColumn("__sl_f", F.coalesce("__sl_h", "__sl_c"))
    return out.select(key, F.col("__sl_f.t").alias("found_at"), F.col("__sl_f.v").alias("found"))


def as_of_next(left: DataFrame, right: DataFrame, key: str, group: str, at: str, value: str, width: int) -> DataFrame:
    """As ``as_of``, with the earliest right row not before the left one (of rows at one time that of the
    largest value's negative, so the smallest): the same lookup on times turned round."""
    turned = lambda df: df.withColumn(at, -F.col(at))
    found = as_of(turned(left), turned(right).withColumn(value, -F.col(value)), key, group, at, value, width)
    return found.select(key, (-F.col("found_at")).alias("found_at"), (-F.col("found")).alias("found"))


def rectangles_overlap(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> Column:
    """Do two rectangles, columns (left, right, top, bottom) with both ends counted, share a point?"""
    meet = lambda x1, x2, y1, y2: (F.col(x1) <= F.col(y2)) & (F.col(y1) <= F.col(x2))
    return meet(a[0], a[1], b[0], b[1]) & meet(a[2], a[3], b[2], b[3])


def lies_within(begin: str, end: str, outer_begin: str, outer_end: str) -> Column:
    return (F.col(outer_begin) <= F.col(begin)) & (F.col(end) <= F.col(outer_end))


def chained(matches: DataFrame, pair: list[str], q_begin: str, s_begin: str, length: str, gap: int, shift: int) -> DataFrame:
    """Matches of a pair of sequences with ``chain``: a match goes on with the one before it (by its begin
    in the first sequence) if it begins after it in both, at most ``gap`` behind its end, and the two
    distances differ by at most ``shift``. The chain is named by its number within the pair.

    A pair's matches are ordered in one task; a genome's pair is cut into ``pair`` keys by contig first.
    """
    order = Window.partitionBy(*pair).orderBy(q_begin, s_begin, length)
    before = {c: F.lag(c).over(order) for c in (q_begin, s_begin, length)}
    dq = F.col(q_begin) - before[q_begin] - before[length]
    ds = F.col(s_begin) - before[s_begin] - before[length]
    goes_on = (F.col(q_begin) > before[q_begin]) & (F.col(s_begin) > before[s_begin]) & (dq <= gap) & (ds <= gap) & (F.abs(dq - ds) <= shift)
    marked = matches.withColumn("__sl_new", F.when(goes_on, 0).otherwise(1))
    return marked.withColumn("chain", F.sum("__sl_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__sl_new")


def chain_table(chains: DataFrame, pair: list[str], q_begin: str, s_begin: str, length: str) -> DataFrame:
    """A row per chain: both begins and ends (the last character), matches and matched characters."""
    q_end, s_end = F.col(q_begin) + F.col(length) - 1, F.col(s_begin) + F.col(length) - 1
    return chains.groupBy(*pair, "chain").agg(F.min(q_begin).alias("q_begin"), F.max(q_end).alias("q_end"), F.min(s_begin).alias("s_begin"), F.max(s_end).alias("s_end"), F.count("*").alias("matches"), F.sum(length).alias("matched"))


def in_slices(features: DataFrame, slices: DataFrame, group: str, begin: str, end: str, width: int, clip: bool = False) -> DataFrame:
    """Features that overlap slices (slice, group, from, to; both ends counted), with the slice, and with
    ``clip`` cut down to it. They meet in buckets of ``width``, each pair in one of them."""
    spread = lambda df, a, b: df.withColumn("__sl_b", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))
    of = spread(slices.where(F.col("from") <= F.col("to")), "from", "to").select("slice", F.col(group).alias("__sl_g"), F.col("from").alias("__sl_from"), F.col("to").alias("__sl_to"), "__sl_b")
    own = spread(features.where(F.col(begin) <= F.col(end)), begin, end).withColumnRenamed("__sl_b", "__sl_own")
    met = own.join(of, (F.col(group) == F.col("__sl_g")) & (F.col("__sl_own") == F.col("__sl_b")))
    first = F.floor(F.greatest(F.col(begin), F.col("__sl_from")) / width)
    kept = met.where((F.col(begin) <= F.col("__sl_to")) & (F.col("__sl_from") <= F.col(end)) & (F.col("__sl_b") == first))
    if clip:
        kept = kept.withColumn(begin, F.greatest(begin, "__sl_from")).withColumn(end, F.least(end, "__sl_to"))
    return kept.drop("__sl_g", "__sl_from", "__sl_to", "__sl_b", "__sl_own")


def best_of_overlapping(features: DataFrame, group: str, key: str, begin: str, end: str, score: str, width: int) -> DataFrame:
    """Features that no better kept one of their group overlaps, going through them by score (then by the
    smaller key, which names a feature)."""
    pairs = overlaps(features, group, key, begin, end, width)
    seeds = greedy_clusters(pairs.select("a", "b"), features.select(F.col(key).alias("id"), F.col(score).alias("weight")))
    return features.join(seeds.where("id = seed").select(F.col("id").alias(key)), key, "left_semi")


def chains(matches: DataFrame, key: str, pair: list[str], q_begin: str, s_begin: str, length: str, gap: int, shift: int, strand: str | None = None) -> DataFrame:
    """key and chain (the key of its first match) of all matches: a match goes on with any one behind it, not just the
    next, that begins at most ``gap`` after its end in both sequences with distances that differ by at most
    ``shift``. Of several the nearest counts (by both distances together, then their difference, then the key), and two
    matches are linked if each is the other's nearest, so chains don't branch.

    ``strand``: a column of + and -; matches on - lie backwards in the second sequence, where ``s_begin`` is their
    smallest place all the same, and chain among themselves. Matches meet by places in squares of ``gap``, so a pair of
    genomes is spread over them; only matches that crowd in one square meet all others there. Links are followed to
    the chain's first match by doubling. Rows with a null key, place or length take no part; keys are unique.
    """
    of_minus = F.col(strand) == "-" if strand else F.lit(False)
    own = matches.where(F.col(key).isNotNull() & F.col(q_begin).isNotNull() & F.col(s_begin).isNotNull() & F.col(length).isNotNull()).select(
        F.col(key).alias("__sl_k"), F.struct(*pair, of_minus.alias("__sl_minus")).alias("__sl_p"), F.col(q_begin).alias("__sl_q"), F.when(of_minus, -(F.col(s_begin) + F.col(length) - 1)).otherwise(F.col(s_begin)).alias("__sl_s"), F.col(length).alias("__sl_n")
    )
    square = lambda x: F.floor(x / gap)
    places = lambda x: F.explode(F.array_distinct(F.array(square(x + F.col("__sl_n")), square(x + F.col("__sl_n") + gap))))
    ends = own.withColumn("__sl_a", places(F.col("__sl_q"))).withColumn("__sl_b", places(F.col("__sl_s")))
    begins = own.select(F.col("__sl_k").alias("__sl_next"), "__sl_p", F.col("__sl_q").alias("__sl_q2"), F.col("__sl_s").alias("__sl_s2"), square(F.col("__sl_q")).alias("__sl_a"), square(F.col("__sl_s")).alias("__sl_b"))
    dq, ds = F.col("__sl_q2") - F.col("__sl_q") - F.col("__sl_n"), F.col("__sl_s2") - F.col("__sl_s") - F.col("__sl_n")
    near = ends.join(begins, ["__sl_p", "__sl_a", "__sl_b"]).where(dq.between(0, gap) & ds.between(0, gap) & (F.abs(dq - ds) <= shift))
    ways = near.select("__sl_k", "__sl_next", (dq + ds).alias("far"), F.abs(dq - ds).alias("off"))
    after = ways.groupBy("__sl_k").agg(F.min(F.struct("far", "off", "__sl_next")).alias("to"))
    before = ways.groupBy("__sl_next").agg(F.min(F.struct("far", "off", "__sl_k")).alias("from"))
    links = after.select("__sl_k", F.col("to.__sl_next").alias("__sl_next")).join(before.select("__sl_next", F.col("from.__sl_k").alias("__sl_k")), ["__sl_k", "__sl_next"])
    found = groups(own.select(F.col("__sl_k").alias("id")), links.select(F.col("__sl_k").alias("a"), F.col("__sl_next").alias("b")))
    return found.select(F.col("id").alias(key), F.col("cluster").alias("chain"))
