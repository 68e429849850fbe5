"""Cleaning, filtering, de-replication, demultiplexing and joining of sequence records.

Edge cases, where an operator doesn't say otherwise: a null sequence, id or info passes no filter and
stays null through a change; an empty table gives an empty result; repeated rows are rows of their own;
extra columns stay as they are. Helper columns are named with two leading underscores and a prefix
(``__sl_``) and are dropped again.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.sequence import reverse_complement


def filter_length(rows: DataFrame, column: str, least: int = 1, most: int = 1 << 30) -> DataFrame:
    return rows.where(F.length(column).between(least, most))


def clip_start(rows: DataFrame, column: str, pattern: str, distance: int = 15, keep_match: bool = False) -> DataFrame:
    """Cuts the start off by a pattern's matches, unless the last of these ends beyond ``distance``
    characters: all up to the end of the last match, or with ``keep_match`` all before the first one.
    Without a match, or one so near, the record stays as it is."""
    text = F.col(column)
    matches = F.regexp_extract_all(text, F.lit(f"(?s)({pattern})"), F.lit(1))
    upto = F.regexp_extract(text, f"(?s)^(.*(?:{pattern}))", 1)  # greedy: to the end of the last match
    last = F.length(upto)
    first = F.length(F.regexp_extract(text, f"(?s)^(.*?)(?:{pattern})", 1))
    near = (F.size(matches) > 0) & (last <= distance)
    cut = first if keep_match else last
    return rows.withColumn(column, F.when(near, F.substring(text, cut + 1, F.length(text))).otherwise(text))


def clip_end(rows: DataFrame, column: str, pattern: str, distance: int | None = None, keep_match: bool = False) -> DataFrame:
    """Cuts the end off from a pattern's first match on, or with ``keep_match`` from its end on, unless
    it begins more than ``distance`` characters before the end. Without ``distance`` the pattern must
    reach the end."""
    if distance is None:
        return rows.withColumn(column, F.regexp_replace(column, rf"(?s)(?:{pattern})$", ""))
    text = F.col(column)
    before = F.length(F.regexp_extract(text, f"(?s)^(.*?)(?:{pattern})", 1))
    match = F.length(F.regexp_extract(text, f"(?s)({pattern})", 1))
    near = text.rlike(f"(?s)(?:{pattern})") & (F.length(text) - before <= distance)
    return rows.withColumn(column, F.when(near, F.substring(text, F.lit(1), before + match if keep_match else before)).otherwise(text))


def filter_id_pattern(rows: DataFrame, key: str, pattern: str, keep: bool = True) -> DataFrame:
    """Records whose id has (or with ``keep`` false: has not) a match of a regular expression."""
    return rows.where(F.col(key).rlike(pattern) if keep else ~F.col(key).rlike(pattern))


def filter_info_pattern(rows: DataFrame, info: str, pattern: str, keep: bool = True) -> DataFrame:
    """Records whose info field has (or has not) a match; a null info counts as empty."""
    found = F.coalesce(F.col(info), F.lit("")).rlike(pattern)
    return rows.where(found if keep else ~found)


def filter_id_length(rows: DataFrame, key: str, least: int = 1, most: int = 1 << 30) -> DataFrame:
    return rows.where(F.length(key).between(least, most))


def filter_quality(rows: DataFrame, values: str, least: float, low: float = 99.0, high: float = 100.0) -> DataFrame:
    """Records of whose quality values low to high percent are ``least`` or more; none without values."""
    return rows.where(quality_share(F.col(values), least, float("inf")).between(low, high))


def trim_quality_start(rows: DataFrame, seq: str, values: str, window: int = 10, match: int = 9, least: float = 20) -> DataFrame:
    """Cuts before the first window of which ``match`` of ``window`` values are ``least`` or more, and
    then before its first such value; empties records without such a window."""
    turned = rows.withColumn(seq, F.reverse(seq)).withColumn(values, F.reverse(values))
    cut = trim_quality_end(turned, seq, values, window, match, least)
    return cut.withColumn(seq, F.reverse(seq)).withColumn(values, F.reverse(values))


def last_good_place(values: Column, window: int, match: int, least: float) -> Column:
    """Up to which value (from 1; 0: none) a record is good: the last of ``least`` or more up to the end of the last
    window of which ``match`` are. One pass over the values: what is held of them are the signs of the
    latest window as the bits of a number, or for windows over 62 as an array."""
    good = F.coalesce(values_at_least(values, least), F.array().cast("array<boolean>"))
    small = window <= 62
    sign = lambda g: F.when(g, 1).otherwise(0)
    start = F.struct(
        F.lit(0).alias("n"), (F.lit(0).cast("long") if small else F.array().cast("array<int>")).alias("held"), F.lit(0).alias("in_it"), F.lit(0).alias("last"), F.lit(0).alias("cut")
    )

    def step(s: Column, g: Column) -> Column:
        n = s["n"] + 1
        if small:
            leaves = F.shiftrightunsigned(s["held"], window - 1).bitwiseAND(F.lit(1).cast("long")).cast("int")
            kept = s["held"].bitwiseAND(F.lit((1 << (window - 1)) - 1).cast("long"))
            held = F.shiftleft(kept, 1) + sign(g).cast("long")
        else:
            full = F.size(s["held"]) == window
            leaves = F.when(full, F.element_at(s["held"], 1)).otherwise(0)
            held = F.concat(F.when(full, F.slice(s["held"], 2, window - 1)).otherwise(s["held"]), F.array(sign(g)))
        in_it = s["in_it"] + sign(g) - leaves
        last = F.when(g, n).otherwise(s["last"])
        cut = F.when((n >= window) & (in_it >= match), last).otherwise(s["cut"])
        return F.struct(n.alias("n"), held.alias("held"), in_it.alias("in_it"), last.alias("last"), cut.alias("cut"))

    return F.aggregate(good, start, step)["cut"]


def values_at_least(values: Column, least: float) -> Column:
    return F.transform(values, lambda x: F.coalesce(x >= least, F.lit(False)))


def trim_quality_end(rows: DataFrame, seq: str, values: str, window: int = 10, match: int = 9, least: float = 20) -> DataFrame:
    """Cuts after the last window of which ``match`` of ``window`` values are ``least`` or more, and
    then after its last such value; empties records without such a window."""
    cut = rows.withColumn("__sl_cut", last_good_place(F.col(values), window, match, least))
    return cut.withColumn(seq, F.substring(F.col(seq), F.lit(1), F.col("__sl_cut"))).withColumn(values, F.slice(values, F.lit(1), F.col("__sl_cut"))).drop("__sl_cut")


def filter_ids(rows: DataFrame, ids: DataFrame, key: str, keep: bool = True) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi" if keep else "left_anti")


def dereplicate(rows: DataFrame, seq: str, key: str, count: Column | None = None) -> DataFrame:
    """Distinct sequences with the smallest id and the number of records, or the sum of ``count``.

    Grouped by a 64-bit and a 128-bit hash of the sequence: what is sorted and compared are the hashes,
    one text of each comes along. Null sequences are left out.
    """
    n = F.sum(count) if count is not None else F.count("*")
    hashes = (F.xxhash64(seq).alias("__sl_h"), F.md5(F.col(seq).cast("binary")).alias("__sl_m"))
    groups = rows.where(F.col(seq).isNotNull()).groupBy(*hashes)
    return groups.agg(F.any_value(seq).alias(seq), F.min(key).alias(key), n.cast("long").alias("seq_count")).drop("__sl_h", "__sl_m")


def demultiplex(rows: DataFrame, column: str, barcodes: DataFrame) -> DataFrame:
    """Each row with the sample of the longest barcode (tag, sample) that its column starts with, else
    null. Of a tag listed twice the smallest sample counts; empty and null tags don't.

    The prefixes of the lengths that tags have are looked up in one map of all tags: a barcode list is
    small (at most some thousands), so it travels with the rows; nothing is shuffled.
    """
    tags = barcodes.where(F.length("tag") > 0).groupBy("tag").agg(F.min("sample").alias("sample"))
    held = tags.agg(F.map_from_entries(F.collect_list(F.struct("tag", "sample"))).alias("__sl_of"), F.sort_array(F.collect_set(F.length("tag")), False).alias("__sl_n"))
    found = F.filter(F.transform("__sl_n", lambda n: F.element_at("__sl_of", F.left(F.col(column), n))), lambda s: s.isNotNull())
    return rows.join(F.broadcast(held)).withColumn("sample", F.get(found, 0)).drop("__sl_of", "__sl_n")


#: What ``match_barcodes`` says of reads without a sample.
NO_ROOM, LOW_QUALITY, NO_BARCODE = "no-room", "low-quality", "no-barcode"


def match_barcodes(rows: DataFrame, seq: str, primer_at: str, barcodes: DataFrame, most_gap: int = 0, values: str | None = None, least: float = 0.0) -> DataFrame:
    """sample and outcome of reads by the barcode before their primer.

    ``primer_at`` is where the primer begins (from 0; null: no primer, and both are null). The barcode
    ends there or up to ``most_gap`` characters before; the nearest counts, of those the longest. The
    outcome is the barcode, or that there was no room for the shortest one, that a quality value of it
    is under ``least``, or that none was found. Of a barcode listed twice the smallest sample counts.
    """
    tags = barcodes.where(F.length("tag") > 0).groupBy("tag").agg(F.min("sample").alias("sample"))
    held = tags.agg(F.map_from_entries(F.collect_list(F.struct("tag", "sample"))).alias("__sl_of"), F.sort_array(F.collect_set(F.length("tag")), False).alias("__sl_n"))
    begin = F.col(primer_at)
    places = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most_gap)), lambda gap: F.transform("__sl_n", lambda n: F.struct((begin - n - gap).alias("at"), n.alias("n")))))
    cut = F.transform(F.filter(places, lambda p: p["at"] >= 0), lambda p: F.struct(p["at"].alias("at"), p["n"].alias("n"), F.substring(F.col(seq), p["at"] + 1, p["n"]).alias("tag")))
    hit = F.get(F.filter(cut, lambda p: F.element_at("__sl_of", p["tag"]).isNotNull()), 0)
    found = rows.join(F.broadcast(held)).withColumn("__sl_hit", F.when(begin.isNotNull(), hit))
    good = F.lit(True)
    if values is not None:
        good = ~F.exists(F.slice(F.col(values), F.col("__sl_hit.at") + 1, F.col("__sl_hit.n")), lambda v: v < least)
    shortest = F.array_min("__sl_n")
    outcome = F.when(begin < shortest, NO_ROOM).when(F.col("__sl_hit").isNull(), NO_BARCODE).when(good, F.col("__sl_hit.tag")).otherwise(LOW_QUALITY)
    found = found.withColumn("sample", F.when((begin >= shortest) & good, F.element_at("__sl_of", F.col("__sl_hit.tag")))).withColumn("outcome", F.when(begin.isNotNull(), outcome))
    return found.drop("__sl_hit", "__sl_of", "__sl_n")


def pair_samples(rows: DataFrame, forward: str, reverse: str, pairs: DataFrame) -> DataFrame:
    """The sample of a pair of tags (f_tag, r_tag, sample) that both mates' outcomes make; null if the
    pair isn't listed. Of a pair listed twice the smallest sample counts."""
    listed = pairs.groupBy(F.col("f_tag").alias("__sl_f"), F.col("r_tag").alias("__sl_r")).agg(F.min("sample").alias("sample"))
    return rows.join(listed, (F.col(forward) == F.col("__sl_f")) & (F.col(reverse) == F.col("__sl_r")), "left").drop("__sl_f", "__sl_r")


def filter_mates(reads: DataFrame, mates: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows whose mate, a row of equal ``on``, the other lacks (one of them may have been
    filtered). Nulls have no mate; repeated rows all stay."""
    return reads.join(mates.select(*on).distinct(), on, "left_semi"), mates.join(reads.select(*on).distinct(), on, "left_semi")


def join_mates(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of forward and reverse reads by their record number."""
    return left.join(right, on)


def rarefy(rows: DataFrame, group: str, key: str, n: int, seed: int = 1) -> DataFrame:
    """``n`` rows of each group by a seeded order; groups with fewer rows give none. Each task first
    drops what can't be among its own first n, so no task gets a whole hot group."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary"))
    w = Window.partitionBy(group).orderBy("__sl_o", key)
    salted = Window.partitionBy(group, F.pmod(F.xxhash64(key), F.lit(64))).orderBy("__sl_o", key)
    some = rows.withColumn("__sl_o", order).withColumn("__sl_r", F.row_number().over(salted)).where(F.col("__sl_r") <= n)
    ranked = some.withColumn("__sl_r", F.row_number().over(w)).where(F.col("__sl_r") <= n)
    full = rows.groupBy(group).agg(F.count("*").alias("__sl_n")).where(F.col("__sl_n") >= n).select(group)
    return ranked.join(full, group, "left_semi").drop("__sl_o", "__sl_r")


def mask_by_quality(seq: Column, values: Column, low: float, high: float, mask: str = "N") -> Column:
    """The sequence with characters whose value lies in [low, high] replaced."""
    return F.array_join(F.zip_with(F.split(seq, ""), values, lambda c, v: F.when(v.between(low, high), mask).otherwise(c)), "")


def quality_share(values: Column, low: float, high: float) -> Column:
    """Percent of positions whose value lies in [low, high]; null without positions."""
    return 100 * F.size(F.filter(values, lambda v: v.between(low, high))) / F.nullif(F.size(values), F.lit(0))


def dna_share(seq: Column) -> Column:
    """Share of A, G, C, T and N; null for an empty sequence."""
    return F.length(F.regexp_replace(seq, "(?i)[^AGCTN]", "")) / F.nullif(F.length(seq), F.lit(0))


def sub_sequence(seq: Column, parts: list[tuple[int, int]]) -> Column:
    """The (begin from 0, length) parts of a sequence, joined."""
    return F.concat(*(F.substring(seq, begin + 1, n) for begin, n in parts))


def _mismatches(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y) & (y != "N")), lambda d: d))


def probe_overlap(seq: Column, probe: str, least: int = 1, ratio: float = 0.8) -> Column:
    """The longest n of at least ``least`` such that the probe's last n characters match the first n
    of the sequence with at most int((1 - ratio) * n) mismatches (N in the sequence matches all); 0 if none."""
    fits = lambda n: (F.length(seq) >= n) & (_mismatches(F.lit(probe[len(probe) - n :]), F.substring(seq, 1, n)) <= int((1 - ratio) * n + 1e-9))
    return F.coalesce(*(F.when(fits(n), F.lit(n)) for n in range(len(probe), least - 1, -1)), F.lit(0))


def probe_overlap_end(seq: Column, probe: str, least: int = 1, ratio: float = 0.8) -> Column:
    """The same at the end: the probe's first n characters against the last n of the sequence."""
    fits = lambda n: (F.length(seq) >= n) & (_mismatches(F.lit(probe[:n]), F.right(seq, F.lit(n))) <= int((1 - ratio) * n + 1e-9))
    return F.coalesce(*(F.when(fits(n), F.lit(n)) for n in range(len(probe), least - 1, -1)), F.lit(0))


def trim_probe_start(rows: DataFrame, seq: str, probe: str, least: int = 1, ratio: float = 0.95) -> DataFrame:
    """Cuts off what overlaps with the end of a probe at the start (``probe_overlap``)."""
    text = F.col(seq)
    return rows.withColumn(seq, F.substring(text, probe_overlap(text, probe, least, ratio) + 1, F.length(text)))


def trim_probe_end(rows: DataFrame, seq: str, probe: str, least: int = 1, ratio: float = 0.95) -> DataFrame:
    """Cuts off what overlaps with the start of a probe at the end (``probe_overlap_end``)."""
    text = F.col(seq)
    return rows.withColumn(seq, F.substring(text, F.lit(1), F.length(text) - probe_overlap_end(text, probe, least, ratio)))


def merge_mate_reads(rows: DataFrame, seq1: str, qual1: str, seq2: str, qual2: str, least: int = 15, ratio: float = 0.8) -> DataFrame:
    """overlap, seq, qual and seq_break of two mates as they were read.

    Mate 2 is turned and complemented. Where the longest overlap of mate 1's end with mate 2's start has
    at most int((1 - ratio) * n) mismatches, the two are merged: in the overlap the base of the better
    quality counts, of equal ones mate 2's; seq_break is -1. Else they are joined and seq_break is mate
    1's length. A null sequence or quality gives nulls.
    """
    turned = rows.withColumn("__sl_s", reverse_complement(F.col(seq2))).withColumn("__sl_q", F.reverse(qual2))
    found = merge_mates(turned, seq1, "__sl_s", least, ratio).drop("merged").withColumn("__sl_k", F.col("overlap"))
    k, n1 = F.col("__sl_k"), F.length(seq1)
    tail = lambda c: F.substring(F.col(c), n1 - k + 1, k)
    start = lambda c: F.substring(F.col(c), F.lit(1), k)
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    four = F.arrays_zip(chars(tail(seq1)).alias("a"), chars(tail(qual1)).alias("p"), chars(start("__sl_s")).alias("b"), chars(start("__sl_q")).alias("q"))
    best = lambda x, one, two: F.when(x["p"] > x["q"], x[one]).otherwise(x[two])
    inside = lambda one, two: F.array_join(F.transform("__sl_o", lambda x: best(x, one, two)), "")
    whole = lambda first, middle, second: F.concat(F.substring(F.col(first), F.lit(1), n1 - k), middle, F.substring(F.col(second), k + 1, F.length(second)))
    zipped = found.withColumn("__sl_o", four)
    made = zipped.withColumn("__sl_1", whole(seq1, inside("a", "b"), "__sl_s")).withColumn("__sl_2", whole(qual1, inside("p", "q"), "__sl_q"))
    made = made.withColumn("seq_break", F.when(F.col("__sl_1").isNotNull(), F.when(k > 0, -1).otherwise(n1)))
    return made.withColumns({"seq": F.col("__sl_1"), "qual": F.col("__sl_2")}).drop("__sl_s", "__sl_q", "__sl_k", "__sl_o", "__sl_1", "__sl_2")


def merge_mates(rows: DataFrame, left: str, right: str, least: int = 15, ratio: float = 0.8) -> DataFrame:
    """overlap and merged of two mates: the longest overlap of the left one's end and the right one's
    start with mismatches of at most int((1 - ratio) * n); 0 and the two joined if there is none."""

    @F.pandas_udf(IntegerType())
    def overlap(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        return pd.Series([0 if x is None or y is None else longest_overlap(x, y, least, 1 - ratio) for x, y in zip(lefts, rights, strict=True)], dtype="int32")

    return rows.withColumn("overlap", overlap(left, right)).withColumn("merged", F.concat(left, F.expr(f"substring(`{right}`, overlap + 1)")))


def longest_overlap(left: str, right: str, least: int, share: float) -> int:
    """How many characters of the left one's end are the right one's start but for a ``share`` of them: the most,
    of ``least`` or more; else 0. It ends at the first that fits; a try compares arrays."""
    a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (left, right))
    for k in range(min(len(a), len(b)), max(least, 1) - 1, -1):
        if np.count_nonzero(a[len(a) - k :] != b[:k]) <= math.floor(share * k + 1e-9):
            return k
    return 0


def dereplicate_qualities(rows: DataFrame, seq: str, qual: str) -> DataFrame:
    """Distinct sequences with their number and the best quality character at each position. Maxima
    are taken per position before they meet, so a frequent sequence is combined on the map side."""
    counts = rows.groupBy(seq).agg(F.count("*").alias("seq_count"))
    best = rows.select(seq, F.posexplode(F.split(qual, "")).alias("pos", "q")).groupBy(seq, "pos").agg(F.max("q").alias("q"))
    joined = best.groupBy(seq).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "q"))), lambda x: x["q"]), "").alias(qual))
    return counts.join(joined, seq)


def frequent_ends(rows: DataFrame, seq: str, k: int, most: int) -> DataFrame:
    """The ``most`` most frequent last k characters, candidates for an adapter (ties: the smaller)."""
    ends = rows.where(F.length(seq) >= k).select(F.right(F.col(seq), F.lit(k)).alias("ending"))
    return ends.groupBy("ending").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ending").limit(most)


def best_per_key(rows: DataFrame, keys: list[str], score: str, *ties: str) -> DataFrame:
    """One row per key: the highest score, then the smallest of ``ties`` (numbers)."""
    order = F.struct(F.col(score).alias("s"), *((-F.col(t)).alias(f"t{i}") for i, t in enumerate(ties)))
    best = rows.groupBy(*keys).agg(F.max(order).alias("b"))
    return best.select(*keys, F.col("b.s").alias(score), *((-F.col(f"b.t{i}")).alias(t) for i, t in enumerate(ties)))


def pool_table(reads: DataFrame, seq: str, sample: str, samples: list[str], least: int = 1) -> DataFrame:
    """Sequences by samples, counts scaled by mean total / sample's total, of ``least`` reads or more. The
    totals are joined in as one row, so nothing runs while the plan is made."""
    counts = reads.groupBy(seq).pivot(sample, samples).count().na.fill(0)
    totals = reads.agg(*(F.count_if(F.col(sample) == s).alias(f"__sl_{i}") for i, s in enumerate(samples)))
    kept = counts.where(sum((F.col(s) for s in samples), F.lit(0)) >= least).join(F.broadcast(totals))
    mean = sum((F.col(f"__sl_{i}") for i in range(len(samples))), F.lit(0)) / len(samples)
    return kept.select(seq, *(F.when(F.col(f"__sl_{i}") > 0, F.col(s) * mean / F.col(f"__sl_{i}")).otherwise(0.0).alias(s) for i, s in enumerate(samples)))


def even_sample(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """``n`` rows of each group, evenly spaced in its order: those at places floor(i * size / n). Groups of
    fewer rows give none. Places are counted within buckets of a group and then added up, so no task
    sorts a whole hot group: the buckets follow from the first column of the order (a number).

    Nulls come first in the order; equal rows may trade places.
    """
    first = F.col(order[0])
    ends = rows.groupBy(group).agg(F.count("*").alias("__sl_size"), F.min(first).alias("__sl_low"), F.max(first).alias("__sl_high"))
    width = F.greatest((F.col("__sl_high") - F.col("__sl_low") + 1) / 64, F.lit(1e-9))
    held = rows.join(ends.where(F.col("__sl_size") >= n), rows[group].eqNullSafe(ends[group])).drop(ends[group])
    held = held.withColumn("__sl_b", F.coalesce(F.floor((first - F.col("__sl_low")) / width), F.lit(-1)))
    sizes = held.groupBy(group, "__sl_b").agg(F.count("*").alias("__sl_n"))
    before = F.coalesce(F.sum("__sl_n").over(Window.partitionBy(group).orderBy("__sl_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(group).alias("__sl_g"), F.col("__sl_b").alias("__sl_c"), before.alias("__sl_before"))
    held = held.join(sizes, held[group].eqNullSafe(sizes["__sl_g"]) & (F.col("__sl_b") == F.col("__sl_c")))
    place = F.col("__sl_before") + F.row_number().over(Window.partitionBy(group, "__sl_b").orderBy(*(F.col(c).asc_nulls_first() for c in order))) - 1
    placed = held.withColumn("__sl_at", place)
    pick = f"((__sl_at * {n} + __sl_size - 1) div __sl_size)"  # the first i with i * size / n >= place
    return placed.where(F.expr(f"{pick} < {n} AND {pick} * __sl_size div {n} = __sl_at")).select(*rows.columns)
