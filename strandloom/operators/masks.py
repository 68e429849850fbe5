"""Word masks: sets of words as bitmaps, rolled up a tree, and each node's conserved and unique words.

Words of ``k`` characters of an alphabet are numbers to the base of its size. A mask is a bitmap of such numbers in
buckets of 32,768 bits (4 KB each), made and united by Spark's bitmap aggregates: (key, bucket, mask). A word's
number of groups is counted once, from one row per word and group; from then on nodes hold masks only, so
rolling up a tree moves 4 KB per node and bucket, however many sequences there are.

Edge cases. Null keys and sequences take no part; words with a character outside the alphabet are none; repeated
words and equal sequences of an id count once per id. Empty tables give empty results. Helper columns begin
with ``__sl_``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

BITS = 32_768
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def word_numbers(seq: Column, k: int, alphabet: str) -> Column:
    """The different words of a sequence as numbers (from 1, as bitmaps count), an array of longs.
    ``alphabet``: up to 36 characters, none twice."""
    if not 2 <= len(set(alphabet)) == len(alphabet) <= len(_DIGITS) or len(alphabet) ** k >= 1 << 62:
        raise ValueError("an alphabet has 2 to 36 different characters, and words of it fit a long")
    base = len(alphabet)
    # All that isn't of the alphabet becomes a blank, so runs of it are what lies between blanks.
    foreign = F.regexp_replace(seq, "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in alphabet) + "]", " ")
    runs = F.filter(F.split(F.translate(foreign, alphabet, _DIGITS[:base]), " "), lambda r: F.length(r) >= k)
    words = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - (k - 1)), lambda i: F.substring(r, i, F.lit(k)))))
    return F.transform(F.array_distinct(words), lambda w: F.conv(w, base, 10).cast("long") + 1)


def word_of(number: Column, k: int, alphabet: str) -> Column:
    """The word that a number of ``word_numbers`` stands for."""
    return F.translate(F.lpad(F.lower(F.conv((number - 1).cast("string"), 10, len(alphabet))), k, "0"), _DIGITS[: len(alphabet)], alphabet)


def members_with(rows: DataFrame, group: str, member: str, seq: str, k: int, alphabet: str) -> DataFrame:
    """group, word and n: in how many of a group's members (ids) a word is."""
    held = rows.where(F.col(group).isNotNull() & F.col(member).isNotNull())
    words = held.select(F.col(group).alias("group"), F.col(member).alias("__sl_m"), F.explode(word_numbers(F.col(seq), k, alphabet)).alias("word")).distinct()
    return words.groupBy("group", "word").agg(F.count("*").alias("n"))


def masks_of(words: DataFrame, key: str) -> DataFrame:
    """key, bucket and mask of rows (key, word)."""
    return words.groupBy(key, F.bitmap_bucket_number("word").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("word")).alias("mask"))


def united(masks: DataFrame, key: str) -> DataFrame:
    """The union of the masks of each key and bucket."""
    return masks.groupBy(key, "bucket").agg(F.bitmap_or_agg("mask").alias("mask"))


@F.pandas_udf(BinaryType())
def _without(masks: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([m if o is None else (np.frombuffer(m, np.uint8) & ~np.frombuffer(o, np.uint8)).tobytes() for m, o in zip(masks, others, strict=True)])


def without(masks: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Masks less what ``others`` have in the same key and bucket."""
    both = masks.join(others.select(key, "bucket", F.col("mask").alias("__sl_o")), [key, "bucket"], "left")
    return both.select(key, "bucket", _without("mask", "__sl_o").alias("mask"))


def mask_words(masks: DataFrame, key: str) -> DataFrame:
    """key and word of every bit that is set."""

    @F.pandas_udf("array<long>")
    def places(found: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little")) for m in found])

    return masks.select(key, F.explode(places("mask")).alias("__sl_at"), "bucket").select(key, (F.col("__sl_at") + (F.col("bucket") - 1) * BITS + 1).alias("word"))


def signature_words(rows: DataFrame, group: str, member: str, seq: str, tree: DataFrame, ancestors: DataFrame, k: int = 7, alphabet: str = "acgt", least_members: float = 95.0, least_groups: float = 95.0) -> DataFrame:
    """node, word, conserved and unique: the words by which a node of a tree is known.

    ``rows`` belong to groups, tips of ``tree`` (node, parent); ``ancestors`` is its closure. A word is
    conserved in a group if ``least_members`` percent of its members have it, and in a node if it is conserved in
    ``least_groups`` percent of the groups below it that have members. It is unique if a member of the node's
    groups has it and none of another group. Only words that are one or the other are rows.
    """
    counted = members_with(rows, group, member, seq, k, alphabet)
    members = rows.where(F.col(group).isNotNull() & F.col(member).isNotNull() & F.col(seq).isNotNull()).select(F.col(group).alias("group"), member).distinct().groupBy("group").agg(F.count("*").alias("__sl_members"))
    above = ancestors.select(F.col("node").alias("group"), F.col("ancestor").alias("node"))
    kept = counted.join(members, "group").where(100 * F.col("n") >= least_members * F.col("__sl_members")).select("group", "word")
    if least_groups >= 100:  # in all groups: an intersection of masks; a bucket that a group lacks is empty
        below = above.join(members, "group").groupBy("node").agg(F.count("*").alias("__sl_groups"))
        met = masks_of(kept, "group").join(above, "group").groupBy("node", "bucket").agg(F.bitmap_and_agg("mask").alias("mask"), F.count("*").alias("__sl_held"))
        conserved = met.join(below, "node").where(F.col("__sl_held") == F.col("__sl_groups")).select("node", "bucket", "mask")
    else:
        below = above.join(members, "group").groupBy("node").agg(F.count("*").alias("__sl_groups"))
        often = kept.join(above, "group").groupBy("node", "word").agg(F.count("*").alias("n")).join(below, "node")
        conserved = masks_of(often.where(100 * F.col("n") >= least_groups * F.col("__sl_groups")), "node")
    own = masks_of(counted.select("group", "word"), "group")
    seen = united(own.join(above, "group"), "node")
    # Words of two or more children of a parent are unique to none of them, nor to what is below them. Roots
    # are children of nothing, which all nodes are below.
    name = lambda x: F.to_json(F.struct(x.alias("p")))
    up = tree.where("node IS NOT NULL").select("node", name(F.col("parent")).alias("__sl_up")).distinct()
    children = mask_words(seen.join(up, "node").withColumn("__sl_key", F.struct("__sl_up", "node")), "__sl_key")
    twice = children.groupBy(F.col("__sl_key.__sl_up").alias("__sl_up"), "word").agg(F.count("*").alias("n")).where("n > 1")
    over = ancestors.where("node <> ancestor").select("node", name(F.col("ancestor")).alias("__sl_up"))
    over = over.unionByName(ancestors.select("node", F.lit("{}").alias("__sl_up")).distinct())
    elsewhere = over.join(masks_of(twice, "__sl_up"), "__sl_up")
    unique = without(seen, united(elsewhere, "node"), "node")
    a = mask_words(conserved, "node").withColumn("conserved", F.lit(True))
    b = mask_words(unique, "node").withColumn("unique", F.lit(True))
    both = a.join(b, ["node", "word"], "full_outer")
    return both.select("node", word_of(F.col("word"), k, alphabet).alias("word"), F.coalesce("conserved", F.lit(False)).alias("conserved"), F.coalesce("unique", F.lit(False)).alias("unique"))
