"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source has a target number of words. Blocks of ``block`` words are apportioned to the sources
by highest quotients target / (2 k + 1), and each source's blocks to its shards in the same way, by
their words. In a shard the documents lie in a seeded order, end to end; its blocks are taken in
whole rounds and a seeded run of blocks for the rest. What a document gives is the part of it that
taken blocks cover, which follows from its place by arithmetic.

Edge cases. A null text has no words; a document without words gives none. A null source is a source
of its own, after all others. A total of zero words gives targets of zero. Repeated rows count as
documents of their own; equal rows may trade places. Extra columns are dropped.

A source list is taken to be small (names of corpora): one row per source comes to the driver.
Shards hold about ``shard_rows`` documents each. A source's shards are apportioned in two levels, so a
task that apportions holds about the square root of their number. Rows that are equal in id, source and text
are one row with a number until the end, dealt to as many shards as ``shard_rows`` of them need.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
BLOCK = 16
SEED = 17


def word_count(text: Column) -> Column:
    """Runs of characters other than the six ASCII white space characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """``share`` of all words by weight; what is above ``limit`` times a source's size goes to the
    others by weight, until none is above."""
    total = share * sum(sizes)
    out: list[float | None] = [None] * len(sizes)
    while True:
        open_ = [i for i, x in enumerate(out) if x is None]
        rest = total - sum(x for x in out if x is not None)
        scale = sum(weights[i] for i in open_)
        if not open_:
            return [float(x) for x in out]
        over = [i for i in open_ if rest * weights[i] / scale > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / scale
            return [float(x) for x in out]
        for i in over:
            out[i] = limit * sizes[i]


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1), none above its ``most``; ties to the first.

    The bulk is found by bisecting for the quotient that the last seat has, the rest by a heap.
    """
    seats = min(seats, sum(m for v, m in zip(votes, most, strict=True) if v > 0))
    low, high = 0.0, max(votes, default=0.0) + 1.0
    given = lambda q: [min(m, int((v / q + 1) / 2)) if v > 0 else 0 for v, m in zip(votes, most, strict=True)]
    if not seats:
        return [0] * len(votes)
    for _ in range(200):
        middle = (low + high) / 2
        if sum(given(middle)) > seats:
            low = middle
        else:
            high = middle
    out = given(high)
    heap = [(-v / (2 * k + 1), i) for i, (v, k, m) in enumerate(zip(votes, out, most, strict=True)) if k < m and v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def apportioned(totals: DataFrame, keys: list[str], of: str, given: str) -> DataFrame:
    """``totals`` (keys, of, words, most and the ``given`` seats of their keys) with a quota of seats each:
    the seats of equal keys by highest quotients of words, none above ``most``."""

    def quotas(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(of)
        return rows.assign(quota=sainte_lague([float(w) for w in rows["words"]], int(rows[given].iloc[0]), [int(x) for x in rows["most"]]))

    kinds = ", ".join(f"{c} {totals.schema[c].dataType.simpleString()}" for c in totals.columns)
    return totals.groupBy(*keys).applyInPandas(quotas, f"{kinds}, quota long")


def laid_out(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, block: int = BLOCK, seed: int = SEED, shard_rows: int = 256) -> DataFrame:
    """doc_id, mark (a hash of the text), source, size, source_size, target and taken of every row."""
    spark = documents.sparkSession
    sized = documents.select("doc_id", "source", F.xxhash64("text").alias("mark"), word_count(F.col("text")).alias("size"))
    sized = durable(sized.groupBy("doc_id", "source", "mark", "size").agg(F.count("*").alias("copies")))
    found = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.sum("copies").alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # Python orders strings by code point
    words = [r["words"] for r in found]
    goal = targets(words, [weights[i % len(weights)] for i in range(len(found))], share, limit)
    # A shard ends with a block that may be short, so the number of blocks is known only by shard;
    # what a source can give at most is bounded by its words, in blocks of the full size.
    blocks = sainte_lague(goal, round(sum(goal) / block), [int(limit) * -(-w // block) for w in words])
    plan = [(i, r["source"], w, g, b, shards, max(1, math.isqrt(shards))) for i, (r, w, g, b) in enumerate(zip(found, words, goal, blocks, strict=True)) for shards in [-(-r["rows"] // shard_rows)]]
    sources = spark.createDataFrame(plan, "of int, source string, source_size long, target double, blocks long, shards int, groups int")
    placed = sized.join(F.broadcast(sources) if len(plan) <= 10_000 else sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / shard_rows)))
    placed = placed.withColumn("part", part).withColumn("times", F.least(F.lit(shard_rows).cast("long"), F.col("copies") - F.col("part") * shard_rows))
    placed = placed.withColumn("shard", F.pmod(F.pmod(F.xxhash64("doc_id", "size", "mark", F.lit(seed)), F.col("shards")) + F.col("part"), F.col("shards")).cast("int"))
    all_of_it = F.col("size") * F.col("times")
    most = F.lit(int(limit)) * F.ceil(F.col("words") / block)
    shards = placed.groupBy("of", "shard", "groups", "blocks").agg(F.sum(all_of_it).alias("words")).withColumn("most", most).withColumn("group", F.col("shard") % F.col("groups"))
    groups = shards.groupBy("of", "group", "blocks").agg(F.sum("words").alias("words"), F.sum("most").alias("most"))
    by_group = apportioned(groups, ["of"], "group", "blocks").select("of", "group", F.col("quota").alias("own"))
    quota = apportioned(shards.select("of", "group", "shard", "words", "most").join(by_group, ["of", "group"]), ["of", "group"], "shard", "own")
    placed = placed.join(quota.select("of", "shard", F.col("words").alias("shard_words"), "quota"), ["of", "shard"])
    lie = Window.partitionBy("of", "shard").orderBy(F.xxhash64("doc_id", "mark", F.lit(seed), F.lit("order")), "doc_id", "size", "mark", "part")
    end = F.sum(all_of_it).over(lie.rowsBetween(Window.unboundedPreceding, 0))
    n = F.greatest(F.lit(1), F.ceil(F.col("shard_words") / block))
    rounds, rest = F.floor(F.col("quota") / n), F.col("quota") % n
    begin = F.pmod(F.xxhash64("source", "shard", F.lit(seed)), n)
    one = placed.withColumn("end", end).withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))  # equal rows end to end
    laid = one.withColumn("start", F.col("end") - F.col("size") * F.col("one")).withColumn("end", F.col("start") + F.col("size")).withColumn("n", n)
    laid = laid.withColumn("rounds", rounds).withColumn("run", begin).withColumn("rest", rest)
    covered = lambda a, b: F.greatest(F.lit(0), F.least("end", b) - F.greatest("start", a))
    # The run of blocks [run, run + rest) goes on at block 0 if it passes the last block.
    first = covered(F.col("run") * block, F.least(F.col("run") + F.col("rest"), F.col("n")) * block)
    again = covered(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("run") + F.col("rest") - F.col("n")) * block)
    taken = F.when(F.col("shard_words") == 0, 0).otherwise(F.col("rounds") * F.col("size") + first + again)
    return laid.select("doc_id", "mark", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, block: int = BLOCK, seed: int = SEED, shard_rows: int = 256) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row."""
    return laid_out(documents, weights, share, limit, block, seed, shard_rows).drop("mark")


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mix as rows: each of ``documents`` as often as whole copies of it come nearest to the
    words that the mix takes of it (not at all, once or twice), all columns as they are. Rows that are
    equal in id and text all come as often as the one of which the mix takes most."""
    copies = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    shares = laid_out(documents).groupBy("doc_id", "mark").agg(F.max(copies).alias("copies")).where("copies > 0")
    rows = documents.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_mark"), F.struct("*").alias("_row"))
    joined = rows.join(shares, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_mark") == F.col("mark")))
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")
