"""Chimeric reads: a left and a right part that resemble different references.

A read is cut into words every ``step`` characters (repeats count), references into all their distinct
words. From the left, and from the right, words shared with each reference are counted as the read goes
on; what the best reference lacks so far is the left (right) dissimilarity at a place. Where the sum of
both is smallest lies the join; how steeply the sum rises on both sides makes the score.

The join on words, the counts and the maxima are DataFrame work, spread by read and reference; only a
read's curve, a number per place, is looked at in one go by a small helper.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import kmers, words
from .similarity import joined_by_word


def best_so_far(hits: DataFrame, order: str) -> DataFrame:
    """read, place, shared and ref: of the references that share the word at a place, the one with most
    words shared up to it in the given order, and how many (ties: the smaller reference)."""
    run = Window.partitionBy("read", "ref").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = hits.withColumn("shared", F.sum("n").over(run))
    return counted.groupBy("read", "place").agg(F.max(F.struct("shared", (-F.col("ref")).alias("ref"))).alias("best")).select("read", "place", "best.shared", (-F.col("best.ref")).alias("ref"))


def curve(places: np.ndarray, shared: np.ndarray, refs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Dissimilarity and best reference at each of n places, in the order of counting: what is reached
    at a place holds until more is."""
    total, ref = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    order = np.argsort(places)
    total[places[order]] = shared[order]
    ref[places[order]] = refs[order]
    most = np.maximum.accumulate(total)
    rises = np.concatenate([[most[0] > 0], most[1:] > most[:-1]])
    last = np.maximum.accumulate(np.where(rises, np.arange(n), -1))
    return np.arange(1, n + 1) - most, np.where(last >= 0, ref[last], -1)


def valley(left: np.ndarray, right: np.ndarray, step: int, least_parent: int) -> dict[str, float]:
    """The join (an index), both edges, the parts' similarities in percent, and the score."""
    n, total = len(left), left + right
    lowest = np.flatnonzero(total == total.min())
    join = int(lowest[0] + lowest[-1]) // 2
    # An edge is the nearest of the highest places on its side, if higher than the other part's curve.
    begin = end = join
    if join and total[:join].max() > right[join]:
        begin = join - 1 - int(np.argmax(total[:join][::-1]))
    if join + 1 < n and total[join + 1 :].max() > left[join]:
        end = join + 1 + int(np.argmax(total[join + 1 :]))

    def off(curve: np.ndarray, far: int, near: int, gain: int) -> float:
        """The straight line between the edges at the join, over the curve a quarter beyond it."""
        line = int(curve[far] + (curve[near] - curve[far]) * abs(far - join) // (end - begin + 1))
        return line / curve[gain] if curve[gain] else float(line)

    left_off = off(right, end, begin, join + (end - join) // 4)
    right_off = off(left, begin, end, join - (join - begin) // 4)
    enough = int(least_parent / step) <= min(join + 1, n - join)
    return {
        "join": join,
        "left_pct": 100 - 100 * float(left[max(join - 1, 0)]) / (join + 1),
        "right_pct": 100 - 100 * float(right[min(join + 1, n - 1)]) / (n - join + 1),
        "score": int(step * left_off * right_off / 2) if enough else 0,
    }


def chimera_scores(reads: DataFrame, references: DataFrame, k: int = 8, step: int = 4, least_parent: int = 80) -> DataFrame:
    """read, position, score, left_ref, right_ref, left_pct and right_pct of every read of a word or more.

    ``reads`` and ``references``: id (a long) and seq. position is the character at which the read
    changes parents; a score is 0 where a part is shorter than ``least_parent``; a part that shares no
    word has a null reference. Reads without an id or shorter than a word are left out, as are references
    without an id; repeated ids are one read each by their text.
    """
    held = reads.where(F.col("id").isNotNull() & (F.length("seq") >= k)).select("id", "seq").distinct().withColumn("read", F.struct("id", F.md5(F.col("seq").cast("binary"))))
    stepped = F.filter(words(F.col("seq"), k), lambda _, i: i % step == 0)
    placed = held.select("read", F.transform(stepped, lambda w: F.xxhash64(w)).alias("ws"))
    sizes = placed.select("read", F.size("ws").alias("n"))
    known = references.where("id IS NOT NULL").select(F.col("id").alias("ref"), F.explode(kmers(F.col("seq"), k)).alias("w")).distinct()
    # A word that most references share meets the reads' places in several tasks.
    hits = joined_by_word(placed.select("read", F.posexplode("ws").alias("place", "w")), known, "w", F.xxhash64("read", "place")).groupBy("read", "ref", "place").agg(F.lit(1).alias("n"))
    hits = hits.withColumn("back", -F.col("place"))
    sides = [best_so_far(hits, order).groupBy("read").agg(F.collect_list(F.struct("place", "shared", "ref")).alias(name)) for order, name in (("place", "from_left"), ("back", "from_right"))]
    rows = sizes.join(sides[0], "read", "left").join(sides[1], "read", "left").select(F.col("read.id").alias("read"), "n", "from_left", "from_right")

    def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Where each row's values begin, and (place, shared, ref) of all; a null row has none."""
        held = lists.flatten()
        values = np.array([held.field(k).to_numpy(zero_copy_only=False) for k in range(3)], np.int64).reshape(3, -1)
        return np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in lists])]), values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            sides = [flat(batch.column(name)) for name in ("from_left", "from_right")]
            for i, (read, n) in enumerate(zip(batch.column("read").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                (p, s, r), (p2, s2, r2) = (values[:, offsets[i] : offsets[i + 1]] for offsets, values in sides)
                left, left_ref = curve(p, s, r, n)
                right, right_ref = (x[::-1] for x in curve(n - 1 - p2, s2, r2, n))
                v = valley(left, right, step, least_parent)
                at = v["join"]
                name = lambda x: None if x < 0 else int(x)
                out.append({"read": read, "position": at * step + k // 2, "score": v["score"], "left_ref": name(left_ref[at]), "right_ref": name(right_ref[at]), "left_pct": v["left_pct"], "right_pct": v["right_pct"]})
            yield pa.RecordBatch.from_pylist(out, kinds)

    kinds = pa.schema([("read", pa.int64()), ("position", pa.int64()), ("score", pa.int64()), ("left_ref", pa.int64()), ("right_ref", pa.int64()), ("left_pct", pa.float64()), ("right_pct", pa.float64())])
    return rows.withColumn("read", F.col("read").cast("long")).mapInArrow(run, "read long, position long, score long, left_ref long, right_ref long, left_pct double, right_pct double")


def not_chimeric(reads: DataFrame, scores: DataFrame, least_score: int = 30) -> DataFrame:
    """The reads (id) of a score under ``least_score``, and those that have none."""
    return reads.join(scores.where(F.col("score") >= least_score).select(F.col("read").alias("id")).distinct(), "id", "left_anti")
