"""k-mer similarity search with top-range ranking, clustering by it, and break points.

Edge cases: null ids and sequences take no part; a sequence shorter than a word has no similarity;
repeated ids count as one sequence with all their words. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import kmers, reverse_complement
from .hierarchy import stored
from .records import mask_by_quality


def enough_tasks(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as shuffles use, if it has fewer (a file or two)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def _words(rows: DataFrame, name: str, found: Column) -> DataFrame:
    return enough_tasks(rows.where("id IS NOT NULL")).select(F.col("id").alias(name), F.explode(found).alias("kmer")).distinct()


def similarities(
    queries: DataFrame, references: DataFrame, k: int = 8, least: float = 40.0, top_range: float = 1.0, step: int = 1, strands: str = "+", only: str | None = None, least_quality: float | None = None, with_self: bool = True, others_as: str | None = None
) -> DataFrame:
    """qid, rid, shared and pct (and strand, if both are asked for): 100 * shared distinct k-mers / the
    smaller number of k-mers, the queries' taken every ``step`` characters.

    Both sides are (id, seq). ``strands``: + for the queries as they are, - for their reverse
    complements, +- for both, of which the better one counts for each pair (+ if they are equal). ``only``: characters
    that all of a k-mer's must be among (AGCTU). ``others_as``: a base that all characters but these five, in either
    case, are read as instead.
    ``least_quality``: queries have ``values`` too, and bases under it are masked first. Without
    ``with_self`` an id's match with the same id is left out. Matches come from an equality join on
    k-mers, counted per pair; kept are those of ``least`` percent or more within ``top_range`` of the
    query's best. The pairs of a frequent k-mer are spread over ``SALTS`` tasks by the query.
    """
    seq = F.col("seq")
    if least_quality is not None:
        seq = mask_by_quality(seq, F.col("values"), float("-inf"), least_quality - 1e-9)
    read_as = (lambda x: F.regexp_replace(x, "[^AGCTUagctu]", others_as)) if others_as else (lambda x: x)
    sides = [(s, read_as(seq if s == "+" else reverse_complement(seq))) for s in strands]
    q = [_words(queries, "qid", kmers(x, k, step, only)).withColumn("strand", F.lit(s)) for s, x in sides]
    q = q[0] if len(q) == 1 else q[0].unionByName(q[1])
    r = _words(references, "rid", kmers(read_as(F.col("seq")), k, 1, only))
    nq, nr = q.groupBy("qid", "strand").agg(F.count("*").alias("nq")), r.groupBy("rid").agg(F.count("*").alias("nr"))
    hits = joined_by_word(q, r, "kmer", F.xxhash64("qid"))
    if not with_self:
        hits = hits.where("qid <> rid")
    scored = hits.groupBy("qid", "rid", "strand").agg(F.count("*").alias("shared")).join(nq, ["qid", "strand"]).join(nr, "rid")
    scored = scored.withColumn("pct", F.round(100 * F.col("shared") / F.least("nq", "nr"), 5)).where(F.col("pct") >= least)
    if len(sides) > 1:
        better = F.max(F.struct("pct", "shared", (F.col("strand") == "+").alias("plus"))).alias("b")
        scored = scored.groupBy("qid", "rid").agg(better).select("qid", "rid", "b.pct", "b.shared", F.when(F.col("b.plus"), "+").otherwise("-").alias("strand"))
    best = F.max("pct").over(Window.partitionBy("qid"))
    kept = scored.withColumn("best", best).where(F.col("pct") >= F.col("best") - top_range)
    return kept.select("qid", "rid", *(["strand"] if len(sides) > 1 else []), "shared", "pct")


#: Places among which the pairs of a frequent k-mer are spread.
SALTS = 32


def joined_by_word(left: DataFrame, right: DataFrame, word: str, by: Column) -> DataFrame:
    """Inner join on a word. A word that more than ``SALTS`` rows of ``right`` have meets the rows of ``left`` in
    ``SALTS`` places, dealt by ``by``, each with all of these rows of ``right``; words of ``left`` that ``right``
    lacks go before they are dealt."""
    often = right.groupBy(word).agg(F.count("*").alias("__sl_often"))
    hot = F.col("__sl_often") > SALTS
    spread = right.join(often, word).withColumn("__sl_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))))
    dealt = left.join(often, word).withColumn("__sl_salt", F.when(hot, F.pmod(by, F.lit(SALTS)).cast("int")).otherwise(-1))
    return dealt.drop("__sl_often").join(spread.drop("__sl_often"), [word, "__sl_salt"]).drop("__sl_salt")


def share_of_best(rows: DataFrame, group: str, score: str) -> DataFrame:
    """rows with ``ratio``: the score over the best of its group; null where that is 0 or null."""
    best = F.max(score).over(Window.partitionBy(group))
    return rows.withColumn("ratio", F.col(score) / F.nullif(best, F.lit(0)))


def greedy_clusters(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """id and seed of all ``items`` (id, weight): the clusters that going through them by weight (the
    heavier first, then the smaller id) makes, where an item joins the heaviest seed that it is paired
    with and is a seed if there is none. ``pairs``: a, b (similar items, in any order).

    In rounds over the pairs alone: an item is a seed once none of its heavier partners can be one, and
    joins once a partner is a seed. Each round settles at least the heaviest open items; rounds end when
    nothing is open. Mixed weights take few rounds; a path of items in falling weight takes one for each two items, three
    tables written in each. Pairs with unknown or equal ids and null ids are left out.
    """
    known = items.where("id IS NOT NULL").groupBy("id").agg(F.max("weight").alias("weight"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    order = lambda w, i: F.struct((-F.coalesce(F.col(w), F.lit(0))).alias("w"), F.col(i).alias("id"))
    ranked = both.join(known.select(F.col("id").alias("a"), F.col("weight").alias("wa")), "a").join(known.select(F.col("id").alias("b"), F.col("weight").alias("wb")), "b")
    heavier = stored(ranked.where(order("wb", "b") < order("wa", "a")).select("a", "b", order("wb", "b").alias("rank")))  # b comes before a
    state = stored(known.select("id", F.lit(None).cast(known.schema["id"].dataType).alias("seed")).join(heavier.select(F.col("a").alias("id")).distinct(), "id", "left_semi"))
    first = known.join(state.select("id"), "id", "left_anti").select("id", F.col("id").alias("seed"))  # no heavier partner
    settled = stored(first)
    while not state.isEmpty():
        of = settled.select(F.col("id").alias("b"), "seed")
        seen = heavier.join(state.select(F.col("id").alias("a")), "a", "left_semi").join(of, "b", "left")
        is_seed = F.col("seed") == F.col("b")
        # Joins if the first of its heavier partners that is a seed has no open partner before it.
        verdict = seen.groupBy("a").agg(F.min(F.when(is_seed, F.col("rank"))).alias("seed"), F.min(F.when(F.col("seed").isNull(), F.col("rank"))).alias("open"))
        done = verdict.where("open IS NULL OR seed < open").select(F.col("a").alias("id"), F.coalesce("seed.id", "a").alias("seed"))
        done = stored(done)
        state = stored(state.join(done.select("id"), "id", "left_anti"))
        settled = stored(settled.unionByName(done))
    return settled


def break_points(scores: DataFrame, group: str, order: list[str], left: str, right: str) -> DataFrame:
    """For each group the position after which to change from the left to the right parent: that
    with the largest sum of left scores up to it and right scores after it. Ties: the first. A group's
    rows are ordered in one task; for reads see ``chimera``, where a row is a place of a read."""
    w = Window.partitionBy(group).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(right).over(Window.partitionBy(group))
    s = scores.withColumn("position", F.row_number().over(w)).withColumn("score", F.sum(left).over(run) + total - F.sum(right).over(run))
    return s.groupBy(group).agg(F.max(F.struct(F.col("score"), -F.col("position"))).alias("b")).select(group, (-F.col("b.col2")).alias("position"), F.col("b.score").alias("score"))
