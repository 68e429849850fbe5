"""Grouping of a distance table: clusters merged from the nearest on, as a tree, in rounds.

In each round every two clusters that are each other's nearest merge, all over the table at once. For single, complete and
average linkage this gives the tree that merging one pair at a time gives, as a merge never brings others nearer
than they were to one of its parts. The table is sparse: pairs that it lacks count as ``pad`` apart, so they
matter in averages and maxima but are never rows. Distances of equal size go by the smaller ids first.

A round is a minimum by cluster, a join of it with itself and one aggregate of the links that are left, and is written.
Rounds are about the logarithm of the number of items where distances are mixed; a chain of items whose distances grow
from one end takes as many rounds as it has links.

Edge cases. Pairs with a null, of an id with itself, or farther than ``most`` in the table are no nearest pairs; the
latter still count in averages. Of repeated pairs (in either order) the smallest distance counts. Ids of ``items`` without
pairs are clusters of one. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hierarchy import stored


def merges(pairs: DataFrame, linkage: str = "average", most: float = 1.0, pad: float = 1.0) -> DataFrame:
    """a, b, distance, size and round of all merges up to the distance ``most``: ``a`` and ``b`` (the larger id) are the
    smallest ids of both clusters, and ``a`` names the new one of ``size`` items. ``pairs``: a, b, distance."""
    if linkage not in ("single", "complete", "average"):
        raise ValueError("linkage is single, complete or average")
    both = pairs.where("a <> b AND distance IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("distance").cast("double").alias("distance"))
    links = both.groupBy("a", "b").agg(F.min("distance").alias("near"))
    links = stored(links.select("a", "b", "near", F.col("near").alias("far"), F.col("near").alias("held"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("n_a"), F.lit(1).cast("long").alias("n_b")))
    kind = pairs.schema["a"].dataType.simpleString()
    found = None
    turn = 0
    while not links.isEmpty():
        turn += 1
        ways = F.col("n_a") * F.col("n_b")
        missing = ways - F.col("n")
        far = F.when(missing > 0, F.greatest("far", F.lit(pad))).otherwise(F.col("far"))
        distance = {"single": F.col("near"), "complete": far, "average": (F.col("held") + missing * pad) / ways}[linkage]
        measured = links.withColumn("distance", distance)
        near = measured.where(F.col("distance") <= most)
        rank = F.struct("distance", "a", "b")
        best = near.select(F.explode(F.array(F.struct(F.col("a").alias("node"), rank.alias("rank")), F.struct(F.col("b").alias("node"), rank.alias("rank")))).alias("x")).groupBy("x.node").agg(F.min("x.rank").alias("rank"))
        # A pair that is the nearest of both its clusters comes twice.
        mutual = best.groupBy("rank").agg(F.count("*").alias("times")).where("times = 2").select("rank.*")
        sizes = measured.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("size"))
        made = stored(mutual.join(sizes, ["a", "b"]).select("a", "b", "distance", "size", F.lit(turn).alias("round")))
        if made.isEmpty():
            break
        found = made if found is None else found.unionByName(made)
        names = made.select(F.explode(F.array(F.struct(F.col("a").alias("old"), F.col("a").alias("new"), F.col("size").alias("size")), F.struct(F.col("b").alias("old"), F.col("a").alias("new"), F.col("size").alias("size")))).alias("x")).select("x.*")
        renamed = links
        for side in ("a", "b"):
            renamed = renamed.join(names.select(F.col("old").alias(side), F.col("new").alias(f"new_{side}"), F.col("size").alias(f"size_{side}")), side, "left")
        ends = [F.struct(F.coalesce(f"new_{s}", s).alias("id"), F.coalesce(f"size_{s}", f"n_{s}").alias("n")) for s in ("a", "b")]
        turned = renamed.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y"), "near", "far", "held", "n").where("x.id <> y.id")
        links = stored(turned.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).agg(F.min("near").alias("near"), F.max("far").alias("far"), F.sum("held").alias("held"), F.sum("n").alias("n")).select("a", "b", "near", "far", "held", "n", "n_a", "n_b"))
    return found if found is not None else pairs.sparkSession.createDataFrame([], f"a {kind}, b {kind}, distance double, size long, round int")


def groups(items: DataFrame, tree: DataFrame) -> DataFrame:
    """id and cluster (its smallest id) of all ``items`` (id), from the ``merges``. A merge names its cluster by the
    smaller id, so an id leads to its cluster over ever smaller ones: by doubling, in rounds of a join."""
    ids = items.where("id IS NOT NULL").select("id").distinct()
    ways = stored(tree.select(F.col("b").alias("id"), F.col("a").alias("up")))
    while True:
        on = ways.select(F.col("id").alias("up"), F.col("up").alias("top"))
        longer = stored(ways.join(on, "up", "left").select("id", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        ways = longer.select("id", "up")
        if longer.where("moved").isEmpty():
            break
    return ids.join(ways, "id", "left").select("id", F.coalesce("up", "id").alias("cluster"))
