"""Trees and profiles: closure, roll-up, normalising, merging, common ancestors and scores of hits.

Edge cases, where an operator doesn't say otherwise: rows with a null key join nothing and drop out of
sums by key; null scores add nothing; an empty table gives an empty result; repeated rows count as often
as they occur. Helper columns begin with ``__sl_``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the session's ``spark.checkpoint.dir``, its lineage cut. Where that is unset, on a
    single machine only, a temporary folder is made."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandloom-"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder of ``written``, read again. For loops of joins: a checkpoint keeps its
    plan's estimated size, which is squared in each round until its digits alone take minutes; a table has its own."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        written(spark.range(0))
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """node, ancestor and dist of ``nodes`` (node, parent), each node its own at distance 0; the shortest
    distance where there are several ways (a node may have several rows, for several parents).

    By doubling: ways of up to 2, 4, 8, ... steps are joined with each other until none is new, so a
    tree of depth d takes log2(d) rounds, each written. A cycle's nodes are ancestors of each other. A
    parent that is no node is an ancestor all the same.
    """
    own = nodes.where("node IS NOT NULL").select("node", F.col("node").alias("ancestor"), F.lit(0).alias("dist")).distinct()
    up = nodes.where("node IS NOT NULL AND parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("dist"))
    ways = written(own.union(up).groupBy("node", "ancestor").agg(F.min("dist").alias("dist")))
    held = ways.count()
    while True:
        # ``here`` is asked for from both sides; rows of distance 0 carry what there is.
        on = ways.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("__sl_top"), F.col("dist").alias("__sl_more"))
        longer = ways.join(on, "ancestor", "left").select("node", F.coalesce("__sl_top", "ancestor").alias("ancestor"), (F.col("dist") + F.coalesce("__sl_more", F.lit(0))).alias("dist"))
        ways = written(ways.union(longer).groupBy("node", "ancestor").agg(F.min("dist").cast("int").alias("dist")))
        now = ways.count()
        if now == held:
            return ways
        held = now


def roll_up(scores: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Sums of ``scores`` (node, score) at every ancestor; scores are first summed by node."""
    own = scores.groupBy("node").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
    return own.join(ancestors, "node").groupBy("ancestor").agg(F.sum("score").alias("score"), F.sum("n").alias("n")).withColumnRenamed("ancestor", "node")


def normalised(profile: DataFrame, sample: str, score: str, to: float = 100_000) -> DataFrame:
    """Scores scaled so that a sample's add up to ``to``; 0 where they add up to nothing. Totals are added
    up on the map side and joined, so a hot sample isn't gathered; null samples are one."""
    total = profile.groupBy(F.col(sample).alias("__sl_s")).agg(F.sum(score).alias("__sl_total"))
    joined = profile.join(total, F.col(sample).eqNullSafe(F.col("__sl_s")))
    return joined.withColumn(score, F.when(F.col("__sl_total") == 0, 0.0).otherwise(F.col(score) * to / F.col("__sl_total"))).drop("__sl_total", "__sl_s")


def merged(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Full outer merge of two profiles (key, score) with 0 for missing rows and the row's maximum."""
    x = a.select(key, F.col("score").alias(names[0])).join(b.select(key, F.col("score").alias(names[1])), key, "full_outer")
    x = x.select(key, *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
    return x.withColumn("row_max", F.greatest(*names))


def common_ancestor(hits: DataFrame, group: str, ranks: list[str]) -> DataFrame:
    """The lowest of ``ranks`` (lowest first) at which all hits of a group agree, and its value."""
    agreed = hits.groupBy(group).agg(*(F.when(F.min(r) == F.max(r), F.min(r).cast("string")).alias(r) for r in ranks))
    level = F.coalesce(*(F.when(F.col(r).isNotNull(), F.lit(r)) for r in ranks), F.lit("root"))
    return agreed.select(group, level.alias("rank"), F.coalesce(*ranks, F.lit("root")).alias("taxon"))


def nodes_from_paths(paths: DataFrame, column: str, separator: str) -> DataFrame:
    """node, parent and name of all prefixes of paths; a root's parent is null."""
    parts = F.split(F.col(column), separator)
    path = lambda n: F.array_join(F.slice("p", F.lit(1), n), separator)
    steps = F.transform(
        F.sequence(F.lit(1), F.size("p")),
        lambda i: F.struct(path(i).alias("node"), F.when(i > 1, path(F.greatest(i - 1, F.lit(1)))).alias("parent"), F.element_at("p", i).alias("name")),
    )
    return paths.select(column).distinct().select(parts.alias("p")).select(F.inline(steps)).distinct()


def with_ancestors(kept: DataFrame, ancestors: DataFrame) -> DataFrame:
    """The nodes of ``kept`` (node) and all their ancestors."""
    return ancestors.join(kept.select("node").distinct(), "node", "left_semi").select(F.col("ancestor").alias("node")).distinct()


def hit_weights(hits: DataFrame, group: str, pct: str, power: float = 1.0) -> DataFrame:
    """weight of each hit: 1 / (1 + best - pct) ** power, scaled so that a group's add up to 1. One
    window, so a group's hits (a read's, few) meet in one task; a null pct has a null weight."""
    w = Window.partitionBy(group)
    raw = hits.withColumn("__sl_w", 1 / F.pow(1 + F.max(pct).over(w) - F.col(pct), F.lit(power)))
    return raw.withColumn("weight", F.col("__sl_w") / F.sum("__sl_w").over(w)).drop("__sl_w")


def scaled_to_mean(profile: DataFrame, sample: str, score: str) -> DataFrame:
    """Scores scaled so that each sample's add up to the mean of the samples' totals, which is joined in
    as one row."""
    total = profile.groupBy(sample).agg(F.sum(score).alias("__sl_total"))
    mean = total.agg(F.avg("__sl_total").alias("__sl_mean"))
    joined = profile.join(total, sample).join(F.broadcast(mean))
    return joined.withColumn(score, F.when(F.col("__sl_total") == 0, 0.0).otherwise(F.col(score) * F.col("__sl_mean") / F.col("__sl_total"))).drop("__sl_total", "__sl_mean")


def score_hits(hits: DataFrame, nodes: DataFrame, ancestors: DataFrame, most_span: int = 1) -> DataFrame:
    """read, node and score: each read's count shared among the tips of the tree that spans its hits.

    ``hits``: read, node (a tip of the tree) and reads (the count, the same for all of a read's hits).
    ``nodes``: node, parent, depth; ``ancestors``: its closure. Of a read's spanning tree, which begins
    at the deepest node that holds all hits, hits beside other children of their parent are clipped:
    their share goes to the parent, and counts there if the parent has no child left. A read whose tips
    then lie more than ``most_span`` levels below that node is ambiguous and its whole count stands at
    the node null, as do hits on no known node. Repeated hits of a read are one.
    """
    # Dealt by read once; all that follows keeps that, the tree's tables come to it.
    own = hits.select("read", F.col("node").alias("tip"), "reads").repartition("read").distinct()
    read = Window.partitionBy("read")  # a read's hits are few
    counted = own.withColumn("tips", F.count("*").over(read)).withColumn("reads", F.max("reads").over(read))
    parents = nodes.select(F.col("node").alias("parent"), F.col("depth").alias("parent_depth"))
    about = nodes.select(F.col("node").alias("ancestor"), "parent", "depth").join(parents, "parent", "left")
    chain = ancestors.select(F.col("node").alias("tip"), "ancestor").join(about, "ancestor")
    spanned = counted.join(chain, "tip", "left").groupBy("read", F.col("ancestor").alias("node"), "tips", "reads", "parent", "depth", "parent_depth").agg(F.count("*").alias("held"), F.max(F.col("tip") == F.col("ancestor")).alias("hit"))
    placed = spanned.withColumn("top", F.max(F.when(F.col("held") == F.col("tips"), F.col("depth"))).over(read))
    # Rows above the spanning tree go; those of a read without one stay, to say so.
    below = placed.where("depth >= top OR top IS NULL")
    beside = Window.partitionBy("read", "parent")
    under = F.col("depth") > F.col("top")
    seen = below.withColumn("siblings", F.count("*").over(beside)).withColumn("children", F.sum(under.cast("int")).over(beside)).withColumn("leaves", F.sum((under & F.col("hit")).cast("int")).over(beside)).withColumn("first", F.min(F.when(under, F.col("node"))).over(beside) == F.col("node"))
    # A hit with no other below it stays a tip unless it has siblings; a parent is one, told by its first
    # child, if all its children are clipped hits.
    stays = F.col("hit") & (F.col("held") == 1) & ((F.col("depth") == F.col("top")) | (F.col("siblings") == 1))
    takes = F.col("first") & (F.col("children") > 1) & (F.col("leaves") == F.col("children"))
    tip = lambda node, depth, share: F.struct(node.alias("node"), depth.cast("int").alias("depth"), share.cast("long").alias("share"))
    none = F.when(F.col("top").isNull(), tip(F.lit(None).cast(nodes.schema["node"].dataType), F.lit(None), F.lit(0)))
    made = F.array(F.when(stays, tip(F.col("node"), F.col("depth"), F.lit(1))), F.when(takes, tip(F.col("parent"), F.col("parent_depth"), F.col("children"))), none)
    tips = seen.select("read", "reads", "tips", "top", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("t"))
    spread = tips.withColumn("deepest", F.max("t.depth").over(read)).withColumn("k", F.row_number().over(read.orderBy("t.node")))
    clear = F.coalesce(F.col("deepest") - F.col("top") <= most_span, F.lit(False))
    score = F.when(clear, F.col("reads") * F.col("t.share") / F.col("tips")).otherwise(F.col("reads").cast("double"))
    return spread.where(clear | (F.col("k") == 1)).select("read", F.when(clear, F.col("t.node")).alias("node"), score.alias("score"))


def rank_tables(profile: DataFrame, nodes: DataFrame, ancestors: DataFrame, ranks: list[str], to: float = 100_000, least: float = 0.0) -> DataFrame:
    """A profile's tables of all ``ranks``: rank, node, sample, score, normalised (a sample's add up to ``to``) and scaled
    (a sample's add up to the mean of the samples' totals). ``profile``: node, sample, score; ``nodes``: node, rank.

    A score counts at the ancestor of each rank, and where a node has none (it lies above the rank, or no node is known)
    at the node null of that rank, so all ranks have the same totals. Nodes of less than ``least`` in all samples together
    are left out after scaling. Scores are added up by node and sample before they meet the tree.
    """
    own = profile.where("sample IS NOT NULL AND score IS NOT NULL").groupBy("node", "sample").agg(F.sum("score").alias("score"))
    ranked = nodes.where(F.col("rank").isin(ranks)).select(F.col("node").alias("ancestor"), "rank")
    above = ancestors.select("node", "ancestor").join(ranked, "ancestor")
    asked = own.withColumn("rank", F.explode(F.array(*(F.lit(r) for r in ranks))))
    at = asked.join(above, ["node", "rank"], "left").groupBy("rank", F.col("ancestor").alias("node"), "sample").agg(F.sum("score").alias("score"))
    totals = own.groupBy("sample").agg(F.sum("score").alias("__sl_total"))  # the same at every rank
    mean = totals.agg(F.avg("__sl_total").alias("__sl_mean"))
    share = F.when(F.col("__sl_total") == 0, 0.0).otherwise(F.col("score") / F.col("__sl_total"))
    told = at.join(totals, "sample").join(F.broadcast(mean)).withColumn("normalised", share * to).withColumn("scaled", share * F.col("__sl_mean"))
    if least > 0:
        kept = at.groupBy("rank", "node").agg(F.sum("score").alias("__sl_sum")).where(F.col("__sl_sum") >= least).withColumnsRenamed({"rank": "__sl_rank", "node": "__sl_node"})
        told = told.join(kept, (F.col("rank") == F.col("__sl_rank")) & F.col("node").eqNullSafe(F.col("__sl_node")), "left_semi")
    return told.select("rank", "node", "sample", "score", "normalised", "scaled")


def filter_profile(profile: DataFrame, samples: list[str], least: float | None = None, least_sum: float | None = None) -> DataFrame:
    """Rows of which the largest sample is ``least`` or more and all add up to ``least_sum`` or more; a
    null score counts as 0."""
    values = [F.coalesce(F.col(s), F.lit(0)) for s in samples]
    kept = profile if least is None else profile.where((F.greatest(*values) if len(values) > 1 else values[0]) >= least)
    return kept if least_sum is None else kept.where(sum(values[1:], values[0]) >= least_sum)


def shown_path(path: Column, separator: str = "; ") -> Column:
    """A taxonomy path without the ranks at its end that have no name (``g__``)."""
    return F.regexp_replace(path, rf"({separator}?[a-z]__)+$", "")


def subtree_counts(leaves: DataFrame, ancestors: DataFrame, item: str) -> DataFrame:
    """For each node the associations (node, item) at or below it, and the distinct items in them."""
    own = leaves.select("node", item).distinct().join(ancestors, "node")
    return own.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("total"), F.countDistinct(item).alias("unique"))


def tree_measures(nodes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """node, depth (the steps to its furthest ancestor), children, leaves (nodes without children at or
    below it) and below (nodes under it) of every node, from a tree (node, parent) and its closure."""
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.countDistinct("node").alias("children"))
    depth = ancestors.groupBy("node").agg(F.max("dist").alias("depth"))
    tips = ancestors.join(children.select("node"), "node", "left_anti").groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("leaves"))
    below = ancestors.groupBy(F.col("ancestor").alias("node")).agg((F.count("*") - 1).alias("below"))
    own = nodes.where("node IS NOT NULL").select("node").distinct()
    joined = own.join(depth, "node").join(below, "node").join(tips, "node", "left").join(children, "node", "left")
    return joined.select("node", "depth", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("leaves", F.lit(0)).alias("leaves"), "below")


def subtree(ancestors: DataFrame, roots: DataFrame, depth: int | None = None, leaves_only: bool = False) -> DataFrame:
    """root, node and dist of the nodes at or below each root (node), down to ``depth`` levels; with
    ``leaves_only`` those below which there are none."""
    found = ancestors.join(roots.select(F.col("node").alias("ancestor")).distinct(), "ancestor")
    if depth is not None:
        found = found.where(F.col("dist") <= depth)
    if leaves_only:
        inner = ancestors.where("dist > 0").select(F.col("ancestor").alias("node")).distinct()
        found = found.join(inner, "node", "left_anti")
    return found.select(F.col("ancestor").alias("root"), "node", "dist")


def items_below(links: DataFrame, ancestors: DataFrame, roots: DataFrame, item: str) -> DataFrame:
    """Distinct items that are linked (node, item) to a root or a node below it."""
    return links.join(subtree(ancestors, roots).select("node").distinct(), "node", "left_semi").select(item).distinct()


def clustered_table(pool: DataFrame, seq: str, samples: list[str], clusters: DataFrame) -> DataFrame:
    """Rows of a pool table by cluster (id: a sequence, seed): the samples' counts added up under the seed.
    Sequences in no cluster are their own."""
    joined = pool.join(clusters.select(F.col("id").alias("__sl_id"), F.col("seed").alias("__sl_seed")), F.col(seq) == F.col("__sl_id"), "left")
    return joined.groupBy(F.coalesce("__sl_seed", seq).alias(seq)).agg(*(F.sum(s).alias(s) for s in samples), F.count("*").alias("members"))
