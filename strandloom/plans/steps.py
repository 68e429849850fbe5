"""Queries of mates, positions in alignments, tables by rank, elements of patterns and clusters, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment, hierarchy, intervals, patterns, records, similarity, structure
from ..registry import query, table


@query("""WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND length(text) >= 80), a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND length(text) >= 400)
 SELECT 'user' AS side, conv_id, turn FROM u WHERE conv_id IN (SELECT conv_id FROM a) UNION ALL SELECT 'assistant', conv_id, turn FROM a WHERE conv_id IN (SELECT conv_id FROM u)""")
def seq_filter_mates(spark, d):
    turns = table(spark, d, "conversations")
    sides = {"user": records.filter_length(turns.where("role = 'user'"), "text", 80), "assistant": records.filter_length(turns.where("role = 'assistant'"), "text", 400)}
    kept = records.filter_mates(sides["user"], sides["assistant"], ["conv_id"])
    both = [df.select(F.lit(side).alias("side"), "conv_id", "turn") for side, df in zip(sides, kept, strict=True)]
    return both[0].unionByName(both[1])


@query("""WITH c AS (SELECT item_id, i - 1 AS col, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS pos FROM benchmark, unnest(range(1, length(text) + 1)) AS t(i) WHERE substr(text, i::INT, 1) NOT IN ('-', '~', '.')),
 n AS (SELECT item_id, max(pos) AS last FROM c GROUP BY item_id)
 SELECT b.item_id, coalesce(x.col, -1)::INT AS first_column, coalesce(y.col, -1)::INT AS last_column FROM benchmark b LEFT JOIN n USING (item_id) LEFT JOIN c x ON x.item_id = b.item_id AND x.pos = 40 AND last >= 40 LEFT JOIN c y ON y.item_id = b.item_id AND y.pos = least(199, last) AND last >= 40""")
def alignment_ranges(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", "text", F.lit(40).alias("begin"), F.lit(199).alias("end"))
    return alignment.columns_of_ranges(rows, "text", "begin", "end").select("item_id", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("first_column", "last_column")))


@query("""WITH s AS (SELECT l_returnflag AS sample, l_suppkey AS k, sum(round(l_quantity)::BIGINT)::DOUBLE AS score FROM lineitem GROUP BY ALL),
 n AS (SELECT s.*, 's' || s_suppkey AS sn, 'n' || s_nationkey AS nn, 'r' || n_regionkey AS rn FROM s LEFT JOIN supplier ON s_suppkey = k LEFT JOIN nation ON n_nationkey = s_nationkey),
 t AS (SELECT sample, sum(score) AS total FROM s GROUP BY sample), m AS (SELECT avg(total) AS mean FROM t),
 r AS (SELECT 'supplier' AS rank, sn AS node, sample, score FROM n UNION ALL SELECT 'nation', nn, sample, score FROM n UNION ALL SELECT 'region', rn, sample, score FROM n),
 g AS (SELECT rank, node, sample, sum(score) AS score FROM r GROUP BY ALL), k AS (SELECT rank, node FROM g GROUP BY ALL HAVING sum(score) >= 3000)
 SELECT g.rank, g.node, g.sample, score, round(100000 * score / total, 4) AS normalised, round(score / total * mean, 4) AS scaled FROM g JOIN k ON k.rank = g.rank AND k.node IS NOT DISTINCT FROM g.node JOIN t USING (sample), m""")
def profile_rank_tables(spark, d):
    region = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("region").alias("rank"))
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit("nation"))
    supplier = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.lit("supplier"))
    nodes = region.union(nation).union(supplier)
    profile = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("node"), F.col("l_returnflag").alias("sample"), F.round("l_quantity").cast("long").cast("double").alias("score"))
    found = hierarchy.rank_tables(profile, nodes, hierarchy.closure(spark, nodes), ["supplier", "nation", "region"], least=3000)
    return found.select("rank", "node", "sample", "score", F.round("normalised", 4).alias("normalised"), F.round("scaled", 4).alias("scaled"))


@query("SELECT item_id, regexp_replace(text, '(?is)o[tu].{0,2}?e', '', 'g') AS text FROM benchmark")
def pattern_removed(spark, d):
    return patterns.remove_pattern(table(spark, d, "benchmark"), "text", "OU 0...2 E").select("item_id", "text")


@query("""SELECT item_id, regexp_extract(text, '(?is)(o[tu])(.{1,3}?)(e)', 3) || regexp_extract(text, '(?is)(o[tu])(.{1,3}?)(e)', 2) AS text FROM benchmark WHERE regexp_matches(text, '(?is)o[tu].{1,3}?e')""")
def pattern_extracted(spark, d):
    return patterns.extract_elements(table(spark, d, "benchmark"), "text", "OU 1...3 E", [3, 2]).select("item_id", "text")


@query("""WITH RECURSIVE k AS (SELECT DISTINCT item_id AS id, substr(lower(text), i::INT, 8) AS k FROM benchmark, unnest(range(1, length(text) - 6)) AS t(i)), n AS (SELECT id, count(*) AS n FROM k GROUP BY id),
 p AS (SELECT x.id AS a, y.id AS b FROM k x JOIN k y USING (k) JOIN n nx ON nx.id = x.id JOIN n ny ON ny.id = y.id WHERE x.id <> y.id GROUP BY x.id, y.id, nx.n, ny.n HAVING round(100.0::DOUBLE * count(*) / least(nx.n, ny.n), 5) >= 2),
 o AS (SELECT row_number() OVER (ORDER BY length(text) DESC, item_id) AS r, item_id AS id, coalesce((SELECT list(b) FROM p WHERE a = item_id), []) AS beside FROM benchmark),
 walk AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS seeds, NULL::BIGINT AS id, NULL::BIGINT AS seed
  UNION ALL SELECT o.r, CASE WHEN hit IS NULL THEN list_append(seeds, o.id) ELSE seeds END, o.id, coalesce(hit, o.id) FROM (SELECT w.r, w.seeds, o.r AS next, list_filter(w.seeds, lambda s: list_contains(o.beside, s))[1] AS hit FROM walk w JOIN o ON o.r = w.r + 1) w JOIN o ON o.r = w.next)
 SELECT id, seed FROM walk WHERE r > 0""")
def similarity_clusters(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lower("text").alias("seq"))
    pairs = similarity.similarities(items, items, least=2.0, top_range=100.0, with_self=False).select(F.col("qid").alias("a"), F.col("rid").alias("b"))
    return similarity.greedy_clusters(pairs, items.select("id", F.length("seq").alias("weight")))


@query("""WITH a AS (SELECT p_brand, rpad(regexp_replace(p_name, '[aeiou ]', '-', 'g'), 12, '-') AS s FROM part), m AS (SELECT p_brand, floor(max(length(s)) / 2)::INT AS mid FROM a GROUP BY p_brand),
 c AS (SELECT p_brand, length(regexp_replace(substr(s, 1, mid + 1), '[^A-Za-z]', '', 'g')) AS l, length(regexp_replace(substr(s, mid + 2), '[^A-Za-z]', '', 'g')) AS r FROM a JOIN m USING (p_brand)),
 o AS (SELECT *, CASE WHEN l + r > 0 THEN trunc(100.0::DOUBLE * (l - r) / (l + r)) END AS off FROM c),
 g AS (SELECT p_brand, count(*) FILTER (off >= 70) AS left_only, count(*) FILTER (off <= -70) AS right_only, count(*) AS rows FROM o GROUP BY p_brand)
 SELECT p_brand, left_only, right_only, rows, left_only + right_only >= (rows - 1) * 20 / 100.0 AND least(left_only, right_only) >= (left_only + right_only) * 10 / 100.0 AS chimeric FROM g""")
def alignment_lopsided(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.rpad(F.regexp_replace("p_name", "[aeiou ]", "-"), 12, "-").alias("seq"))
    found = structure.lopsided(rows, "p_brand", "seq", least_rows=20)
    return found.select("p_brand", F.col("left_only").cast("long").alias("left_only"), F.col("right_only").cast("long").alias("right_only"), "rows", "chimeric")


@query("""WITH RECURSIVE m AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS p, l_returnflag = 'R' AS minus, l_orderkey AS q, l_quantity::BIGINT AS n,
   CASE WHEN l_returnflag = 'R' THEN -(100000 - l_orderkey + l_linenumber + l_quantity::BIGINT - 1) ELSE l_orderkey + l_linenumber END AS s
  FROM (SELECT l_orderkey, l_linenumber, f.l_partkey, f.l_returnflag, f.l_quantity FROM (SELECT l_orderkey, l_linenumber, min({'l_partkey': l_partkey, 'l_returnflag': l_returnflag, 'l_quantity': l_quantity}) AS f FROM lineitem GROUP BY 1, 2))),
 w AS (SELECT a.id AS a, b.id AS b, b.q - a.q - a.n AS dq, b.s - a.s - a.n AS ds FROM m a JOIN m b ON a.p = b.p AND a.minus = b.minus WHERE b.q - a.q - a.n BETWEEN 0 AND 2000 AND b.s - a.s - a.n BETWEEN 0 AND 2000 AND abs((b.q - a.q - a.n) - (b.s - a.s - a.n)) <= 8),
 f AS (SELECT a, b FROM w QUALIFY row_number() OVER (PARTITION BY a ORDER BY dq + ds, abs(dq - ds), b) = 1), t AS (SELECT a, b FROM w QUALIFY row_number() OVER (PARTITION BY b ORDER BY dq + ds, abs(dq - ds), a) = 1),
 l AS (SELECT f.a, f.b FROM f JOIN t ON f.a = t.a AND f.b = t.b),
 c AS (SELECT id, id AS chain FROM m WHERE id NOT IN (SELECT b FROM l) UNION ALL SELECT l.b, chain FROM c JOIN l ON l.a = c.id)
 SELECT id, chain FROM c""")
def match_chains_look_back(spark, d):
    q, n = F.col("l_orderkey"), F.col("l_quantity").cast("long")
    minus = F.col("l_returnflag") == "R"
    # One row of each order and line, as ids are unique.
    first = F.min(F.struct("l_partkey", "l_returnflag", "l_quantity")).alias("first")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", "first.*")
    m = lines.select((q * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", F.when(minus, "-").otherwise("+").alias("strand"), q.alias("q"), F.when(minus, 100000 - q + F.col("l_linenumber")).otherwise(q + F.col("l_linenumber")).alias("s"), n.alias("n"))
    return intervals.chains(m, "id", ["l_partkey"], "q", "s", "n", 2000, 8, "strand")
