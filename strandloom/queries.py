"""Queries of the engine's operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.sequence import gc_fraction, kmers, reverse_complement
from .operators import hierarchy, matrix, records, similarity
from .plans import matching as _matching  # noqa: F401  registers its queries
from .plans import queries as _plans  # noqa: F401  registers its queries
from .plans import reads as _reads  # noqa: F401  registers its queries
from .plans import steps as _steps  # noqa: F401  registers its queries
from .registry import QUERIES, SQL, query, table  # noqa: F401


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS seq_count FROM documents WHERE text IS NOT NULL GROUP BY text")
def seq_dereplicate(spark, d):
    return records.dereplicate(table(spark, d, "documents"), "text", "doc_id")


@query("SELECT doc_id, lang, length(text) AS n FROM documents WHERE length(text) BETWEEN 200 AND 2000")
def seq_filter_length(spark, d):
    return records.filter_length(table(spark, d, "documents"), "text", 200, 2000).select("doc_id", "lang", F.length("text").cast("long").alias("n"))


@query(r"""WITH m AS (SELECT doc_id, text, length(regexp_extract(text, '^(.*(?:reserved\.|the ))', 1, 's')) AS upto FROM documents)
 SELECT doc_id, CASE WHEN upto BETWEEN 1 AND 4000 THEN substr(text, upto + 1) ELSE text END AS text FROM m""")
def seq_clip_start(spark, d):
    return records.clip_start(table(spark, d, "documents"), "text", r"reserved\.|the ", 4000).select("doc_id", "text")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def seq_filter_ids(spark, d):
    return records.filter_ids(table(spark, d, "documents"), table(spark, d, "labels").where("toxic = 1"), "doc_id").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def seq_drop_ids(spark, d):
    return records.filter_ids(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", keep=False).select("doc_id", "source")


@query("""SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'first' WHEN '2' THEN CASE WHEN starts_with(o_orderpriority, '2-H') THEN 'high' ELSE 'second' END
 WHEN '5' THEN 'last' END AS sample FROM orders""")
def seq_demultiplex(spark, d):
    tags = spark.createDataFrame([("1", "first"), ("2", "second"), ("2-H", "high"), ("5", "last")], "tag string, sample string")
    return records.demultiplex(table(spark, d, "orders"), "o_orderpriority", tags).select("o_orderkey", "sample")


@query("""SELECT a.conv_id, a.turn, a.text AS forward, b.text AS reverse FROM conversations a JOIN conversations b
 ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn WHERE a.role = 'user' AND b.role = 'assistant'""")
def seq_join_mates(spark, d):
    c = table(spark, d, "conversations")
    right = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reverse"))
    return records.join_mates(c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("forward")), right, ["conv_id", "turn"])


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('1:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
 SELECT doc_id, source FROM r WHERE k <= 20 AND n >= 20""")
def seq_rarefy(spark, d):
    return records.rarefy(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 20)


@query("""SELECT doc_id, reverse(translate(text, 'ACGTURYKMBVDHacgturykmbvdh', 'TGCAAYRMKVBHDtgcaayrmkvbhd')) AS seq,
 round(length(regexp_replace(text, '[^GCgc]', '', 'g')) / nullif(length(regexp_replace(text, '[^ACGTUacgtu]', '', 'g')), 0), 6) AS gc FROM documents""")
def seq_complement(spark, d):
    return table(spark, d, "documents").select("doc_id", reverse_complement(F.col("text")).alias("seq"), F.round(gc_fraction(F.col("text")), 6).alias("gc"))


@query("""SELECT item_id, count(DISTINCT substr(text, i::INTEGER, 8))::INTEGER AS n FROM benchmark, unnest(range(1, length(text) - 6)) AS t(i) GROUP BY item_id""")
def kmer_counts(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(kmers(F.col("text"), 8)).alias("n")).where("n > 0")


@query("""WITH q AS (SELECT DISTINCT conv_id * 1000 + turn AS qid, substr(lower(text), i::INTEGER, 8) AS k FROM conversations, unnest(range(1, length(text) - 6)) AS t(i)),
 r AS (SELECT DISTINCT item_id AS rid, substr(lower(text), i::INTEGER, 8) AS k FROM benchmark, unnest(range(1, length(text) - 6)) AS t(i)),
 nq AS (SELECT qid, count(*) AS nq FROM q GROUP BY qid), nr AS (SELECT rid, count(*) AS nr FROM r GROUP BY rid),
 s AS (SELECT qid, rid, count(*) AS shared FROM q JOIN r USING (k) GROUP BY qid, rid),
 p AS (SELECT qid, rid, shared, round(100.0::DOUBLE * shared / least(nq, nr), 5) AS pct FROM s JOIN nq USING (qid) JOIN nr USING (rid)),
 b AS (SELECT *, max(pct) OVER (PARTITION BY qid) AS best FROM p WHERE pct >= 2)
 SELECT qid, rid, shared, pct FROM b WHERE pct >= best - 1""")
def kmer_similarities(spark, d):
    q = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lower("text").alias("seq"))
    r = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lower("text").alias("seq"))
    return similarity.similarities(q, r, least=2.0)


@query("""WITH s AS (SELECT user_id, row_number() OVER w AS position, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) OVER w
 + sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) - sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS score
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, position) AS k FROM s)
 SELECT user_id, position::INTEGER AS position, score::BIGINT AS score FROM r WHERE k = 1""")
def chimera_break_points(spark, d):
    e = table(spark, d, "events").withColumn("l", F.when(F.col("event_type").isin("view", "click"), 1).otherwise(0)).withColumn("r", F.when(F.col("event_type") == "purchase", 1).otherwise(0))
    return similarity.break_points(e, "user_id", ["ts", "event_id"], "l", "r")


def tree(spark, d):
    root = spark.createDataFrame([("root", None)], "node string, parent string")
    region = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("root").alias("parent"))
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return root.union(region).union(nation)


@query("""WITH RECURSIVE t AS (SELECT 'root' AS node, NULL AS parent UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
 up AS (SELECT node, node AS ancestor, 0 AS dist FROM t UNION ALL SELECT u.node, t.parent, u.dist + 1 FROM up u JOIN t ON u.ancestor = t.node WHERE t.parent IS NOT NULL)
 SELECT node, ancestor, dist FROM up""")
def tree_closure(spark, d):
    return hierarchy.closure(spark, tree(spark, d))


@query("""WITH s AS (SELECT n_nationkey, n_regionkey, round(o_totalprice * 100)::BIGINT AS score FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
 SELECT 'n' || n_nationkey AS node, sum(score)::BIGINT AS score, count(*) AS n FROM s GROUP BY n_nationkey
 UNION ALL SELECT 'r' || n_regionkey, sum(score)::BIGINT, count(*) FROM s GROUP BY n_regionkey UNION ALL SELECT 'root', sum(score)::BIGINT, count(*) FROM s""")
def profile_rollup(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    scores = o.select(F.concat(F.lit("n"), "c_nationkey").alias("node"), F.round(F.col("o_totalprice") * 100).cast("long").alias("score"))
    return hierarchy.roll_up(scores, hierarchy.closure(spark, tree(spark, d)))


@query("""WITH s AS (SELECT o_orderstatus AS sample, c_nationkey AS node, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
 SELECT sample, node, round(n * 100000.0::DOUBLE / sum(n) OVER (PARTITION BY sample), 6) AS score FROM s""")
def profile_normalised(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = o.groupBy(F.col("o_orderstatus").alias("sample"), F.col("c_nationkey").alias("node")).agg(F.count("*").alias("score"))
    return hierarchy.normalised(p, "sample", "score").select("sample", "node", F.round("score", 6).alias("score"))


@query("""WITH a AS (SELECT c_nationkey AS node, count(*) AS customers FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS node, count(*) AS suppliers FROM supplier GROUP BY 1)
 SELECT node, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers, greatest(coalesce(customers, 0), coalesce(suppliers, 0)) AS row_max FROM a FULL JOIN b USING (node)""")
def profile_merged(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count("*").alias("score"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("node")).agg(F.count("*").alias("score"))
    return hierarchy.merged(a, b, "node", ("customers", "suppliers"))


@query("""WITH h AS (SELECT l_partkey, s_nationkey::VARCHAR AS nation, n_regionkey::VARCHAR AS region FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
 SELECT l_partkey, CASE WHEN min(nation) = max(nation) THEN 'nation' WHEN min(region) = max(region) THEN 'region' ELSE 'root' END AS rank,
 CASE WHEN min(nation) = max(nation) THEN min(nation) WHEN min(region) = max(region) THEN min(region) ELSE 'root' END AS taxon FROM h GROUP BY l_partkey""")
def taxonomy_common_ancestor(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    h = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return hierarchy.common_ancestor(h.select("l_partkey", F.col("s_nationkey").alias("nation"), F.col("n_regionkey").alias("region")), "l_partkey", ["nation", "region"])


@query("""WITH p AS (SELECT p_brand AS brand, l_returnflag || l_linestatus AS cond, sum(round(l_quantity))::BIGINT::DOUBLE AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
 SELECT x.brand AS a, y.brand AS b, round((corr(x.v, y.v) + 1) / 2, 6) AS r, count(*) AS n FROM p x JOIN p y USING (cond) WHERE x.brand < y.brand GROUP BY ALL""")
def expression_correlations(spark, d):
    p = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    m = p.groupBy("p_brand", F.concat("l_returnflag", "l_linestatus").alias("cond")).agg(F.sum(F.round("l_quantity").cast("long")).cast("double").alias("v"))
    return matrix.correlations(m, "p_brand", "cond", "v")


@query("""WITH c AS (SELECT p_size, i::INTEGER AS col, substr(p_brand, i::INTEGER, 1) AS ch, count(*) AS n FROM part, unnest(range(1, length(p_brand) + 1)) AS t(i) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY p_size, col ORDER BY n DESC, ch) AS k, sum(n) OVER (PARTITION BY p_size, col) AS total FROM c)
 SELECT p_size, col, ch, round(n::DOUBLE / total, 6) AS share FROM r WHERE k = 1""")
def alignment_consensus(spark, d):
    return matrix.consensus(table(spark, d, "part").select("p_size", "p_brand"), "p_size", "p_brand")


@query("""WITH i AS (SELECT o_custkey, o_orderkey, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS b, datediff('day', DATE '1970-01-01', o_orderdate::DATE) + 30 AS e FROM orders)
 SELECT x.o_custkey, x.o_orderkey AS a, y.o_orderkey AS b, (least(x.e, y.e) - greatest(x.b, y.b))::INTEGER AS common FROM i x JOIN i y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.b <= y.e AND y.b <= x.e""")
def interval_overlaps(spark, d):
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    return matrix.overlaps(table(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("b"), (day + 30).alias("e")), "o_custkey", "o_orderkey", "b", "e", 30)


@query("""WITH l AS (SELECT lang, length(text) AS n, sum(length(text)) OVER (PARTITION BY lang ORDER BY length(text) DESC RANGE UNBOUNDED PRECEDING) AS run, sum(length(text)) OVER (PARTITION BY lang) AS total FROM documents)
 SELECT lang, max(n)::BIGINT AS n50 FROM l WHERE 2 * run >= total GROUP BY lang""")
def length_n50(spark, d):
    return matrix.n50(table(spark, d, "documents").select("lang", F.length("text").alias("n")), "lang", "n")


@query("""SELECT lang, (length(text) // 500 * 500)::INTEGER AS bin, count(*) AS n FROM documents GROUP BY ALL""")
def length_histogram(spark, d):
    return table(spark, d, "documents").groupBy("lang", (F.floor(F.length("text") / 500) * 500).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("""SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source""")
def table_pivot(spark, d):
    return table(spark, d, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count().na.fill(0)


@query("""SELECT 'both' AS kind, n FROM (SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier)
 UNION ALL SELECT 'customers', n FROM (SELECT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'any', n FROM (SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier)""")
def list_algebra(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("n")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"))
    kinds = (("both", a.intersect(b)), ("customers", a.subtract(b)), ("any", a.union(b).distinct()))
    out = [x.select(F.lit(k).alias("kind"), "n") for k, x in kinds]
    return out[0].union(out[1]).union(out[2])


@query("""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents)
 SELECT doc_id, count(*) AS hits FROM w WHERE word IN ('with', 'from', 'that') GROUP BY doc_id""")
def text_search(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return w.where(F.col("word").isin("with", "from", "that")).groupBy("doc_id").agg(F.count("*").alias("hits"))
