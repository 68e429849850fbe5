"""Queries of alignment, interval, hierarchy and cleaning operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequence import binomial
from ..operators import alignment, hierarchy, intervals, matrix, records
from ..registry import query, table
from .cleaning import Step, clean_counts


@query("SELECT item_id, regexp_replace(text, '[a-e]', 'N', 'g') AS seq, round(100.0 * length(regexp_replace(text, '[^a-e]', '', 'g')) / length(text), 6)::DOUBLE AS pct FROM benchmark")
def seq_mask_quality(spark, d):
    values = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    masked = records.mask_by_quality(F.col("text"), values, 97, 101).alias("seq")
    return table(spark, d, "benchmark").select("item_id", masked, F.round(records.quality_share(values, 97, 101), 6).alias("pct"))


@query("SELECT doc_id FROM documents WHERE length(regexp_replace(text, '[^AGCTNagctn]', '', 'g')) >= 0.3 * length(text) AND length(text) > 0")
def seq_filter_dna(spark, d):
    return table(spark, d, "documents").where(records.dna_share(F.col("text")) >= 0.3).select("doc_id")


@query("SELECT lang, ch, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch BETWEEN 'a' AND 'z' GROUP BY ALL")
def seq_alphabet(spark, d):
    chars = table(spark, d, "documents").select("lang", F.explode(F.split("text", "")).alias("ch"))
    return chars.where(F.col("ch").between("a", "z")).groupBy("lang", "ch").agg(F.count("*").alias("n"))


@query("SELECT doc_id, substr(text, 1, 10) || substr(text, 31, 5) AS seq FROM documents")
def seq_sub_sequence(spark, d):
    return table(spark, d, "documents").select("doc_id", records.sub_sequence(F.col("text"), [(0, 10), (30, 5)]).alias("seq"))


@query("SELECT doc_id, regexp_replace(text, '[-~.]', '', 'g') AS seq, length(text) - length(regexp_replace(text, '[-~.]', '', 'g')) AS gaps FROM documents")
def alignment_gaps(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", alignment.delete_gaps(text).alias("seq"), alignment.count_gaps(text).cast("long").alias("gaps"))


@query("SELECT p_partkey, lpad(p_name, (SELECT max(length(p_name)) FROM part)::INTEGER, '-') AS p_name FROM part")
def alignment_justify(spark, d):
    return alignment.justify(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", right=True)


@query(
    """WITH s AS (SELECT p_size, translate(md5(p_name || p_partkey), '0123456789abcdef', 'ACGTACGAACGTACAA') AS seq FROM part),
 c AS (SELECT p_size, i::INTEGER AS col, substr(seq, i::INTEGER, 1) AS ch, count(*) AS n FROM s, unnest(range(1, 33)) AS t(i) GROUP BY ALL),
 r AS (SELECT *, sum(n) OVER (PARTITION BY p_size, col ORDER BY n DESC, ch ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY p_size, col) AS total FROM c),
 b AS (SELECT p_size, col, string_agg(ch, '' ORDER BY ch) AS bases FROM r WHERE before < 0.9 * total GROUP BY ALL)
 SELECT p_size, col, code FROM b JOIN (VALUES """
    + ", ".join(f"('{k}', '{v}')" for k, v in alignment.AMBIGUITY.items())
    + ") AS codes(bases, code) USING (bases)"
)
def alignment_ambiguous_consensus(spark, d):
    seq = F.translate(F.md5(F.concat("p_name", "p_partkey").cast("binary")), "0123456789abcdef", "ACGTACGAACGTACAA")
    return alignment.ambiguous_consensus(table(spark, d, "part").select("p_size", seq.alias("seq")), "p_size", "seq")


@query("""WITH m AS (SELECT p_partkey, repeat('<', p_size % 5) || '.<.>' || repeat('>', p_size % 5) AS mask FROM part),
 s AS (SELECT p_partkey, i::INTEGER AS pos, substr(mask, i::INTEGER + 1, 1) AS ch FROM m, unnest(range(0, length(mask))) AS t(i)),
 e AS (SELECT *, sum(CASE ch WHEN '<' THEN 1 ELSE -1 END) OVER (PARTITION BY p_partkey ORDER BY pos ROWS UNBOUNDED PRECEDING) + CASE ch WHEN '<' THEN 0 ELSE 1 END AS depth FROM s WHERE ch <> '.'),
 k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, depth, ch ORDER BY pos) AS k FROM e)
 SELECT p_partkey, depth::BIGINT AS depth, min(pos) AS beg, max(pos) AS "end" FROM k GROUP BY p_partkey, depth, k HAVING count(*) = 2""")
def alignment_mask_pairs(spark, d):
    mask = F.expr("concat(repeat('<', p_size % 5), '.<.>', repeat('>', p_size % 5))").alias("mask")
    return alignment.mask_pairs(table(spark, d, "part").select("p_partkey", mask), "p_partkey", "mask")


@query("""WITH i AS (SELECT o_custkey, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS b FROM orders),
 s AS (SELECT *, CASE WHEN b > lag(b) OVER w + 70 OR lag(b) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM i WINDOW w AS (PARTITION BY o_custkey ORDER BY b)),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY b) AS island FROM s)
 SELECT o_custkey, min(b)::INTEGER AS b, (max(b) + 60)::INTEGER AS e, count(*) AS n FROM g GROUP BY o_custkey, island""")
def intervals_condensed(spark, d):
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    return intervals.condense(table(spark, d, "orders").select("o_custkey", day.alias("b"), (day + 60).alias("e")), "o_custkey", "b", "e", gap=10)


@query("""WITH v AS (SELECT user_id, epoch_us(ts) AS at, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL),
 p AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'purchase')
 SELECT p.event_id, coalesce(v.at, -1) AS found_at, coalesce(v.view_id, -1) AS found FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.at >= v.at""")
def intervals_as_of(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    views = e.where("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("view_id"))
    return intervals.as_of(e.where("event_type = 'purchase'"), views, "event_id", "user_id", "at", "view_id", 86_400_000_000).na.fill(-1)


@query("""WITH p AS (SELECT DISTINCT string_split(p_type || ' ' || p_name, ' ') AS p FROM part)
 SELECT DISTINCT array_to_string(p[:i::INTEGER], ' ') AS node, CASE WHEN i > 1 THEN array_to_string(p[:i::INTEGER - 1], ' ') END AS parent, p[i] AS name FROM p, unnest(range(1, len(p) + 1)) AS t(i)""")
def taxonomy_nodes(spark, d):
    paths = table(spark, d, "part").select(F.concat_ws(" ", "p_type", "p_name").alias("path"))
    return hierarchy.nodes_from_paths(paths, "path", " ")


def _place(spark, d):
    region = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    return region.union(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))


@query("""WITH k AS (SELECT n_nationkey, n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL HAVING max(c_acctbal) >= 9900)
 SELECT 'n' || n_nationkey AS node FROM k UNION SELECT 'r' || n_regionkey FROM k""")
def taxonomy_filtered(spark, d):
    best = table(spark, d, "customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("best")).where("best >= 9900")
    return hierarchy.with_ancestors(best.select(F.concat(F.lit("n"), "c_nationkey").alias("node")), hierarchy.closure(spark, _place(spark, d)))


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_discount * 100 AS pct FROM lineitem), w AS (SELECT *, 1 / pow(1 + max(pct) OVER (PARTITION BY l_orderkey) - pct, 2) AS w FROM h)
 SELECT l_orderkey, l_linenumber, round(w / sum(w) OVER (PARTITION BY l_orderkey), 6) AS weight FROM w""")
def taxonomy_hit_weights(spark, d):
    hits = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 100).alias("pct"))
    return hierarchy.hit_weights(hits, "l_orderkey", "pct", 2.0).select("l_orderkey", "l_linenumber", F.round("weight", 6).alias("weight"))


@query("""WITH s AS (SELECT l_returnflag AS sample, l_shipdate::DATE::VARCHAR AS day, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT sample, sum(n) AS total FROM s GROUP BY sample)
 SELECT sample, day, round(n * (SELECT avg(total) FROM t) / total, 6)::DOUBLE AS score FROM s JOIN t USING (sample)""")
def profile_scaled(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("sample"), F.to_date("l_shipdate").cast("string").alias("day")).agg(F.count("*").alias("score"))
    return hierarchy.scaled_to_mean(p, "sample", "score").select("sample", "day", F.round("score", 6).alias("score"))


@query("""WITH a AS (SELECT DISTINCT n_nationkey, n_regionkey, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
 SELECT 'n' || n_nationkey AS node, count(*) AS total, count(DISTINCT l_partkey) AS "unique" FROM a GROUP BY n_nationkey
 UNION ALL SELECT 'r' || n_regionkey, count(*), count(DISTINCT l_partkey) FROM a GROUP BY n_regionkey""")
def ontology_counts(spark, d):
    sold = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    leaves = sold.select(F.concat(F.lit("n"), "s_nationkey").alias("node"), "l_partkey")
    return hierarchy.subtree_counts(leaves, hierarchy.closure(spark, _place(spark, d)), "l_partkey")


@query("""WITH s AS (SELECT p_brand AS seq, substr(md5(p_name || p_partkey), 1, length(p_brand)) AS qual FROM part),
 m AS (SELECT seq, i, max(substr(qual, i::INTEGER, 1)) AS q FROM s, unnest(range(1, length(seq) + 1)) AS t(i) GROUP BY ALL), c AS (SELECT seq, count(*) AS seq_count FROM s GROUP BY seq)
 SELECT seq, seq_count, string_agg(q, '' ORDER BY i) AS qual FROM m JOIN c USING (seq) GROUP BY seq, seq_count""")
def seq_dereplicate_qualities(spark, d):
    qual = F.substring(F.md5(F.concat("p_name", "p_partkey").cast("binary")), F.lit(1), F.length("p_brand"))
    return records.dereplicate_qualities(table(spark, d, "part").select(F.col("p_brand").alias("seq"), qual.alias("qual")), "seq", "qual")


@query("""WITH n AS (SELECT p_partkey, p_name AS s FROM part), k AS (SELECT p_partkey, s, i FROM n, unnest(range(3, 9)) AS t(i)
 WHERE length(s) >= i AND hamming(right('xxxlarge', i::INTEGER), left(s, i::INTEGER)) <= floor(0.25 * i))
 SELECT p_partkey, coalesce(max(i), 0)::INTEGER AS n FROM n LEFT JOIN k USING (p_partkey) GROUP BY p_partkey""")
def seq_probe_overlap(spark, d):
    return table(spark, d, "part").select("p_partkey", records.probe_overlap(F.col("p_name"), "xxxlarge", 3, 0.75).alias("n"))


@query("""WITH m AS (SELECT item_id, left(text, 6 * length(text) // 10) AS f, right(text, 6 * length(text) // 10) AS r FROM benchmark),
 k AS (SELECT item_id, max(n) AS n FROM m, unnest(range(15, length(f) + 1)) AS t(n) WHERE right(f, n::INTEGER) = left(r, n::INTEGER) GROUP BY item_id)
 SELECT item_id, coalesce(n, 0)::INTEGER AS overlap, f || substr(r, coalesce(n, 0)::INTEGER + 1) AS merged FROM m LEFT JOIN k USING (item_id)""")
def seq_merge_mates(spark, d):
    n = F.expr("6 * length(text) div 10").cast("int")
    mates = table(spark, d, "benchmark").select("item_id", F.left("text", n).alias("f"), F.right("text", n).alias("r"))
    return records.merge_mates(mates, "f", "r", 15, 1.0).select("item_id", "overlap", "merged")


@query("SELECT right(p_name, 4) AS ending, count(*) AS n FROM part WHERE length(p_name) >= 4 GROUP BY ALL ORDER BY n DESC, ending LIMIT 5")
def seq_frequent_ends(spark, d):
    return records.frequent_ends(table(spark, d, "part"), "p_name", 4, 5)


@query("""SELECT l_partkey, l_suppkey, l_quantity, l_orderkey FROM lineitem
 QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_quantity DESC, l_orderkey) = 1""")
def similarity_best_per_annotation(spark, d):
    return records.best_per_key(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_quantity", "l_orderkey")


@query("""WITH c AS (SELECT l_partkey AS seq, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL),
 t AS (SELECT sum(a) AS ta, sum(n) AS tn, sum(r) AS tr FROM c)
 SELECT seq, round(a * ((ta + tn + tr) / 3) / ta, 6)::DOUBLE AS "A", round(n * ((ta + tn + tr) / 3) / tn, 6)::DOUBLE AS "N", round(r * ((ta + tn + tr) / 3) / tr, 6)::DOUBLE AS "R" FROM c, t WHERE a + n + r >= 20""")
def consensus_pool_table(spark, d):
    reads = table(spark, d, "lineitem").select(F.col("l_partkey").alias("seq"), "l_returnflag")
    return records.pool_table(reads, "seq", "l_returnflag", ["A", "N", "R"], 20).select("seq", *(F.round(c, 6).alias(c) for c in "ANR"))


@query("""WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS k FROM events GROUP BY user_id)
 SELECT user_id, n, k, round(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.4) + (n - k) * ln(0.6)), 6) AS p FROM u""")
def binomial_probability(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("k"))
    return u.withColumn("p", F.round(binomial(F.col("n"), F.col("k"), 0.4), 6))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL)
 SELECT doc_id, word, round(1000.0 * n / sum(n) OVER (PARTITION BY doc_id), 4)::DOUBLE AS per_1000 FROM c""")
def text_word_frequencies(spark, d):
    return matrix.word_frequencies(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT source, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines, sum(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')))::BIGINT AS words, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source")
def text_sizes(spark, d):
    lines, words = F.size(F.split("text", "\n", -1)), F.size(F.regexp_extract_all("text", F.lit(r"([^ \t\n\r]+)")))
    return table(spark, d, "documents").groupBy("source").agg(F.sum(lines).alias("lines"), F.sum(words).alias("words"), F.sum(F.octet_length("text")).alias("bytes"))


@query("""WITH p AS (SELECT c_mktsegment AS a, c_nationkey AS cond, count(*)::DOUBLE AS v FROM customer GROUP BY ALL)
 SELECT x.a, y.a AS b, round(avg(abs(x.v - y.v) / ((x.v + y.v) / 2)), 6) AS dif FROM p x JOIN p y USING (cond) WHERE x.a < y.a GROUP BY ALL""")
def expression_differences(spark, d):
    p = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").cast("double").alias("v"))
    return matrix.differences(p, "c_mktsegment", "c_nationkey", "v")


@query("""WITH s AS (SELECT doc_id, text AS t0, lower(text) AS t1, regexp_replace(lower(text), '[^a-z]+$', '') AS t2 FROM documents)
 SELECT 0 AS step, 'input' AS name, count(*) AS records, sum(length(t0))::BIGINT AS chars FROM s
 UNION ALL SELECT 1, 'lower-case', count(*), sum(length(t1))::BIGINT FROM s UNION ALL SELECT 2, 'clip-end', count(*), sum(length(t2))::BIGINT FROM s
 UNION ALL SELECT 3, 'length', count(*), sum(length(t2))::BIGINT FROM s WHERE length(t2) >= 300""")
def seq_clean_counts(spark, d):
    steps = [Step("lower-case", F.lower), Step("clip-end", lambda s: F.regexp_replace(s, "[^a-z]+$", "")), Step("length", keep=lambda s: F.length(s) >= 300)]
    return clean_counts(table(spark, d, "documents"), "text", steps)


@query("""WITH a AS (SELECT o_orderstatus AS status, sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS p1, sum(CASE WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 0 END) AS p2 FROM orders GROUP BY ALL)
 SELECT 'p1' AS col, sum(p1) FILTER (status = 'F')::BIGINT AS "F", sum(p1) FILTER (status = 'O')::BIGINT AS "O", sum(p1) FILTER (status = 'P')::BIGINT AS "P" FROM a
 UNION ALL SELECT 'p2', sum(p2) FILTER (status = 'F')::BIGINT, sum(p2) FILTER (status = 'O')::BIGINT, sum(p2) FILTER (status = 'P')::BIGINT FROM a""")
def table_transpose(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_orderpriority").like("1%")).alias("p1"), F.count_if(F.col("o_orderpriority").like("2%")).alias("p2"))
    return matrix.transposed(o, "o_orderstatus", ["p1", "p2"], ["F", "O", "P"])
