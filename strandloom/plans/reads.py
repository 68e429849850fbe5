"""Queries of read, pattern, chimera and taxonomy operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence
from ..operators import alignment, chimera, expression, hierarchy, intervals, patterns, records, similarity, structure
from ..registry import query, table


def _turns(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lower("text").alias("seq"))


def _items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lower("text").alias("seq"))


@query("""WITH reads AS (SELECT conv_id * 1000 + turn AS id, lower(text) AS s FROM conversations WHERE length(text) >= 16),
 w AS MATERIALIZED (SELECT id, ((i - 1) // 4)::BIGINT AS i, substr(s, i::INTEGER, 16) AS k FROM reads, unnest(range(1, length(s) - 14, 4)) AS t(i)),
 n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
 r AS (SELECT DISTINCT item_id AS ref, substr(lower(text), i::INTEGER, 16) AS k FROM benchmark, unnest(range(1, length(text) - 14)) AS t(i)),
 h AS MATERIALIZED (SELECT w.id, w.i, r.ref FROM w JOIN r USING (k)),
 c AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY id, ref ORDER BY i) AS l, count(*) OVER (PARTITION BY id, ref ORDER BY i DESC) AS r FROM h),
 lm AS MATERIALIZED (SELECT id, i, max(l) AS l, min(ref) FILTER (l = m) AS ref FROM (SELECT *, max(l) OVER (PARTITION BY id, i) AS m FROM c) GROUP BY ALL),
 rm AS MATERIALIZED (SELECT id, i, max(r) AS r, min(ref) FILTER (r = m) AS ref FROM (SELECT *, max(r) OVER (PARTITION BY id, i) AS m FROM c) GROUP BY ALL),
 p AS MATERIALIZED (SELECT w.id, w.i, n.n, i + 1 - coalesce(max(l) OVER (PARTITION BY w.id ORDER BY i), 0) AS lt, n.n - i - coalesce(max(r) OVER (PARTITION BY w.id ORDER BY i DESC), 0) AS rt
  FROM w JOIN n USING (id) LEFT JOIN lm USING (id, i) LEFT JOIN rm USING (id, i)),
 j AS MATERIALIZED (SELECT id, any_value(n) AS n, (min(i) + max(i)) // 2 AS j FROM (SELECT *, min(lt + rt) OVER (PARTITION BY id) AS m FROM p) WHERE lt + rt = m GROUP BY id),
 a AS MATERIALIZED (SELECT p.*, j.j, pj.lt AS jl, pj.rt AS jr FROM p JOIN j USING (id) JOIN p pj ON pj.id = p.id AND pj.i = j.j),
 e AS MATERIALIZED (SELECT id, j, coalesce(max({'s': lt + rt, 'i': i}) FILTER (i < j AND lt + rt > jr).i, j) AS b, coalesce(-(max({'s': lt + rt, 'i': -i}) FILTER (i > j AND lt + rt > jl).i), j) AS e FROM a GROUP BY id, j),
 v AS MATERIALIZED (SELECT e.*, j.n, x.lt AS lb, x.rt AS rb, y.lt AS le, y.rt AS re, g.rt AS rg, f.lt AS lg FROM e JOIN j USING (id)
  JOIN p x ON x.id = e.id AND x.i = b JOIN p y ON y.id = e.id AND y.i = e.e JOIN p g ON g.id = e.id AND g.i = e.j + (e.e - e.j) // 4 JOIN p f ON f.id = e.id AND f.i = e.j - (e.j - b) // 4),
 o AS (SELECT *, re + (rb - re) * (e - j) // (e - b + 1) AS lx, lb + (le - lb) * (j - b) // (e - b + 1) AS rx FROM v)
 SELECT id AS read, (j * 4 + 8)::BIGINT AS "position",
  CASE WHEN 10 > j + 1 OR 10 > n - j THEN 0 ELSE floor(4 * (CASE rg WHEN 0 THEN lx ELSE lx / rg END) * (CASE lg WHEN 0 THEN rx ELSE rx / lg END) / 2) END::BIGINT AS score FROM o""")
def chimera_scores(spark, d):
    return chimera.chimera_scores(_turns(spark, d), _items(spark, d), k=16, step=4, least_parent=40).select("read", "position", "score")


@query("""WITH q AS (SELECT DISTINCT conv_id * 1000 + turn AS qid, strand, substr(s, i::INTEGER, 8) AS k FROM (SELECT conv_id, turn, '+' AS strand, lower(text) AS s FROM conversations
  UNION ALL SELECT conv_id, turn, '-', reverse(translate(lower(text), 'acgturykmbvdh', 'tgcaayrmkvbhd')) FROM conversations), unnest(range(1, length(s) - 6)) AS t(i)),
 r AS (SELECT DISTINCT item_id AS rid, substr(lower(text), i::INTEGER, 8) AS k FROM benchmark, unnest(range(1, length(text) - 6)) AS t(i)),
 nq AS (SELECT qid, strand, count(*) AS nq FROM q GROUP BY ALL), nr AS (SELECT rid, count(*) AS nr FROM r GROUP BY rid),
 s AS (SELECT qid, strand, rid, count(*) AS shared FROM q JOIN r USING (k) GROUP BY ALL),
 p AS (SELECT qid, strand, rid, shared, round(100.0::DOUBLE * shared / least(nq, nr), 5) AS pct FROM s JOIN nq USING (qid, strand) JOIN nr USING (rid) QUALIFY row_number() OVER (PARTITION BY qid, rid ORDER BY pct DESC, shared DESC, strand) = 1),
 b AS (SELECT *, max(pct) OVER (PARTITION BY qid) AS best FROM p WHERE pct >= 1)
 SELECT qid, rid, strand, shared, pct FROM b WHERE pct >= best - 1""")
def kmer_similarities_both_strands(spark, d):
    return similarity.similarities(_turns(spark, d), _items(spark, d), least=1.0, strands="+-")


@query("""SELECT doc_id, translate(translate(text, 'Tt', 'Uu'), 'Uu', 'Tt') = translate(text, 'Uu', 'Tt') AS turned, length(regexp_replace(text, '[^AGCTNagctn]', '', 'g')) AS dna, length(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYBZXacdefghiklmnpqrstvwybzx]', '', 'g')) AS prot,
 CASE WHEN length(text) > 0 AND length(regexp_replace(text, '[^AGCTNagctn]', '', 'g')) >= 0.7 * length(text) THEN 'dna' WHEN length(text) > 0 AND length(regexp_replace(text, '[^AGCUNagcun]', '', 'g')) >= 0.7 * length(text) THEN 'rna'
 WHEN length(text) > 0 AND length(regexp_replace(text, '[^AGCTUNRYSWKMBDHVagctunryswkmbdhv]', '', 'g')) >= 0.7 * length(text) THEN 'nuc' WHEN length(text) > 0 AND length(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYBZXacdefghiklmnpqrstvwybzx]', '', 'g')) >= 0.7 * length(text) THEN 'prot' END AS kind FROM documents""")
def seq_valid_characters(spark, d):
    t = F.col("text")
    turned = sequence.to_dna(sequence.to_rna(t)) == sequence.to_dna(t)
    return table(spark, d, "documents").select("doc_id", turned.alias("turned"), sequence.count_valid(t, "dna").cast("long").alias("dna"), sequence.count_valid(t, "prot").cast("long").alias("prot"), sequence.guess_type(t, 0.7).alias("kind"))


@query("""SELECT doc_id FROM documents WHERE length(regexp_replace(text, '[^GCgc]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[^ACGTUacgtu]', '', 'g')), 0) BETWEEN 0.1 AND 0.25""")
def seq_filter_gc(spark, d):
    return table(spark, d, "documents").where(sequence.gc_share_within(F.col("text"), 0.1, 0.25)).select("doc_id")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].*e$') AND length(p_brand) BETWEEN 8 AND 8")
def seq_filter_id_pattern(spark, d):
    return records.filter_id_length(records.filter_id_pattern(table(spark, d, "part"), "p_name", "^[a-m].*e$"), "p_brand", 8, 8).select("p_partkey")


@query("SELECT event_id FROM events WHERE NOT regexp_matches(coalesce(props, ''), '\"k\": [1-4]')")
def seq_filter_info_pattern(spark, d):
    return records.filter_info_pattern(table(spark, d, "events"), "props", '"k": [1-4]', keep=False).select("event_id")


@query("""WITH c AS (SELECT p_partkey, p_name AS s, i, ascii(substr(p_name, i::INTEGER, 1)) >= 105 AS ok FROM part, unnest(range(1, length(p_name) + 1)) AS t(i)),
 w AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS good FROM c),
 f AS (SELECT p_partkey, min(i) FILTER (good >= 4 AND i + 4 <= length(s)) AS first FROM w GROUP BY p_partkey),
 g AS (SELECT p_partkey, min(i) AS cut FROM w JOIN f USING (p_partkey) WHERE i >= first AND ok GROUP BY p_partkey)
 SELECT p_partkey, CASE WHEN cut IS NULL THEN '' ELSE substr(p_name, cut::INTEGER) END AS seq FROM part LEFT JOIN g USING (p_partkey)""")
def seq_trim_quality_start(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("seq"), F.transform(F.split("p_name", ""), lambda c: F.ascii(c)).alias("values"))
    return records.trim_quality_start(rows, "seq", "values", 5, 4, 105).select("p_partkey", "seq")


@query("""WITH c AS (SELECT p_partkey, p_name AS s, i, ascii(substr(p_name, i::INTEGER, 1)) >= 105 AS ok FROM part, unnest(range(1, length(p_name) + 1)) AS t(i)),
 w AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS good FROM c),
 f AS (SELECT p_partkey, max(i) FILTER (good >= 4 AND i >= 5) AS last FROM w GROUP BY p_partkey),
 g AS (SELECT p_partkey, max(i) AS cut FROM w JOIN f USING (p_partkey) WHERE i <= last AND ok GROUP BY p_partkey)
 SELECT p_partkey, substr(p_name, 1, coalesce(cut, 0)::INTEGER) AS seq FROM part LEFT JOIN g USING (p_partkey)""")
def seq_trim_quality_end(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("seq"), F.transform(F.split("p_name", ""), lambda c: F.ascii(c)).alias("values"))
    return records.trim_quality_end(rows, "seq", "values", 5, 4, 105).select("p_partkey", "seq")


@query(r"""WITH m AS (SELECT doc_id, text, length(regexp_extract(text, '^(.*?)(?:\. [A-Z])', 1, 's')) AS before, regexp_matches(text, '\. [A-Z]') AS has FROM documents)
 SELECT doc_id, CASE WHEN has AND length(text) - before <= 1500 THEN substr(text, 1, before) ELSE text END AS text FROM m""")
def seq_clip_end(spark, d):
    return records.clip_end(table(spark, d, "documents"), "text", r"\. [A-Z]", 1500).select("doc_id", "text")


_R, _C, _T, _A, _Y = "[AGRagr]", "[Cc]", "[TUtu]", "[Aa]", "[CTUYctuy]"
_ONE_OFF = "|".join("".join("." if i == k else c for i, c in enumerate((_R, _C, _T, _A, _Y))) for k in range(5))


@query(f"""SELECT doc_id, length(regexp_extract(text, '^(.*?)(?:{_ONE_OFF})', 1, 's'))::INTEGER AS begin_at FROM documents WHERE regexp_matches(text, '{_ONE_OFF}', 's')""")
def pattern_first_match(spark, d):
    found = table(spark, d, "documents").select("doc_id", patterns.find_pattern(F.col("text"), "RCTAY[1,0,0]", 1).alias("m"))
    return found.where(F.size("m") > 0).select("doc_id", F.get(F.get("m", 0), 0)["at"].alias("begin_at"))


@query(r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[AGR]C[TU][ACGTUN].{1,3}[CTUY]', 'is')")
def pattern_filter(spark, d):
    return records.filter_id_pattern(table(spark, d, "documents"), "text", patterns.as_regex("RCTN 1...3 Y"), keep=False).select("doc_id")


@query("""WITH b(tag, sample) AS (VALUES ('of ', 's1'), ('in ', 's2'), ('n ', 's3'), ('to ', 's4'), ('to ', 's9')), t AS (SELECT tag, min(sample) AS sample FROM b GROUP BY tag),
 r AS (SELECT doc_id, text, instr(text, 'the') - 1 AS p FROM documents WHERE instr(text, 'the') > 0),
 c AS (SELECT r.*, tag, sample, gap FROM r, unnest(range(0, 3)) AS g(gap), t WHERE p - length(tag) - gap >= 0 AND substr(text, (p - length(tag) - gap + 1)::INTEGER, length(tag)) = tag),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gap, length(tag) DESC) AS k FROM c)
 SELECT doc_id, CASE WHEN r.p >= 2 THEN sample END AS sample, CASE WHEN r.p < 2 THEN 'no-room' WHEN tag IS NULL THEN 'no-barcode' ELSE tag END AS outcome FROM r LEFT JOIN (SELECT * FROM k WHERE k = 1) USING (doc_id)""")
def seq_match_barcodes(spark, d):
    tags = spark.createDataFrame([("of ", "s1"), ("in ", "s2"), ("n ", "s3"), ("to ", "s4"), ("to ", "s9")], "tag string, sample string")
    reads = table(spark, d, "documents").where(F.instr("text", "the") > 0).withColumn("primer", F.instr("text", "the") - 1)
    return records.match_barcodes(reads, "text", "primer", tags, most_gap=2).select("doc_id", "sample", "outcome")


@query("""WITH h AS (SELECT DISTINCT l_orderkey AS read, s_suppkey AS s, s_nationkey AS n, n_regionkey AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
 t AS (SELECT read, count(*) AS tips, count(DISTINCT n) AS ns, count(DISTINCT r) AS rs FROM h GROUP BY read),
 pn AS (SELECT read, n, any_value(r) AS r, count(*) AS c FROM h GROUP BY read, n),
 tops AS (SELECT *, CASE WHEN tips = 1 THEN 3 WHEN ns = 1 THEN 2 WHEN rs = 1 THEN 1 ELSE 0 END AS top FROM t),
 sco AS (SELECT h.read, CASE WHEN c > 1 THEN 'n' || h.n ELSE 's' || h.s END AS node, CASE WHEN c > 1 THEN 2 ELSE 3 END AS depth FROM h JOIN pn USING (read, n)),
 sp AS (SELECT read, max(depth) - any_value(top) AS span FROM sco JOIN tops USING (read) GROUP BY read)
 SELECT read, CASE WHEN span <= 1 THEN node END AS node, round(count(*) * 10.0 / any_value(tips), 6)::DOUBLE AS score FROM sco JOIN sp USING (read) JOIN t USING (read) GROUP BY 1, 2""")
def taxonomy_scores(spark, d):
    root = spark.createDataFrame([("root", None, 0)], "node string, parent string, depth int")
    region = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("root"), F.lit(1))
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit(2))
    supplier = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.lit(3))
    nodes = root.union(region).union(nation).union(supplier)
    hits = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    hits = hits.select(F.col("l_orderkey").alias("read"), F.concat(F.lit("s"), "s_suppkey").alias("node"), F.lit(10).alias("reads"))
    return hierarchy.score_hits(hits, nodes, hierarchy.closure(spark, nodes)).select("read", "node", F.round("score", 6).alias("score"))


@query("""WITH m AS (SELECT l_partkey, l_orderkey AS q, l_orderkey + l_linenumber AS s, l_quantity::BIGINT AS n FROM lineitem),
 b AS (SELECT *, lag(q) OVER w AS pq, lag(s) OVER w AS ps, lag(n) OVER w AS pn FROM m WINDOW w AS (PARTITION BY l_partkey ORDER BY q, s, n)),
 c AS (SELECT *, sum(CASE WHEN q > pq AND s > ps AND q - pq - pn <= 200 AND s - ps - pn <= 200 AND abs((q - pq) - (s - ps)) <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY l_partkey ORDER BY q, s, n ROWS UNBOUNDED PRECEDING) AS chain FROM b)
 SELECT l_partkey, chain::BIGINT AS chain, min(q) AS q_begin, max(q + n - 1) AS q_end, min(s) AS s_begin, max(s + n - 1) AS s_end, count(*) AS matches, sum(n)::BIGINT AS matched FROM c GROUP BY l_partkey, chain""")
def match_chains(spark, d):
    m = table(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("q"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("s"), F.col("l_quantity").cast("long").alias("n"))
    return intervals.chain_table(intervals.chained(m, ["l_partkey"], "q", "s", "n", 200, 3), ["l_partkey"], "q", "s", "n")


@query("""WITH c AS (SELECT item_id, i - 1 AS col, substr(text, i::INTEGER, 1) AS ch FROM benchmark, unnest(range(1, length(text) + 1)) AS t(i))
 SELECT item_id, col::INTEGER AS "column", (row_number() OVER (PARTITION BY item_id ORDER BY col) - 1)::INTEGER AS "position" FROM c WHERE ch NOT IN ('-', '~', '.')""")
def alignment_positions(spark, d):
    return alignment.to_sequence_positions(table(spark, d, "benchmark"), "item_id", "text")


@query("""WITH c AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, count(*) OVER (PARTITION BY c_nationkey) AS m FROM customer)
 SELECT c_custkey, c_nationkey FROM c JOIN unnest(range(0, 4)) AS t(i) ON place = i * m // 4 WHERE m >= 4""")
def seq_even_sample(spark, d):
    return records.even_sample(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", ["c_custkey"], 4)


@query("SELECT o_orderkey, round(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS ratio FROM orders")
def similarity_share_of_best(spark, d):
    return similarity.share_of_best(table(spark, d, "orders"), "o_custkey", "o_totalprice").select("o_orderkey", F.round("ratio", 6).alias("ratio"))


@query("""WITH v AS (SELECT user_id, epoch_us(ts) AS at, min(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL),
 p AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'purchase')
 SELECT p.event_id, coalesce(v.at, -1) AS found_at, coalesce(v.view_id, -1) AS found FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.at <= v.at""")
def intervals_next(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    views = e.where("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("view_id"))
    return intervals.as_of_next(e.where("event_type = 'purchase'"), views, "event_id", "user_id", "at", "view_id", 86_400_000_000).na.fill(-1)


@query("""WITH c AS (SELECT c_nationkey AS node, count(*) FILTER (c_mktsegment = 'BUILDING') AS b, count(*) FILTER (c_mktsegment = 'MACHINERY') AS m FROM customer GROUP BY 1) SELECT node, b, m FROM c WHERE greatest(b, m) >= 2 AND b + m >= 3""")
def profile_filtered(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("b"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("m"))
    return hierarchy.filter_profile(c, ["b", "m"], 2, 3)


def _places(spark, d):
    root = spark.createDataFrame([("root", None)], "node string, parent string")
    region = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("root"))
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    return root.union(region).union(nation)


@query("""SELECT 'root' AS node, 0 AS depth, count(DISTINCT n_regionkey) AS children, count(*) AS leaves, count(*) + count(DISTINCT n_regionkey) AS below FROM nation
 UNION ALL SELECT 'r' || n_regionkey, 1, count(*), count(*), count(*) FROM nation GROUP BY n_regionkey UNION ALL SELECT 'n' || n_nationkey, 2, 0, 1, 0 FROM nation""")
def tree_measures(spark, d):
    nodes = _places(spark, d)
    return hierarchy.tree_measures(nodes, hierarchy.closure(spark, nodes))


@query("""SELECT 'r' || n_regionkey AS root, 'n' || n_nationkey AS node, 1 AS dist FROM nation WHERE n_regionkey IN (1, 3)""")
def tree_subtree(spark, d):
    roots = spark.createDataFrame([("r1",), ("r3",), ("nowhere",)], "node string")
    return hierarchy.subtree(hierarchy.closure(spark, _places(spark, d)), roots, leaves_only=True)


@query("""SELECT DISTINCT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2""")
def ontology_items_below(spark, d):
    links = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("node"), "c_custkey")
    return hierarchy.items_below(links, hierarchy.closure(spark, _places(spark, d)), spark.createDataFrame([("r2",)], "node string"), "c_custkey")


@query("""WITH m AS (SELECT l_returnflag, l_partkey, l_quantity::BIGINT AS n, l_discount + 0.5 AS p, l_tax AS pct FROM lineitem), b AS (SELECT *, min(p) OVER (PARTITION BY l_returnflag, l_partkey) AS best FROM m)
 SELECT l_returnflag, l_partkey, floor(sum(n * (CASE WHEN p = best THEN 1.0::DOUBLE ELSE best / p END)) + 1e-9)::BIGINT AS weighted, sum(n)::BIGINT AS total, count(*) AS matches, max(pct) AS best_pct FROM b GROUP BY ALL""")
def expression_profile(spark, d):
    m = table(spark, d, "lineitem").select("l_returnflag", "l_partkey", F.col("l_quantity").cast("long").alias("n"), (F.col("l_discount") + 0.5).alias("p"), F.col("l_tax").alias("pct"))
    return expression.profile(m, ["l_returnflag", "l_partkey"], "n", "p", "pct")


@query("""WITH v AS (SELECT o_custkey, list(round(o_totalprice)) AS v FROM orders GROUP BY o_custkey), m AS (SELECT *, list_avg(v) AS mean FROM v)
 SELECT o_custkey, round(mean, 4) AS mean FROM m WHERE len(list_filter(v, lambda x: x >= 30000)) >= 0.8 * len(v) AND mean BETWEEN 100000 AND 250000 AND list_avg(list_transform(v, lambda x: abs(x - mean))) / mean BETWEEN 0.2 AND 0.6""")
def expression_filtered(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.round("o_totalprice")).alias("v"))
    kept = expression.filter_rows(rows, "v", 80, 30_000, (100_000, 250_000), (0.2, 0.6))
    return kept.select("o_custkey", F.round(expression.row_mean(F.col("v")), 4).alias("mean"))


@query("""WITH f AS (SELECT o_custkey, o_orderkey, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS b, datediff('day', DATE '1970-01-01', o_orderdate::DATE) + 45 AS e FROM orders),
 s AS (SELECT c_custkey, 9000 + 100 * (c_custkey % 7) AS f, 9250 + 100 * (c_custkey % 7) AS t FROM customer)
 SELECT o_orderkey, c_custkey AS slice, greatest(b, f)::BIGINT AS b, least(e, t)::BIGINT AS e FROM f JOIN s ON o_custkey = c_custkey AND b <= t AND f <= e""")
def intervals_in_slices(spark, d):
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long")
    features = table(spark, d, "orders").select(F.col("o_custkey").alias("g"), "o_orderkey", day.alias("b"), (day + 45).alias("e"))
    shift = 100 * (F.col("c_custkey") % 7)
    slices = table(spark, d, "customer").select(F.col("c_custkey").alias("slice"), F.col("c_custkey").alias("g"), (9000 + shift).alias("from"), (9250 + shift).alias("to"))
    return intervals.in_slices(features, slices, "g", "b", "e", 50, clip=True).select("o_orderkey", "slice", "b", "e")


@query("""WITH s AS (SELECT p_size, translate(md5(p_name || p_partkey), '0123456789abcdef', 'ACGUACGAACGUACAA') AS seq FROM part),
 k AS (SELECT i - 1 AS beg, 32 - i AS "end", i FROM unnest(range(1, 9)) AS t(i)),
 p AS (SELECT p_size, beg, "end", substr(seq, i::INTEGER, 1) AS x, substr(seq, 33 - i::INTEGER, 1) AS y, count(*) AS n FROM s, k GROUP BY ALL),
 e AS (SELECT a.p_size, a.beg, a."end", a.x, b.y, a.n * b.n AS n FROM (SELECT p_size, beg, "end", x, sum(n) AS n FROM p GROUP BY ALL) a JOIN (SELECT p_size, beg, "end", y, sum(n) AS n FROM p GROUP BY ALL) b USING (p_size, beg, "end")),
 u AS (SELECT 'seen' AS kind, * FROM p UNION ALL SELECT 'random', * FROM e),
 r AS (SELECT *, row_number() OVER (PARTITION BY kind, p_size, beg ORDER BY n DESC, x, y) AS k FROM u),
 c AS (SELECT a.kind, a.p_size, a.beg, a."end", sum(CASE WHEN b.k > a.k AND a.x <> b.x AND a.y <> b.y THEN b.n ELSE 0 END) AS cov,
  sum(CASE WHEN b.k > a.k AND (a.x <> b.x) <> (a.y <> b.y) AND NOT (a.x = 'G' AND b.x = 'G' AND a.y IN ('C', 'U') AND b.y IN ('C', 'U')) AND NOT (a.y = 'G' AND b.y = 'G' AND a.x IN ('C', 'U') AND b.x IN ('C', 'U')) THEN b.n ELSE 0 END) AS un
  FROM r a JOIN r b ON a.kind = b.kind AND a.p_size = b.p_size AND a.beg = b.beg GROUP BY ALL),
 h AS (SELECT *, CASE WHEN cov = 0 THEN 0.0::DOUBLE ELSE cov::DOUBLE / (cov + un) END AS share FROM c)
 SELECT p_size, beg::INTEGER AS beg, "end"::INTEGER AS "end", round(least(1.0, greatest(0.0, 2 * (max(share) FILTER (kind = 'seen') - max(share) FILTER (kind = 'random')))), 6) AS score FROM h GROUP BY ALL""")
def alignment_covariation(spark, d):
    seq = F.translate(F.md5(F.concat("p_name", "p_partkey").cast("binary")), "0123456789abcdef", "ACGUACGAACGUACAA")
    rows = table(spark, d, "part").select("p_size", seq.alias("seq"))
    pairs = rows.select("p_size").distinct().select("p_size", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("beg")).withColumn("end", 31 - F.col("beg"))
    scores = structure.covariation(alignment.pair_counts(rows, "p_size", "seq", pairs), ["p_size", "beg", "end"])
    return scores.select("p_size", "beg", "end", F.round("score", 6).alias("score"))
