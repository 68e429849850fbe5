"""Queries of pairwise alignment, primers, paired patterns, patterns from alignments, masks and containment, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from ..operators import agglomerate, alipatterns, containment, hierarchy, masks, pairwise, patterns, primers, stacking
from ..registry import query, table

#: Names of parts, each with that of the next part of its brand.
_NEIGHBOURS = """neighbours AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)"""

#: The cheapest alignment of each two names by Levenshtein distances of all their beginnings, walked back from
#: the end; x and y are the gapped strings.
_WALK = f"""WITH RECURSIVE {_NEIGHBOURS},
 two AS (SELECT DISTINCT a, b FROM neighbours WHERE b IS NOT NULL),
 cells AS MATERIALIZED (SELECT a, b, i, j, levenshtein(a[1:i::INT], b[1:j::INT]) AS c FROM two, unnest(range(0, length(a) + 1)) AS s(i), unnest(range(0, length(b) + 1)) AS t(j)),
 walk AS (
  SELECT a, b, length(a)::BIGINT AS i, length(b)::BIGINT AS j, '' AS x, '' AS y, 0 AS same, 0 AS paired FROM two
  UNION ALL
  SELECT w.a, w.b, i - (step < 3)::INT, j - (step <> 2)::INT, CASE step WHEN 3 THEN '-' ELSE a[i] END || x, CASE step WHEN 2 THEN '-' ELSE b[j] END || y, same + (step = 1 AND a[i] = b[j])::INT, paired + (step = 1)::INT
  FROM (SELECT w.*, CASE WHEN i > 0 AND j > 0 AND here.c = diagonal.c + (w.a[i] <> w.b[j])::INT THEN 1 WHEN i > 0 AND here.c = down.c + 1 THEN 2 ELSE 3 END AS step
   FROM walk w JOIN cells here USING (a, b, i, j) LEFT JOIN cells diagonal ON diagonal.a = w.a AND diagonal.b = w.b AND diagonal.i = w.i - 1 AND diagonal.j = w.j - 1
   LEFT JOIN cells down ON down.a = w.a AND down.b = w.b AND down.i = w.i - 1 AND down.j = w.j WHERE w.i > 0 OR w.j > 0) w
 ), aligned AS (SELECT a, b, x, y, same, paired FROM walk WHERE i = 0 AND j = 0)"""


def _neighbours(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("b"))


@query(f"""{_WALK} SELECT n.p_partkey, x AS a_gapped, y AS b_gapped, same::BIGINT AS matches, length(x)::BIGINT AS columns, round(100.0::DOUBLE * same / nullif(paired, 0), 6) AS identity
 FROM neighbours n JOIN aligned USING (a, b)""")
def align_pairs(spark, d):
    return pairwise.align_pairs(_neighbours(spark, d).where("b IS NOT NULL"), "a", "b").select("p_partkey", "a_gapped", "b_gapped", "matches", "columns", F.round("identity", 6).alias("identity"))


@query(f"""{_WALK}, places AS (SELECT *, list_transform(range(1, length(x) + 1), lambda k: length(replace(x[1:k::INT], '-', ''))) AS upto FROM aligned)
 SELECT n.p_partkey, CASE WHEN length(n.a) >= 6 THEN replace(y[list_position(upto, 3) : list_position(upto, 6)], '-', '') END AS region FROM neighbours n LEFT JOIN places USING (a, b)""")
def align_regions(spark, d):
    return pairwise.region_of(_neighbours(spark, d), "a", "b", 3, 6).select("p_partkey", "region")


_SMALL, _CAPITAL = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CAPITALS = f"translate(text, '{_SMALL}', '{_CAPITAL}')"


def _capitals():
    return F.translate("text", _SMALL, _CAPITAL)


def _apart(x: str, y: str, n: str) -> str:
    """SQL: in how many of ``n`` characters two strings differ."""
    return f"len(list_filter(range(1, {n}::INT + 1), lambda k: ({x})[k::INT] <> ({y})[k::INT]))"


#: Where the first (last) 24 characters of a benchmark item stand in a document with two others at most: one of
#: three pieces stands there as it is.
_ENDS = f"""texts AS (SELECT doc_id, {_CAPITALS} AS s FROM documents),
 ends AS (SELECT item_id, 'f' AS side, {_CAPITALS}[1:24] AS p FROM benchmark WHERE length(text) >= 24 UNION ALL SELECT item_id, 'r', {_CAPITALS}[-24:] FROM benchmark WHERE length(text) >= 24),
 bits AS (SELECT *, substr(p, 8 * k::INT + 1, 8) AS w FROM ends, unnest(range(0, 3)) AS t(k)),
 likely AS (SELECT * FROM texts WHERE EXISTS (SELECT 1 FROM bits WHERE contains(texts.s, bits.w))),
 grams AS (SELECT doc_id, i, substr(s, i::INT, 8) AS w FROM likely, unnest(range(1, length(s) - 6)) AS t(i)),
 places AS (SELECT DISTINCT doc_id, item_id, side, p, i - 8 * k AS i FROM grams JOIN bits USING (w) WHERE i - 8 * k > 0),
 hits AS (SELECT doc_id, item_id, side, i, length(s) AS n, {_apart('substr(s, i::INT, 24)', 'p', '24')} AS apart FROM places JOIN texts USING (doc_id) WHERE i + 23 <= length(s)),
 best AS (SELECT *, CASE side WHEN 'f' THEN i - 1 ELSE n - i - 23 END AS begin FROM hits WHERE apart <= 2
  QUALIFY row_number() OVER (PARTITION BY doc_id, side ORDER BY apart, CASE side WHEN 'f' THEN i - 1 ELSE n - i - 23 END, item_id::VARCHAR) = 1)"""


def _primed(spark, d):
    items = table(spark, d, "benchmark").where(F.length("text") >= 24).select(F.col("item_id").cast("string").alias("name"), _capitals().alias("t"))
    forward = items.select("name", F.substring("t", 1, 24).alias("seq"))
    reverse = items.select("name", reverse_complement(F.right("t", F.lit(24))).alias("seq"))
    reads = table(spark, d, "documents").select("doc_id", _capitals().alias("seq"))
    return primers.primer_pairs(reads, "seq", forward, reverse, ambiguous=False)


@query(f"""WITH {_ENDS} SELECT d.doc_id, f.item_id::VARCHAR AS forward, coalesce(f.begin, -1)::INT AS f_begin, coalesce(f.apart, -1)::INT AS f_apart, r.item_id::VARCHAR AS reverse, coalesce(r.begin, -1)::INT AS r_begin, coalesce(r.apart, -1)::INT AS r_apart,
 CASE WHEN f.item_id = r.item_id THEN f.item_id::VARCHAR END AS pair
 FROM documents d LEFT JOIN (SELECT * FROM best WHERE side = 'f') f ON f.doc_id = d.doc_id LEFT JOIN (SELECT * FROM best WHERE side = 'r') r ON r.doc_id = d.doc_id""")
def primer_pairs(spark, d):
    return _primed(spark, d).select("doc_id", F.col("f_primer.name").alias("forward"), F.coalesce("f_primer.begin", F.lit(-1)).alias("f_begin"), F.coalesce("f_primer.mismatches", F.lit(-1)).alias("f_apart"), F.col("r_primer.name").alias("reverse"), F.coalesce("r_primer.begin", F.lit(-1)).alias("r_begin"), F.coalesce("r_primer.mismatches", F.lit(-1)).alias("r_apart"), "pair")


@query(f"""WITH {_ENDS} SELECT f.item_id::VARCHAR AS forward, r.item_id::VARCHAR AS reverse, count(*) AS reads FROM best f JOIN best r ON f.doc_id = r.doc_id AND f.side = 'f' AND r.side = 'r' GROUP BY ALL""")
def primer_cross_matches(spark, d):
    return primers.cross_matches(_primed(spark, d))


@query(f"""WITH texts AS (SELECT doc_id, {_CAPITALS} AS s FROM documents),
 primed AS (SELECT item_id, {_CAPITALS}[13:30] AS p FROM benchmark WHERE length(text) >= 30), tags AS (SELECT {_CAPITALS}[7:12] AS tag, min(item_id) AS sample FROM benchmark WHERE length(text) >= 30 GROUP BY 1),
 bits AS (SELECT *, substr(p, 9 * k::INT + 1, 9) AS w FROM primed, unnest(range(0, 2)) AS t(k)),
 likely AS (SELECT * FROM texts WHERE EXISTS (SELECT 1 FROM bits WHERE contains(texts.s, bits.w))),
 grams AS (SELECT doc_id, i, substr(s, i::INT, 9) AS w FROM likely, unnest(range(1, length(s) - 7)) AS t(i)),
 places AS (SELECT DISTINCT doc_id, item_id, p, i - 9 * k AS i FROM grams JOIN bits USING (w) WHERE i - 9 * k > 0),
 hits AS (SELECT doc_id, item_id, s, i, {_apart('substr(s, i::INT, 18)', 'p', '18')} AS apart FROM places JOIN texts USING (doc_id) WHERE i + 17 <= length(s)),
 best AS (SELECT * FROM hits WHERE apart <= 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY apart, i, item_id::VARCHAR) = 1),
 coded AS (SELECT best.*, a.sample AS near, b.sample AS far, substr(s, i::INT - 6, 6) AS n_tag, substr(s, i::INT - 7, 6) AS f_tag FROM best LEFT JOIN tags a ON i > 6 AND a.tag = substr(s, i::INT - 6, 6) LEFT JOIN tags b ON i > 7 AND b.tag = substr(s, i::INT - 7, 6))
 SELECT doc_id, c.item_id::VARCHAR AS primer, coalesce(near, far)::VARCHAR AS sample, CASE WHEN i IS NULL THEN NULL WHEN i - 1 < 6 THEN 'no-room' WHEN near IS NOT NULL THEN n_tag WHEN far IS NOT NULL THEN f_tag ELSE 'no-barcode' END AS outcome
 FROM documents LEFT JOIN coded c USING (doc_id)""")
def primer_demultiplex(spark, d):
    items = table(spark, d, "benchmark").where(F.length("text") >= 30).select("item_id", _capitals().alias("t"))
    listed = items.select(F.col("item_id").cast("string").alias("name"), F.substring("t", 13, 18).alias("seq"))
    barcodes = items.select(F.substring("t", 7, 6).alias("tag"), F.col("item_id").alias("sample"))
    reads = table(spark, d, "documents").select("doc_id", _capitals().alias("seq"))
    # Both strands are looked at; documents of other letters than bases hold primers on one only.
    found = primers.demultiplex_reads(reads, "seq", listed, barcodes, mismatches=1, most_gap=1, ambiguous=False)
    return found.select("doc_id", F.col("primer.name").alias("primer"), F.col("sample").cast("string").alias("sample"), "outcome")


@query("""WITH starts AS (SELECT item_id, text AS s, i, n, g, lower(text) AS t FROM benchmark, unnest(range(1, length(text))) AS a(i), unnest(range(3, 6)) AS b(n), unnest(range(0, 3)) AS c(g)),
 hits AS (SELECT item_id, i, 2 * n + g AS n FROM starts WHERE i + 2 * n + g - 1 <= length(t) AND regexp_full_match(substr(t, i::INT, n::INT), '[aeinorst]+') AND substr(t, i::INT, n::INT) = reverse(substr(t, (i + n + g)::INT, n::INT)))
 SELECT item_id, coalesce(i - 1, -1)::INT AS at, coalesce(n, -1)::INT AS n FROM benchmark LEFT JOIN (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY i, n) = 1) USING (item_id)""")
def pattern_mirrored(spark, d):
    pattern = "r1={aa,ee,ii,nn,oo,rr,ss,tt} p1=3...5 0...2 r1~p1"
    # Prose: T isn't U here. The SQL's small letters have an i for the one other character that becomes one of them.
    return _spans(table(spark, d, "benchmark").withColumn("text", F.translate("text", "\u0130", "i")), pattern, plain=True)


def _spans(rows, pattern, plain=False):
    m = F.get(patterns.find_pattern(F.col("text"), pattern, 1, plain), 0)
    begin, last = F.get(m, 0)["at"], F.element_at(m, -1)
    return rows.select("item_id", F.coalesce(begin, F.lit(-1)).alias("at"), F.coalesce(last["at"] + last["n"] - begin, F.lit(-1)).alias("n"))


@query(f"""WITH starts AS (SELECT item_id, i, n, g, {_CAPITALS} AS t FROM benchmark, unnest(range(1, length(text))) AS a(i), unnest(range(5, 8)) AS b(n), unnest(range(0, 13)) AS c(g)),
 hits AS (SELECT item_id, i, 2 * n + g AS n, {_apart('substr(t, i::INT, n::INT)', 'substr(t, (i + n + g)::INT, n::INT)', 'n')} AS apart FROM starts WHERE i + 2 * n + g - 1 <= length(t))
 SELECT item_id, coalesce(i - 1, -1)::INT AS at, coalesce(n, -1)::INT AS n FROM benchmark LEFT JOIN (SELECT * FROM hits WHERE apart <= 1 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY i, apart, n) = 1) USING (item_id)""")
def pattern_repeated(spark, d):
    return _spans(table(spark, d, "benchmark"), "p1=5...7 0...12 p1[1,0,0]")


_CODED = "{'A': 'A', 'C': 'C', 'G': 'G', 'T': 'T', 'AG': 'R', 'CT': 'Y', 'CG': 'S', 'AT': 'W', 'GT': 'K', 'AC': 'M'}"


@query(f"""WITH r AS (SELECT (item_id % 15)::VARCHAR AS ali, substr(upper(regexp_replace(lower(text), '[^acgt]', '', 'g')), 1, 40) AS s FROM benchmark),
 sizes AS (SELECT ali, count(*) AS rows, max(length(s)) AS width FROM r GROUP BY ali),
 cols AS (SELECT ali, i, count(*) AS n, array_to_string(list_sort(list_distinct(list(substr(s, i::INT, 1)))), '') AS bases FROM r, unnest(range(1, length(s) + 1)) AS t(i) GROUP BY ALL),
 told AS (SELECT ali, i, (MAP {_CODED})[bases] AS code, i - row_number() OVER (PARTITION BY ali ORDER BY i) AS island FROM cols JOIN sizes USING (ali) WHERE n = rows AND length(bases) <= 2),
 runs AS (SELECT ali, min(i) AS a, max(i) AS b, string_agg(code, '' ORDER BY i) AS codes FROM told GROUP BY ali, island HAVING count(*) >= 3),
 gaps AS (SELECT ali, coalesce(lag(b) OVER (PARTITION BY ali ORDER BY a), 0) + 1 AS a, a - 1 AS b FROM runs UNION ALL SELECT ali, max(b) + 1, max(width) FROM runs JOIN sizes USING (ali) GROUP BY ali),
 spans AS (SELECT ali, a, min(n) AS least, max(n) AS most FROM (SELECT g.ali, g.a, greatest(0, least(length(s), b) - a + 1) AS n FROM gaps g JOIN r ON r.ali = g.ali WHERE a <= b) GROUP BY ALL),
 said AS (SELECT ali, a, codes AS part FROM runs UNION ALL SELECT ali, a, least || '...' || most FROM spans WHERE most > 0),
 made AS (SELECT ali, string_agg(part, ' ' ORDER BY a) AS pattern FROM said GROUP BY ali)
 SELECT ali, pattern FROM sizes LEFT JOIN made USING (ali)""")
def alignment_patterns(spark, d):
    letters = F.regexp_replace(F.lower("text"), "[^acgt]", "")
    rows = table(spark, d, "benchmark").select((F.col("item_id") % 15).cast("string").alias("ali"), F.substring(letters, 1, 40).alias("seq"))
    return alipatterns.patterns_from_alignments(rows, "ali", "seq")


@query("""WITH d AS (SELECT lang || '/' || source AS g, lang, doc_id, text FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL),
 w AS (SELECT DISTINCT g, doc_id, substr(run, i::INT, 4) AS word FROM (SELECT g, doc_id, unnest(regexp_extract_all(text, '[a-z]{4,}')) AS run FROM d), unnest(range(1, length(run) - 2)) AS t(i)),
 members AS (SELECT g, count(DISTINCT doc_id) AS m FROM d GROUP BY g), c AS (SELECT g, word, count(*) AS n FROM w GROUP BY ALL),
 nodes AS (SELECT DISTINCT g, unnest([g, lang, 'all']) AS node FROM d), own AS (SELECT node, count(*) AS groups FROM nodes JOIN members USING (g) GROUP BY node),
 cons AS (SELECT node, word FROM c JOIN members USING (g) JOIN nodes USING (g) JOIN own USING (node) WHERE 100 * n >= 60 * m GROUP BY node, word, groups HAVING count(*) = groups),
 times AS (SELECT word, count(*) AS n FROM c GROUP BY word), uniq AS (SELECT node, word FROM c JOIN nodes USING (g) JOIN times t USING (word) GROUP BY node, word, t.n HAVING count(*) = t.n)
 SELECT node, word, cons.word IS NOT NULL AS conserved, uniq.word IS NOT NULL AS "unique" FROM cons FULL JOIN uniq USING (node, word)""")
def signature_words(spark, d):
    rows = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("g"), "lang", "source", "doc_id", "text").where("lang IS NOT NULL AND source IS NOT NULL")
    tips = rows.select(F.col("g").alias("node"), F.col("lang").alias("parent")).distinct()
    tree = tips.union(rows.select("lang", F.lit("all")).distinct()).union(rows.select(F.lit("all"), F.lit(None).cast("string")).distinct())
    return masks.signature_words(rows, "g", "doc_id", "text", tree, hierarchy.closure(spark, tree), k=4, alphabet="abcdefghijklmnopqrstuvwxyz", least_members=60, least_groups=100)


@query("""WITH t AS (SELECT text, min(doc_id) AS first FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY text),
 inside AS (SELECT DISTINCT s.text FROM t s JOIN t l ON length(l.text) > length(s.text) AND contains(l.text, s.text))
 SELECT doc_id, i.text IS NOT NULL OR doc_id > first AS contained FROM documents JOIN t USING (text) LEFT JOIN inside i USING (text) WHERE doc_id IS NOT NULL""")
def seq_contained(spark, d):
    return containment.contained(table(spark, d, "documents"), "doc_id", "text")


@query(f"""WITH RECURSIVE groups AS (SELECT p_brand, p_size, p_partkey, p_name, first_value(p_partkey) OVER w AS q, first_value(p_name) OVER w AS a FROM part WINDOW w AS (PARTITION BY p_brand, p_size ORDER BY p_partkey)),
 two AS (SELECT DISTINCT a, p_name AS b FROM groups WHERE p_partkey <> q),
 {_WALK[_WALK.index(' cells AS') + 1 :]},
 signs AS (SELECT a, b, k, x[k::INT] AS q_sign, y[k::INT] AS s_sign, length(replace(x[1:k::INT], '-', '')) AS upto FROM aligned, unnest(range(1, length(x) + 1)) AS t(k)),
 placed AS (SELECT *, CASE WHEN q_sign = '-' THEN row_number() OVER (PARTITION BY a, b, upto, q_sign = '-' ORDER BY k) END AS run FROM signs),
 rows AS (SELECT DISTINCT q, a, NULL::BIGINT AS subject, a AS b FROM groups UNION ALL SELECT q, a, p_partkey, p_name FROM groups WHERE p_partkey <> q),
 own AS (SELECT q, subject, p.upto, p.run, s_sign FROM rows JOIN placed p USING (a, b) WHERE subject IS NOT NULL
  UNION ALL SELECT q, NULL, i, NULL, a[i::INT] FROM rows, unnest(range(1, length(a) + 1)) AS t(i) WHERE subject IS NULL),
 columns AS (SELECT DISTINCT q, CASE WHEN run IS NULL THEN upto - 1 ELSE upto END AS base, coalesce(run, 1000000) AS run FROM own),
 shown AS (SELECT q, subject, CASE WHEN run IS NULL THEN upto - 1 ELSE upto END AS base, coalesce(run, 1000000) AS run, s_sign FROM own)
 SELECT r.q AS query, coalesce(r.subject, -1) AS subject, string_agg(coalesce(s_sign, '-'), '' ORDER BY c.base, c.run) AS row FROM rows r JOIN columns c ON c.q = r.q LEFT JOIN shown s ON s.q = r.q AND s.subject IS NOT DISTINCT FROM r.subject AND s.base = c.base AND s.run = c.run
 GROUP BY r.q, r.subject""")
def alignment_stacked(spark, d):
    part = table(spark, d, "part")
    first = part.groupBy("p_brand", "p_size").agg(F.min_by(F.struct("p_partkey", "p_name"), "p_partkey").alias("first"))
    queries = first.select(F.col("first.p_partkey").alias("query"), F.col("first.p_name").alias("seq"))
    others = part.join(first, ["p_brand", "p_size"]).where(F.col("p_partkey") != F.col("first.p_partkey"))
    pairs = others.select(F.col("first.p_partkey").alias("query"), F.col("p_partkey").alias("subject"), F.col("first.p_name").alias("a"), F.col("p_name").alias("b"))
    hits = pairwise.align_pairs(pairs, "a", "b").select("query", "subject", F.lit(0).alias("q_begin"), F.col("a_gapped").alias("q_gapped"), F.col("b_gapped").alias("s_gapped"))
    return stacking.stacked(queries, hits).select("query", F.coalesce("subject", F.lit(-1)).alias("subject"), "row")


@query("""WITH RECURSIVE means AS (SELECT p_brand, p_size, avg(p_retailprice) AS price FROM part GROUP BY ALL),
 near AS (SELECT p_brand, p_size, round(price, 4) AS price, lead(p_brand || '/' || p_size) OVER w AS b, round(lead(round(price, 4)) OVER w - round(price, 4), 4) AS distance, p_brand || '/' || p_size AS a FROM means WINDOW w AS (ORDER BY round(price, 4), p_brand, p_size)),
 links AS (SELECT a, b FROM near WHERE distance <= 0.5 UNION SELECT b, a FROM near WHERE distance <= 0.5 UNION SELECT a, a FROM near),
 reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
 SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a""")
def distance_groups(spark, d):
    means = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.round(F.avg("p_retailprice"), 4).alias("price"))
    named = means.select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("a"), "price", "p_brand", "p_size")
    # The table of distances: each to the next in price, an ordered look at a row per brand and size (1250 at most).
    w = Window.orderBy("price", "p_brand", "p_size")
    pairs = named.select("a", F.lead("a").over(w).alias("b"), F.round(F.lead("price").over(w) - F.col("price"), 4).alias("distance"))
    return agglomerate.groups(named.select(F.col("a").alias("id")), agglomerate.merges(pairs, "single", 0.5))
