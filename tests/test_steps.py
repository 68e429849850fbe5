"""Mates, positions in alignments and tables by rank on odd input."""

import random

from pyspark.sql import functions as F

from strandloom.operators import alignment, hierarchy, intervals, records, similarity


def test_mates_stay_together(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (None, "z"), (4, None)], "id long, seq string")
    b = spark.createDataFrame([(2, "m"), (3, "m"), (None, "m"), (4, "m")], "id long, other string")
    left, right = records.filter_mates(a, b, ["id"])
    assert sorted((r["id"], r["seq"] or "") for r in left.collect()) == [(2, "x"), (2, "y"), (4, "")]
    assert sorted(r["id"] for r in right.collect()) == [2, 4] and left.columns == ["id", "seq"]
    assert all(df.count() == 0 for df in records.filter_mates(a, b.limit(0), ["id"]))


def test_positions_lead_back_to_columns(spark):
    rows = spark.createDataFrame([(1, "-A.C~G-"), (2, ""), (3, None), (4, "---"), (1, "AC")], "id long, seq string").withColumn("first", F.lit("x"))
    got = rows.select("id", *(alignment.column_of(F.col("seq"), F.lit(k)).alias(f"c{k + 1}") for k in (-1, 0, 2, 3))).collect()
    assert [tuple(r) for r in got] == [(1, None, 1, 5, None), (2, None, None, None, None), (3, None, None, None, None), (4, None, None, None, None), (1, None, 0, None, None)]
    back = alignment.to_sequence_positions(rows.where("id = 1 AND seq LIKE '-%'"), "id", "seq").join(rows.where("seq LIKE '-%' AND id = 1").select("id", "seq"), "id")
    assert all(r["column"] == r["again"] for r in back.withColumn("again", alignment.column_of(F.col("seq"), F.col("position"))).collect())
    ranges = rows.withColumn("b", F.lit(-5)).withColumn("e", F.lit(1))
    assert [(r["first_column"], r["last_column"]) for r in alignment.columns_of_ranges(ranges, "seq", "b", "e").collect()] == [(1, 3), (None, None), (None, None), (None, None), (0, 1)]
    none = rows.withColumn("b", F.lit(9)).withColumn("e", F.lit(12))
    assert {r["first_column"] for r in alignment.columns_of_ranges(none, "seq", "b", "e").collect()} == {None}


def test_tables_of_all_ranks_have_the_same_totals(spark):
    nodes = spark.createDataFrame([("r", None, "domain"), ("p", "r", "phylum"), ("g", "p", "genus"), ("h", "p", "genus")], "node string, parent string, rank string")
    up = hierarchy.closure(spark, nodes)
    profile = spark.createDataFrame([("g", "a", 3.0), ("g", "a", 1.0), ("h", "b", 2.0), ("p", "a", 4.0), ("x", "b", 1.0), (None, "b", 1.0), ("g", None, 9.0), ("g", "a", None)], "node string, sample string, score double")
    got = {(r["rank"], r["node"], r["sample"]): (r["score"], r["normalised"], r["scaled"]) for r in hierarchy.rank_tables(profile, nodes, up, ["phylum", "genus"], to=100).collect()}
    assert got == {("phylum", "p", "a"): (8.0, 100.0, 6.0), ("phylum", "p", "b"): (2.0, 50.0, 3.0), ("phylum", None, "b"): (2.0, 50.0, 3.0), ("genus", "g", "a"): (4.0, 50.0, 3.0), ("genus", None, "a"): (4.0, 50.0, 3.0), ("genus", "h", "b"): (2.0, 50.0, 3.0), ("genus", None, "b"): (2.0, 50.0, 3.0)}
    few = hierarchy.rank_tables(profile, nodes, up, ["genus"], least=5).collect()
    assert {(r["node"], r["sample"]) for r in few} == {(None, "a"), (None, "b")}
    assert hierarchy.rank_tables(profile.limit(0), nodes, up, ["genus"]).count() == 0


def test_frequent_words_join_all_their_rows(spark):
    left = spark.createDataFrame([(i, w) for i in range(40) for w in ("hot", "cold")] + [(99, "lone"), (98, None)], "q long, w string").withColumn("often", F.lit(0))
    right = spark.createDataFrame([(i, "hot") for i in range(100)] + [(1, "cold"), (2, "other"), (3, None)], "r long, w string")
    got = sorted((r["q"], r["r"], r["w"]) for r in similarity.joined_by_word(left, right, "w", F.xxhash64("q")).collect())
    assert got == sorted([(q, r, "hot") for q in range(40) for r in range(100)] + [(q, 1, "cold") for q in range(40)])


def plain_chains(rows, gap, shift):
    """Links of mutual nearest matches, tried pair by pair."""
    ways = []
    for k, p, q, s, n, strand in rows:
        for k2, p2, q2, s2, n2, strand2 in rows:
            if p != p2 or strand != strand2:
                continue
            dq, ds = q2 - q - n, (s2 - s - n) if strand == "+" else (s - s2 - n2)
            if 0 <= dq <= gap and 0 <= ds <= gap and abs(dq - ds) <= shift:
                ways.append((k, k2, dq + ds, abs(dq - ds)))
    to = {k: min((f, o, b) for a, b, f, o in ways if a == k)[2] for k, *_ in rows if any(a == k for a, *_ in ways)}
    frm = {k: min((f, o, a) for a, b, f, o in ways if b == k)[2] for k, *_ in rows if any(b == k for _, b, *_ in ways)}
    up = {b: a for a, b in to.items() if frm.get(b) == a}
    head = lambda k: head(up[k]) if k in up else k
    return {k: head(k) for k, *_ in rows}


def test_chains_look_back_past_other_matches(spark):
    dice = random.Random(3)
    rows = [(i, dice.choice("xy"), dice.randint(1, 400), dice.randint(1, 400), dice.randint(1, 20), dice.choice("+-")) for i in range(250)]
    # One after the other on a diagonal, with strangers between.
    rows += [(1000 + i, "z", 10 + 30 * i, 500 + 30 * i, 12, "+") for i in range(12)] + [(1100 + i, "z", 20 + 30 * i, 9000 - 100 * i, 3, "+") for i in range(12)]
    rows += [(1200 + i, "z", 10 + 30 * i, 900 - 30 * i, 12, "-") for i in range(5)]
    schema = "id long, pair string, q int, s int, n int, strand string"
    df = spark.createDataFrame([*rows, (None, "x", 1, 1, 1, "+"), (2000, "x", None, 1, 1, "+")], schema).withColumn("chain", F.lit("mine"))
    found = {r["id"]: r["chain"] for r in intervals.chains(df, "id", ["pair"], "q", "s", "n", 40, 6, "strand").collect()}
    assert found == plain_chains(rows, 40, 6)
    assert {found[1000 + i] for i in range(12)} == {1000} and {found[1200 + i] for i in range(5)} == {1200}
    assert intervals.chains(df.limit(0), "id", ["pair"], "q", "s", "n", 40, 6).count() == 0
