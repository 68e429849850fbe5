"""Covariation, folds, expression profiles, locators, trees and features against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from strandloom.functions import locators
from strandloom.operators import alignment, expression, hierarchy, intervals, structure


def share(pairs):
    """pairs: {(x, y): n}"""
    ranked = sorted(pairs.items(), key=lambda p: (-p[1], p[0]))
    cov = un = 0
    for (a, _), (b, n) in itertools.combinations(ranked, 2):
        changes = (a[0] != b[0]) + (a[1] != b[1])
        swap = (a[0] == b[0] == "G" and {a[1], b[1]} == {"C", "U"}) or (a[1] == b[1] == "G" and {a[0], b[0]} == {"C", "U"})
        cov += n if changes == 2 else 0
        un += n if changes == 1 and not swap else 0
    return cov / (cov + un) if cov else 0.0


def test_covariation_by_brute_force(spark):
    dice = random.Random(3)
    rows = []
    for ali in range(6):
        for _ in range(30):
            x = dice.choice("ACGU")
            y = {"A": "U", "C": "G", "G": "C", "U": "A"}[x] if dice.random() < ali / 5 else dice.choice("ACGU-")
            rows.append((ali, f"{x}..{y}".lower() if dice.random() < 0.3 else f"{x}..{y}"))
    t = spark.createDataFrame([*rows, (7, "A..U"), (8, None)], "ali int, seq string")
    pairs = spark.createDataFrame([(a, 0, 3) for a in range(9)], "ali int, beg int, end int")
    got = {r.ali: r.score for r in structure.covariation(alignment.pair_counts(t, "ali", "seq", pairs), ["ali", "beg", "end"]).collect()}
    for ali in range(6):
        seen, one, two = {}, {}, {}
        for a, s in rows:
            x, y = s.upper()[0], s.upper()[3]
            if a == ali and y != "-":
                seen[x, y] = seen.get((x, y), 0) + 1
                one[x], two[y] = one.get(x, 0) + 1, two.get(y, 0) + 1
        chance = {(x, y): one[x] * two[y] for x in one for y in two}
        assert abs(got[ali] - min(1, max(0, 2 * (share(seen) - share(chance))))) < 1e-9
    assert got[7] == 0.0 and 8 not in got and got[5] > got[0]


def test_fold_measures(spark):
    folds = ["((.((...)).))", "(((....)).)", "((..((...))))", "(..)(..)", "....", None, "<<xx>>", "(.((...))..)"]
    t = spark.createDataFrame([(f,) for f in folds], "f string")
    got = t.select(structure.has_branch(F.col("f")).alias("b"), structure.fold_center(F.col("f")).alias("c"), structure.fold_asymmetry(F.col("f")).alias("a")).collect()
    assert [r.b for r in got] == [False, False, False, True, False, None, False, False]
    assert [r.c for r in got][:4] == [6.5, 5.0, 7.5, 2.0] and got[4].c is None and got[5].c is None and got[6].c == 3.0
    assert got[0].a == 0 and got[2].a == 2 and got[3].a is None and got[4].a is None and got[7].a == 1


def test_lopsided_alignments(spark):
    rows = [("c", "A" * 20 + "-" * 20, 1)] * 4 + [("c", "-" * 20 + "C" * 20, 1)] * 4 + [("c", "AC" * 20, 1)] + [("n", "AC" * 20, 1)] * 5 + [("n", None, 1)]
    got = {r.ali: (r.left_only, r.right_only, r.chimeric) for r in structure.lopsided(spark.createDataFrame(rows, "ali string, seq string, n int"), "ali", "seq", "n").collect()}
    assert got == {"c": (4, 4, True), "n": (0, 0, False)}


def test_expression_rows(spark):
    t = spark.createDataFrame([("A", [1.0, 3.0, None]), ("b", [None, None]), ("c", [0.0, 0.0]), ("D", None)], "g string, v array<double>")
    got = {r.g: (r.m, r.s) for r in t.select("g", expression.row_mean(F.col("v")).alias("m"), expression.row_variation(F.col("v")).alias("s")).collect()}
    assert got == {"A": (2.0, 0.5), "b": (None, None), "c": (0.0, None), "D": (None, None)}
    kept = lambda **k: [r.g for r in expression.filter_rows(t, "v", **k).collect()]
    assert kept(defined_pct=60, least_value=1.0) == ["A"] and kept(mean=(0, 1)) == ["c"] and kept(name=("g", "^a")) == ["A"] and kept(variation=(0.4, 0.6)) == ["A"]
    a, b = F.array(F.lit(1.0), F.lit(2.0), F.lit(9.0)), F.array(F.lit(4.0), F.lit(8.0), F.lit(12.0))
    x, y = expression.scaled_rows(a, b)
    u, v = expression.scaled_rows(a, b, "median")
    r = spark.range(1).select(x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"), expression.mean_ratio(a, b).alias("m")).first()
    assert r.x == [2.0, 4.0, 18.0] and r.y == [4.0, 8.0, 12.0] and r.u == [4.0, 8.0, 36.0] and r.v == r.y and r.m == 0.5
    assert expression.balanced_groups([5, 4, 3, 3], 2) == [[5, 3], [4, 3]] and expression.balanced_groups([], 2) == [[], []]
    m = spark.createDataFrame([("k", 10, 0.1, 90.0), ("k", 10, 0.2, 95.0), (None, 3, None, 1.0)], "k string, n int, p double, pct double")
    assert sorted((str(r.k), r.weighted, r.total, r.matches, r.best_pct) for r in expression.profile(m, ["k"], "n", "p", "pct").collect()) == [("None", None, 3, 1, 1.0), ("k", 15, 20, 2, 95.0)]


def test_locators(spark):
    texts = ["s1 1,3;6,2,-", "s2", "s3 x", "", None, "s4 2,2,+;"]
    t = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("l", locators.parse_locator(F.col("t")))
    got = [r.l for r in t.collect()]
    assert [tuple(x) for x in got[0].locs] == [(0, 3, "+"), (5, 2, "-")] and got[1].id == "s2" and got[1].locs is None
    assert got[2] is None and got[3] is None and got[4] is None and [tuple(x) for x in got[5].locs] == [(1, 2, "+")]
    assert [r.f for r in t.limit(2).select(locators.format_locator(F.col("l")).alias("f")).collect()] == ["s1 1,3,+;6,2,-", "s2"]
    cut = t.limit(2).select(locators.located(F.lit("ACGTTGCA"), F.col("l.locs")).alias("s"), locators.turned(F.col("l.locs"), F.lit(8)).alias("t"), locators.shifted(F.col("l.locs"), 2).alias("h")).collect()
    assert cut[0].s == "ACG" + "GC" and cut[1].s == "ACGTTGCA" and [tuple(x) for x in cut[0].t] == [(1, 2, "+"), (5, 3, "-")] and cut[0].h[0].beg == 2
    b = spark.range(1).select(locators.insert_break(F.lit("abcd"), F.lit(2)).alias("x"), locators.insert_break(F.lit("abcd"), F.lit(-1)).alias("y")).first()
    assert (b.x, b.y) == ("ab cd", "abcd")


def test_trees(spark):
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r"), ("c", "a"), ("c", "b")], "node string, parent string")
    up = hierarchy.closure(spark, nodes)
    got = {r.node: (r.depth, r.children, r.leaves, r.below) for r in hierarchy.tree_measures(nodes, up).collect()}
    assert got == {"r": (0, 2, 1, 3), "a": (1, 1, 1, 1), "b": (1, 1, 1, 1), "c": (2, 0, 1, 0)}
    roots = spark.createDataFrame([("r",), ("b",), ("none",)], "node string")
    assert sorted((r.root, r.node) for r in hierarchy.subtree(up, roots, depth=1).collect()) == [("b", "b"), ("b", "c"), ("r", "a"), ("r", "b"), ("r", "r")]
    links = spark.createDataFrame([("c", 1), ("c", 1), ("r", 2), (None, 3)], "node string, item int")
    assert [r.item for r in hierarchy.items_below(links, up, roots.where("node = 'b'"), "item").collect()] == [1]
    pool = spark.createDataFrame([("x", 1, 2), ("y", 3, 4), ("z", 5, 6)], "seq string, a int, b int")
    clusters = spark.createDataFrame([("x", "x"), ("y", "x")], "id string, seed string")
    assert sorted(map(tuple, hierarchy.clustered_table(pool, "seq", ["a", "b"], clusters).collect())) == [("x", 4, 6, 2), ("z", 5, 6, 1)]


def test_best_features_and_slices(spark):
    dice = random.Random(4)
    rows = [(i, "g" if i % 3 else "h", b := dice.randint(0, 60), b + dice.randint(0, 15), dice.randint(1, 9)) for i in range(40)]
    t = spark.createDataFrame(rows, "id int, g string, b int, e int, score int")
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[0])):
        if not any(k[1] == r[1] and k[2] <= r[3] and r[2] <= k[3] for k in kept):
            kept.append(r)
    assert sorted(r.id for r in intervals.best_of_overlapping(t, "g", "id", "b", "e", "score", 10).collect()) == sorted(k[0] for k in kept)
    slices = spark.createDataFrame([(1, "g", 10, 30), (2, "h", 0, 5), (3, "g", 9, 8), (4, None, 0, 9)], "slice int, g string, from int, to int")
    want = sorted((i, s, max(b, f), min(e, o)) for i, g, b, e, _ in rows for s, h, f, o in ((1, "g", 10, 30), (2, "h", 0, 5)) if g == h and b <= o and f <= e)
    for width in (1, 7, 100):
        got = intervals.in_slices(t, slices, "g", "b", "e", width, clip=True).collect()
        assert sorted((r.id, r.slice, r.b, r.e) for r in got) == want
