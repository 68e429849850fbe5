"""Pairwise alignment, primers, paired patterns, patterns from alignments, masks and containment against plain versions."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.sequence import reverse_complement
from strandloom.operators import alignment, alipatterns, containment, hierarchy, masks, pairwise, patterns, primers
from strandloom.queries import QUERIES, SQL


def plain_alignment(a, b):
    cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, x, y = len(a), len(b), "", ""
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j, x, y = i - 1, j - 1, a[i - 1] + x, b[j - 1] + y
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i, x, y = i - 1, a[i - 1] + x, "-" + y
        else:
            j, x, y = j - 1, "-" + x, b[j - 1] + y
    return x, y


def edited(dice, text, n, letters="acgt"):
    text = list(text)
    for _ in range(n):
        at, kind = dice.randrange(len(text)), dice.random()
        if kind < 0.4:
            text[at] = dice.choice(letters)
        elif kind < 0.7:
            del text[at]
        else:
            text.insert(at, dice.choice(letters))
    return "".join(text)


def test_alignments_equal_a_plain_aligner(spark):
    dice = random.Random(1)
    word = lambda n: "".join(dice.choice("acgt-é") for _ in range(n))
    rows = [(word(dice.randint(0, 25)), word(dice.randint(0, 25))) for _ in range(300)] + [("", ""), (None, "a"), ("a", None), ("", "acg")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("matches", F.lit("mine")).drop("matches").withColumn("k", F.monotonically_increasing_id())
    for r in pairwise.align_pairs(df, "a", "b").collect():
        if r["a"] is None or r["b"] is None:
            assert r["aligned"] is None and r["a_gapped"] is None
            continue
        x, y = plain_alignment(r["a"], r["b"])
        assert (r["a_gapped"], r["b_gapped"], r["columns"]) == (x, y, len(x))
        assert r["identity"] is None or abs(r["identity"] - 100 * r["matches"] / r["paired"]) < 1e-9
    assert pairwise.align_pairs(df.limit(0), "a", "b").count() == 0


def test_seeds_hold_and_keep_the_cost_of_like_sequences(spark):
    dice = random.Random(2)
    a = "".join(dice.choice("acgt") for _ in range(6000))
    b = edited(dice, a, 60)
    one = pairwise.align_pairs(spark.createDataFrame([(a, b)], "a string, b string"), "a", "b", seed=12).first()
    assert one["a_gapped"].replace("-", "") == a and one["b_gapped"].replace("-", "") == b
    assert one["columns"] - one["matches"] <= 60
    short_a, short_b = a[:400], edited(dice, a[:400], 12)
    costs = [r["columns"] - r["matches"] for s in (None, 11) for r in pairwise.align_pairs(spark.createDataFrame([(short_a, short_b)], "a string, b string"), "a", "b", seed=s).collect()]
    assert costs[0] <= costs[1] <= costs[0] + 2
    far = pairwise.align_pairs(spark.createDataFrame([(a, b), ("ac", "ag")], "a string, b string"), "a", "b", most_cells=1000).collect()
    assert [(r["aligned"], r["matches"]) for r in far] == [(False, None), (True, 1)]


def test_seed_matches_are_exact_in_order_and_apart():
    dice = random.Random(3)
    for _ in range(200):
        a = "".join(dice.choice("ab") for _ in range(60))
        b = edited(dice, a, 5, "ab")
        x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
        held = pairwise.seed_matches(x, y, 7)
        for p, q, n in held:
            assert n >= 7 and a[p : p + n] == b[q : q + n]
        for (p, q, n), (r, s, _) in zip(held, held[1:], strict=False):
            assert p + n <= r and q + n <= s


def test_regions_follow_the_reference(spark):
    rows = [("aaccggtt", "aaccggtt"), ("aaccggtt", "aaccgtt"), ("aaccggtt", ""), ("aac", "aac"), (None, "a"), ("aaccggtt", "ttaaccxggtt")]
    got = [r["region"] for r in pairwise.region_of(spark.createDataFrame(rows, "a string, b string"), "a", "b", 3, 6).collect()]
    assert got[:5] == ["ccgg", "ccg", "", None, None] and got[5] == "ccxgg"


def plain_primers(read, listed, mismatches):
    hits = [(sum(x != y for x, y in zip(read[i:], p, strict=False)), i, name) for name, p in listed for i in range(len(read) - len(p) + 1)]
    return min((h for h in hits if h[0] <= mismatches), default=None)


@pytest.mark.parametrize("block", [20_000, 7])
def test_primers_equal_trying_all(spark, monkeypatch, block):
    monkeypatch.setattr(primers, "BLOCK", block)
    dice = random.Random(4)
    word = lambda n: "".join(dice.choice("ACGT") for _ in range(n))
    listed = [(f"p{i:02d}", word(dice.randint(9, 14))) for i in range(30)] + [("p99", "ACGTACGTAC"), ("p98", "ACGTACGTAC")]
    reads = []
    for i in range(300):
        p = list(dice.choice(listed)[1])
        for _ in range(dice.randint(0, 3)):
            p[dice.randrange(len(p))] = dice.choice("ACGT")
        reads.append((i, word(dice.randint(0, 20)) + "".join(p) + word(dice.randint(0, 20))))
    reads += [(900, None), (901, ""), (902, "ac"), (903, listed[3][1].lower())]
    table = spark.createDataFrame([*listed, (None, "ACGTACGTAC"), ("x", None), ("y", "")], "name string, seq string")
    found = primers.find_primers(spark.createDataFrame(reads, "id long, seq string"), "seq", table, 2).collect()
    assert len(found) == len(reads)
    for r in found:
        want = plain_primers(r["seq"].upper(), listed, 2) if r["seq"] else None
        assert (tuple(r["primer"])[:3] if r["primer"] else None) == want


def test_codes_in_primers_and_empty_lists(spark):
    reads = spark.createDataFrame([(1, "ttACGTTGCAtt"), (2, "ttACGTUGCAtt")], "id long, seq string")
    listed = spark.createDataFrame([("a", "ACGNTRCA")], "name string, seq string")
    assert [r["primer"]["begin"] for r in primers.find_primers(reads, "seq", listed, 0).collect()] == [2, 2]
    assert [r["primer"] for r in primers.find_primers(reads, "seq", listed.limit(0), 0).collect()] == [None, None]
    with pytest.raises(ValueError):
        primers.find_primers(reads, "seq", spark.createDataFrame([("n", "NNNNNNNNNN")], "name string, seq string"), 0)


def test_reads_are_turned_and_dealt_to_samples(spark):
    primer, good = "GGATTAGATACCC", "AACCTT"
    read = "TT" + good + primer + "ACGTACGT"
    turned = read[::-1].translate(str.maketrans("ACGT", "TGCA"))
    values = list(range(len(read)))
    rows = [(1, read, values), (2, turned, values[::-1]), (3, "ACGTACGTTTTTTTTTTTTTTTT", None), (4, "TTCC" + primer, None), (5, "CCCCCCCC" + primer, None)]
    df = spark.createDataFrame(rows, "id long, seq string, values array<int>")
    tags = spark.createDataFrame([(good, "s1"), ("GGGGGG", "s2")], "tag string, sample string")
    listed = spark.createDataFrame([("v4", primer)], "name string, seq string")
    got = {r["id"]: r for r in primers.demultiplex_reads(df, "seq", listed, tags, values="values", least=2).collect()}
    assert (got[1]["strand"], got[1]["sample"], got[2]["strand"], got[2]["sample"]) == ("+", "s1", "-", "s1")
    assert got[2]["seq"] == read and got[2]["values"] == values
    assert (got[3]["strand"], got[3]["outcome"], got[4]["outcome"], got[5]["outcome"]) == (None, None, "no-room", "no-barcode")
    low = primers.demultiplex_reads(df, "seq", listed, tags, values="values", least=3).where("id = 2").first()
    assert (low["sample"], low["outcome"]) == (None, "low-quality")


def plain_hairpins(text, stem, loop):
    mates = {"A": "TU", "T": "A", "U": "A", "G": "C", "C": "G"}
    out, at = [], 0
    while at < len(text):
        best = None
        for n in range(stem[0], stem[1] + 1):
            for g in range(loop[0], loop[1] + 1):
                end = at + 2 * n + g
                if end <= len(text) and all(text[end - 1 - i] in mates[text[at + i]] for i in range(n)):
                    best = min(best or (end + 1, ()), (end, ((at, n), (at + n, g), (at + n + g, n))))
        if best:
            out.append(list(best[1]))
            at = best[0]
        else:
            at += 1
    return out


def test_hairpins_equal_trying_all():
    dice = random.Random(5)
    for _ in range(150):
        text = "".join(dice.choice("ACGT") for _ in range(70))
        assert patterns.matches_in(text, "p1=3...5 2...6 ~p1") == plain_hairpins(text, (3, 5), (2, 6))


def test_names_rules_and_errors():
    find = patterns.matches_in
    assert find("xxabcdabcdxx", "p1=3...4 p1") == [[(2, 4), (6, 4)]]
    assert find("abcxcba", "p1=3...3 1...1 <p1") == [[(0, 3), (3, 1), (4, 3)]]
    assert find("GGGGaaaaUCCU", "r1={au,ua,gc,cg,gu,ug} p1=4...4 4...4 r1~p1") == [[(0, 4), (4, 4), (8, 4)]]
    assert find("GGGGaaaaUCCU", "p1=4...4 4...4 ~p1") == [] and len(find("GGGGaaaaUCCU", "p1=4...4 4...4 ~p1[2,0,0]")) == 1
    assert find("ACGTttACGGTtt", "p1=ACGT 0...2 p1[0,0,1]") == [[(0, 4), (4, 2), (6, 5)]]
    assert find(None, "p1=3...4 p1") is None and find("", "p1=3...4 p1") == []
    for wrong in ("p1", "p1=3...4 p2", "r1~p1", "p1=^ p1", "p1=3...4 p1=3...4 p1", "p1=0...4 p1"):
        with pytest.raises(ValueError):
            patterns.elements(wrong)
    with pytest.raises(ValueError):
        patterns.as_regex("p1=3...4 p1")


def test_plain_patterns_tell_t_from_u(spark, tmp_path):
    rule = "r1={ee,nn,tt} p1=3...3 0...2 r1~p1"
    assert patterns.matches_in("ment. Une", rule) == [[(1, 3), (4, 2), (6, 3)]]
    assert patterns.matches_in("ment. Une", rule, plain=True) == []
    assert patterns.matches_in("ment. Tne", rule, plain=True) == [[(1, 3), (4, 2), (6, 3)]]
    assert patterns.matches_in("cactnt", "NT", plain=True) == [[(4, 2)]]
    texts = ["moment. Une", "moment. Tne", "xain. N\u0130Ax", "uatttau", "x", "", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    want = sorted(duck.execute(SQL["pattern_mirrored"]).fetchall())
    assert sorted(map(tuple, QUERIES["pattern_mirrored"](spark, str(tmp_path)).collect())) == want
    assert [at for _, at, _ in want] == [-1, 3, 1, -1, -1, -1, -1]


def test_patterns_from_alignments_match_all_rows(spark):
    dice = random.Random(6)
    pair = {"A": "U", "U": "A", "G": "C", "C": "G"}
    rows, masks_ = [], []
    for ali in range(25):
        n_stem, n_loop, n_tail = dice.randint(2, 5), dice.randint(3, 7), dice.randint(3, 6)
        tail = [dice.choice("ACGU") for _ in range(n_tail)]
        mask = "<" * n_stem + "." * n_loop + ">" * n_stem + "." * n_tail
        for _ in range(dice.randint(1, 6)):
            stem = [dice.choice("ACGU") for _ in range(n_stem)]
            other = [pair[c] if dice.random() > 0.15 else dice.choice("ACGU") for c in reversed(stem)]
            loop = [dice.choice("ACGU-") for _ in range(n_loop)]
            rows.append((f"a{ali}", "".join([*stem, *loop, *other, *(c if dice.random() > 0.1 else dice.choice("ACGU") for c in tail)])))
        masks_.append((f"a{ali}", mask))
    df = spark.createDataFrame([*rows, (None, "ACGU"), ("gone", None), ("gaps", "---")], "ali string, seq string")
    folded = alignment.mask_pairs(spark.createDataFrame(masks_, "ali string, mask string"), "ali", "mask")
    for pairs in (None, folded):
        made = {r["ali"]: r["pattern"] for r in alipatterns.patterns_from_alignments(df, "ali", "seq", pairs).collect()}
        assert set(made) == {*(a for a, _ in rows), "gaps"} and made["gaps"] is None
        if pairs is not None:
            assert sum("r1~p1" in (p or "") for p in made.values()) > 20
        for ali, seq in rows:
            text = seq.replace("-", "")
            if made[ali]:
                found = patterns.matches_in(text, f"^ {made[ali].replace(alipatterns.RULE, '')} $" if alipatterns.RULE not in made[ali] else f"{alipatterns.RULE} ^ {made[ali].removeprefix(alipatterns.RULE)} $")
                assert found, (ali, seq, made[ali])


def test_helices_are_apart_and_nested():
    assert alipatterns.helices([(0, 9), (1, 8), (2, 7)], set(range(10)), 2) == [(0, 9, 3)]
    assert alipatterns.helices([(0, 9), (1, 8), (2, 7)], set(range(10)) - {8}, 2) == []
    assert alipatterns.helices([(0, 5), (1, 4), (2, 9), (3, 8)], set(range(10)), 2) == [(0, 5, 2)]


@pytest.mark.parametrize(("members", "groups"), [(60, 100), (100, 50), (50, 75)])
def test_signature_words_equal_sets(spark, members, groups):
    dice = random.Random(7)
    rows = [(dice.choice(["x/1", "x/2", "y/1", "y/2", "z"]), i % 40, "".join(dice.choice("acgt") for _ in range(dice.randint(0, 14)))) for i in range(60)]
    rows += [("x/1", 1, "acgNNacg"), ("x/1", None, "acgt"), (None, 5, "acgt"), ("y/1", 7, None)]
    edges = [("x/1", "x"), ("x/2", "x"), ("y/1", "y"), ("y/2", "y"), ("x", "all"), ("y", "all"), ("all", None), ("z", None)]
    held = {}
    for g, m, s in rows:
        if g is not None and m is not None and s is not None:
            held.setdefault(g, {}).setdefault(m, set()).update(s[i : i + 3] for i in range(len(s) - 2) if set(s[i : i + 3]) <= set("acgt"))
    above = {g: [g, *({"x": ["x", "all"], "y": ["y", "all"]}.get(g[0], []))] for g in held}
    count = {g: {w: sum(w in ws for ws in ms.values()) for w in set().union(*ms.values())} for g, ms in held.items()}
    want = set()
    for node in {n for ns in above.values() for n in ns}:
        below = [g for g in held if node in above[g]]
        words = {w for g in below for w in count[g]}
        others = {w for g in held if g not in below for w in count[g]}
        for w in words:
            kept = sum(100 * count[g].get(w, 0) >= members * len(held[g]) for g in below)
            conserved, unique = 100 * kept >= groups * len(below) and kept > 0, w not in others
            if conserved or unique:
                want.add((node, w, conserved, unique))
    tree = spark.createDataFrame(edges, "node string, parent string")
    df = spark.createDataFrame(rows, "g string, m long, s string")
    found = masks.signature_words(df, "g", "m", "s", tree, hierarchy.closure(spark, tree), 3, "acgt", members, groups)
    assert {tuple(r) for r in found.collect()} == want
    assert masks.signature_words(df.limit(0), "g", "m", "s", tree, hierarchy.closure(spark, tree), 3, "acgt").count() == 0


def test_masks_over_many_buckets(spark):
    words = ["zzzz", "aaaa", "abcd", "zabc"]
    df = spark.createDataFrame([("k", w) for w in words], "key string, w string")
    letters = "abcdefghijklmnopqrstuvwxyz"
    numbers = df.select("key", F.explode(masks.word_numbers(F.col("w"), 4, letters)).alias("word"))
    made = masks.masks_of(numbers, "key")
    assert made.count() == 2
    back = masks.mask_words(made, "key").select(masks.word_of(F.col("word"), 4, letters).alias("w"))
    assert sorted(r["w"] for r in back.collect()) == sorted(words)
    less = masks.without(made, masks.masks_of(numbers.where(masks.word_of(F.col("word"), 4, letters) == "abcd"), "key"), "key")
    assert sorted(r["w"] for r in masks.mask_words(less, "key").select(masks.word_of(F.col("word"), 4, letters).alias("w")).collect()) == ["aaaa", "zabc", "zzzz"]


def test_contained_equals_all_pairs(spark):
    dice = random.Random(8)
    word = lambda n: "".join(dice.choice("abcé ") for _ in range(n))
    texts = [word(dice.randint(0, 400)) for _ in range(60)]
    for _ in range(120):
        host = dice.choice(texts)
        at = dice.randrange(len(host) + 1)
        part = host[at : at + dice.choice([1, 3, 10, 30, 46, 47, 48, 60, 200])]
        texts.append(part if dice.random() < 0.7 else edited(dice, part or "a", 1, "abc"))
    same = word(300)
    texts += [same] * 5 + [same[20:250]] * 4 + [same + word(5) for _ in range(8)] + ["aaaaaaaaaa" * 30, "a" * 299, "a" * 60, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "abc"), (999, None)]
    df = spark.createDataFrame(rows, "id long, s string").withColumn("contained", F.lit("mine")).withColumn("t", F.lit(1))
    first = {}
    for i, t in rows:
        if i is not None and t is not None:
            first[t] = min(first.get(t, i), i)
    want = sorted((i, any(t != u and t in u for u in first) or i > first[t]) for i, t in rows if i is not None and t is not None)
    assert sorted(map(tuple, containment.contained(df, "id", "s").collect())) == want
    assert sorted(r["id"] for r in containment.without_contained(df, "id", "s").collect()) == sorted(i for i, gone in want if not gone)
    assert containment.contained(df.limit(0), "id", "s").count() == 0
    assert containment.contained(spark.createDataFrame([(1, "")], "id long, s string"), "id", "s").collect()[0][1] is False


@pytest.mark.parametrize("bounds", [{"FILTER_BITS": 1 << 15, "MOST_BITS": 1 << 15, "BITS_A_KEY": 400}, {"ASKED": 1, "FEW": 0}])
def test_contained_with_small_bounds(spark, monkeypatch, bounds):
    """Bitmaps in several passes, and texts that ask for all of their minimizers; texts aren't written."""
    dice = random.Random(10)
    word = lambda n: "".join(dice.choice("abcdefgh ") for _ in range(n))
    lines = [word(120) for _ in range(3)]
    texts = [word(4000) for _ in range(150)]
    texts += [t[100:-200] for t in texts[:20]] + [t[50:90] for t in texts[20:40]] + [t[3:9] for t in texts[40:45]] + [word(40) for _ in range(20)]
    texts += ["".join(dice.choice(lines) for _ in range(8)) + word(60) for _ in range(30)] + lines
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    want = [(i, any(t != u and t in u for u in texts)) for i, t in enumerate(texts)]
    for name, value in bounds.items():
        monkeypatch.setattr(containment, name, value)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(x.stat().st_size for x in folder.rglob("part-*"))
    before = size()
    assert sorted(map(tuple, containment.contained(df, "id", "s").collect())) == want
    if "ASKED" in bounds:
        assert size() - before < sum(map(len, texts)) // 2


def test_minimizers_of_a_part_are_the_wholes():
    dice = np.random.default_rng(9)
    codes = dice.integers(97, 100, 500).astype(np.uint64)
    whole = set(zip(*(x.tolist() for x in containment.minimizers(codes)), strict=True))
    for at in range(0, 400, 13):
        hashed, places = containment.minimizers(codes[at : at + 90])
        assert len(places) and {(h, p + at) for h, p in zip(hashed.tolist(), places.tolist(), strict=True)} <= whole


def test_reverse_complement_of_codes_keeps_primers(spark):
    assert spark.range(1).select(reverse_complement(F.lit("ACGTRY"))).first()[0] == "RYACGT"
