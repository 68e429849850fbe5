"""Stacked alignments, merged clusters, Stockholm files and wiki pages against plain versions."""

import bz2
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from strandloom.operators import agglomerate, stacking
from strandloom.sources import sequences, stockholm, wiki


def plain_stack(seq, hits):
    """Rows of the query and its hits from dictionaries of (base or insertion) -> character."""
    cells = []
    for begin, q, s in [(0, seq, seq), *hits]:
        own, at, run = {}, begin, 0
        for x, y in zip(q, s, strict=True):
            if x == "-":
                run += 1
                own[at, run] = y
            else:
                own[at, float("inf")] = y
                at, run = at + 1, 0
        cells.append(own)
    columns = sorted({*itertools.chain(*cells), *((i, float("inf")) for i in range(len(seq)))})
    return ["".join(own.get(c, "-") for c in columns) for own in cells]


def test_stacked_rows_equal_plain_ones(spark):
    dice = random.Random(1)
    queries, hits, want = [], [], set()
    for q in range(30):
        seq = "".join(dice.choice("acgt") for _ in range(dice.randint(1, 15)))
        queries.append((q, seq))
        own = []
        for s in range(dice.randint(0, 6)):
            begin = dice.randrange(len(seq))
            part = seq[begin : dice.randint(begin + 1, len(seq))]
            x = "".join("-" * dice.choice([0, 0, 0, 1, 2]) + c for c in part) + "-" * dice.choice([0, 0, 1])
            own.append((begin, x, "".join(dice.choice("acgt-") for _ in x)))
            hits.append((q, f"s{s}", *own[-1]))
        rows = plain_stack(seq, own)
        want |= {(q, None, rows[0]), *((q, f"s{s}", r) for s, r in enumerate(rows[1:]))}
    odd = [(0, "x", None, "a", "a"), (0, "y", 0, "ac", "a"), (99, "z", 0, "a", "a"), (0, "w", 0, "a" * 40, "a" * 40), (None, "v", 0, "a", "a"), (0, "u", -1, "a", "a")]
    found = stacking.stacked(spark.createDataFrame([*queries, (None, "a"), (50, None)], "query long, seq string"), spark.createDataFrame([*hits, *odd], "query long, subject string, q_begin int, q_gapped string, s_gapped string"))
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(hits) + len(queries)


def plain_merges(ids, pairs, linkage, most, pad):
    known = {frozenset(p): d for p, d in pairs.items()}
    clusters, out = {i: [i] for i in ids}, []
    while True:
        best = None
        for a, b in itertools.combinations(sorted(clusters), 2):
            ds = [known.get(frozenset((x, y))) for x in clusters[a] for y in clusters[b]]
            if all(d is None for d in ds):
                continue
            full = [pad if d is None else d for d in ds]
            d = {"single": min(x for x in ds if x is not None), "complete": max(full), "average": sum(full) / len(full)}[linkage]
            if d <= most and (best is None or (round(d, 9), a, b) < best):
                best = (round(d, 9), a, b)
        if best is None:
            return out
        d, a, b = best
        clusters[a] += clusters.pop(b)
        out.append((a, b, d, len(clusters[a])))


@pytest.mark.parametrize("linkage", ["single", "complete", "average"])
def test_merges_equal_merging_one_by_one(spark, linkage):
    dice = random.Random(2)
    ids = [f"i{k:02d}" for k in range(24)]
    pairs = {p: dice.random() for p in itertools.combinations(ids, 2) if dice.random() < 0.4}
    rows = [(*(p if dice.random() < 0.5 else p[::-1]), d) for p, d in pairs.items()] + [("i00", "i00", 0.0), ("i01", None, 0.1), (*next(iter(pairs)), 5.0), ("i02", "i03", None)]
    df = spark.createDataFrame(rows, "a string, b string, distance double")
    tree = agglomerate.merges(df, linkage, 0.8, 1.0)
    want = plain_merges(ids, pairs, linkage, 0.8, 1.0)
    assert sorted((r["a"], r["b"], round(r["distance"], 9), r["size"]) for r in tree.collect()) == sorted(want)
    member = {i: i for i in ids}
    for a, b, _, _ in want:
        member = {i: a if c == b else c for i, c in member.items()}
    items = spark.createDataFrame([(i,) for i in [*ids, None]], "id string")
    assert {tuple(r) for r in agglomerate.groups(items, tree).collect()} == set(member.items())
    assert agglomerate.merges(df.limit(0), linkage).count() == 0 and agglomerate.groups(items.limit(0), agglomerate.merges(df.limit(0))).count() == 0


def test_rounds_are_few(spark):
    dice = random.Random(3)
    points = [dice.random() for _ in range(120)]
    rows = [(i, j, abs(points[i] - points[j])) for i, j in itertools.combinations(range(120), 2) if abs(points[i] - points[j]) < 0.2]
    tree = agglomerate.merges(spark.createDataFrame(rows, "a long, b long, distance double"), "single", 0.2).collect()
    assert max(r["round"] for r in tree) <= 20 and len(tree) >= 110
    with pytest.raises(ValueError):
        agglomerate.merges(spark.createDataFrame(rows, "a long, b long, distance double"), "median")


ONE = """# STOCKHOLM 1.0
#=GF ID one
#=GF CC first
#=GF CC second
#=GS r1 AC X.1

r1   ACG-
r2   AC--
#=GR r1 SS <.>.
#=GC SS_cons <..>

r1   TTT
r2   T-T
#=GC SS_cons ...
//
"""
TWO = "# STOCKHOLM 1.0\n#=GF AC two\nz.1/3-4 A\nr1 C\n//\n"


def test_stockholm_files_read_the_same_wherever_they_are_cut(spark, tmp_path):
    want = [("one", 0, "r1", "ACG-TTT"), ("one", 1, "r2", "AC--T-T"), ("two", 0, "z.1/3-4", "A"), ("two", 1, "r1", "C")]
    path = str(tmp_path / "a.sto")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for text in ("junk\n" + ONE + TWO + "\n\n", (ONE + TWO).replace("\n", "\r\n"), ONE + TWO.removesuffix("//\n")):
        (tmp_path / "a.sto").write_bytes(text.encode())
        for size in (17, 64, 100_000):
            try:
                spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
                spark.conf.set("spark.sql.files.openCostInBytes", "0")
                got = stockholm.read_stockholm(spark, path).select("name", "k", "id", "seq")
                assert sorted(map(tuple, got.collect())) == want, size
            finally:
                spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = stockholm.read_stockholm_features(spark, path).drop("n")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("one", "GF", None, "ID", "one"), ("one", "GF", None, "CC", "first second"), ("one", "GS", "r1", "AC", "X.1"), ("one", "GR", "r1", "SS", "<.>."), ("one", "GC", None, "SS_cons", "<..>..."), ("two", "GF", None, "AC", "two")], key=repr)
    (tmp_path / "empty.sto").write_text("")
    assert stockholm.read_stockholm(spark, str(tmp_path / "empty.sto")).count() == 0


@pytest.mark.parametrize("width", [None, 3])
def test_stockholm_round_trip(spark, tmp_path, width):
    rows = [("a", 2, "x", "ACGTACGT"), ("a", 1, "y y", "AC"), ("b", 1, "x", "-"), (None, 1, "x", "A"), ("c", 1, None, "A")]
    stockholm.write_stockholm(spark.createDataFrame(rows, "name string, o int, id string, seq string"), str(tmp_path / "out"), order="o", width=width)
    got = sorted(map(tuple, stockholm.read_stockholm(spark, str(tmp_path / "out")).select("name", "k", "id", "seq").collect()))
    assert got == [("a", 0, "y_y", "AC"), ("a", 1, "x", "ACGTACGT"), ("b", 0, "x", "-")]


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("{{a|{{b}}|c}}x", "x"), ("[[a|b]] [[c]] [[File:x.png|thumb|see [[d|e]]]] f", "b c f"), ("{| class=x\n|-\n| a {{t|}}\n|}\nend", "end"), ("== Head ==\n* item '''bold''' <ref name=a/>z<ref>q {{cite}}</ref>", "Head\nitem bold z"),
        ("open {{ not closed [[x", "open {{ not closed [[x"), ("a }} b ]] c |} d", "a }} b ]] c |} d"), ("[http://x.y label] http://z.w t &amp;lt; &nbsp;x", "label t &lt; x"), ("[[de:Haus]] [[:Category:X]] [[Category:Y]]", "Category:X"),
        ("{{{p|{{q}}}}}r", "r"), ("<!-- c -->d<math>x</math>e<br/>f __TOC__", "d e f"), ("{{a|b|}}c", "c"), ("{{x|[[a|b]]}} y {{#if:{{{1|}}}|z}}w", "y w"), ("{| {|\n|}\n|}z", "z"), ("x <!-- never closed", "x"), ("", ""), (None, None),
    ],
)
def test_wiki_markup(text, plain):
    assert wiki.plain_text(text) == plain


def test_wiki_markup_takes_linear_time_and_never_raises():
    began = time.time()
    for odd in ("{{" * 40_000, "[[" * 40_000, "{|" * 40_000, "{{a" * 20_000 + "}}" * 20_000, "|}" * 40_000, "<ref " * 20_000, "<!--" * 20_000, "[http://" * 20_000, "'" * 90_000, "= " * 40_000, "}}" * 40_000, "[[" * 20_000 + "}}" * 20_000):
        wiki.plain_text(odd)
    assert time.time() - began < 30
    dice = random.Random(4)
    for _ in range(2000):
        wiki.plain_text("".join(dice.choice(["{", "}", "|", "[", "]", "{{", "}}", "a", "[[", "]]", "<ref>", "</ref>", "'", "=", "\n", ":"]) for _ in range(40)))


def test_dumps_are_read_page_by_page(spark, tmp_path):
    page = lambda i, text: f"  <page>\n    <title>T&amp;{i}</title>\n    <ns>0</ns>\n    <id>{i}</id>\n    <revision>\n      <id>99</id>\n      <text bytes=\"3\" xml:space=\"preserve\">{text}</text>\n    </revision>\n  </page>\n"
    body = "<mediawiki>\n  <siteinfo><sitename>x</sitename></siteinfo>\n" + page(1, "[[a|b]] &lt;ref&gt;r&lt;/ref&gt;\nq") + page(2, "") + "<page><title>R</title><redirect title='x' /><text/></page>\n</mediawiki>\n"
    (tmp_path / "d.xml").write_text(body)
    (tmp_path / "e.xml.bz2").write_bytes(bz2.compress(body.encode()))
    for name in ("d.xml", "e.xml.bz2"):
        got = wiki.read_dump(spark, str(tmp_path / name)).withColumn("plain", wiki.without_markup(F.col("text")))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted([("T&1", 0, 1, False, "[[a|b]] <ref>r</ref>\nq", "b \nq".replace(" \n", "\n")), ("T&2", 0, 2, False, "", ""), ("R", None, None, True, "", "")], key=repr)


def test_mummer_matches_keep_their_headers(spark, tmp_path):
    (tmp_path / "m").write_text("> q1\n   10   1   20\n  40  22  8\r\n> q1 Reverse\n> q2  Len = 9\n  chr1  5  6  7\nnote\n")
    want = sorted([("q1", "+", None, 10, 1, 20), ("q1", "+", None, 40, 22, 8), ("q2", "+", "chr1", 5, 6, 7)], key=repr)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (5, 100_000):
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            assert sorted(map(tuple, sequences.read_mummer(spark, str(tmp_path / "m")).collect()), key=repr) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
