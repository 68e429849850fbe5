"""Read, pattern, cluster, taxonomy and file operators on small inputs and golden tables."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequence
from strandloom.operators import alignment, chimera, hierarchy, intervals, patterns, records, similarity
from strandloom.sources import flatfiles, sequences
from strandloom.streaming.dereplicate import windowed_counts

DATA = os.path.join(os.path.dirname(__file__), "data")


def profile_of(spark, name):
    rows = [x.rstrip("\n").split("\t") for x in open(f"{DATA}/{name}.tsv") if not x.startswith("#")]
    return {r[1]: float(r[0]) for r in rows}


# -- Profiles against published tables ---------------------------------------------------------------


@pytest.mark.parametrize("rank", ["phylum", "genus"])
def test_roll_up_equals_the_published_table(spark, rank):
    raw, want = profile_of(spark, f"profile.{rank}"), profile_of(spark, f"profile.{rank}.sum")
    paths = spark.createDataFrame([(p, s) for p, s in raw.items()], "node string, score double")
    nodes = hierarchy.nodes_from_paths(paths.select(F.col("node").alias("path")), "path", "; ").select("node", "parent")
    rolled = {r.node: r.score for r in hierarchy.roll_up(paths, hierarchy.closure(spark, nodes)).collect()}
    assert {k: rolled[k] for k in want} == want and len(want) >= len(raw)


@pytest.mark.parametrize("rank", ["phylum", "genus"])
def test_normalised_equals_the_published_table(spark, rank):
    raw, want = profile_of(spark, f"profile.{rank}"), profile_of(spark, f"profile.{rank}.norm")
    table = spark.createDataFrame([("PCR", p, s) for p, s in raw.items()], "sample string, node string, score double")
    got = {r.node: r.score for r in hierarchy.normalised(table, "sample", "score").collect()}
    assert set(want) <= set(got) and all(abs(got[k] - v) <= 1.5 for k, v in want.items())


def test_scores_of_hits_on_a_small_tree(spark):
    edges = [("root", None, 0), ("A", "root", 1), ("B", "root", 1), ("a1", "A", 2), ("a2", "A", 2), ("x", "a1", 3), ("y", "a1", 3), ("z", "a2", 3), ("w", "B", 2)]
    nodes = spark.createDataFrame(edges, "node string, parent string, depth int")
    up = hierarchy.closure(spark, nodes)
    reads = {"one": ["x"], "two": ["x", "y"], "cousins": ["x", "z"], "three": ["x", "y", "z"], "far": ["x", "w"], "lost": ["nowhere"]}
    hits = spark.createDataFrame([(r, n, 6) for r, ns in reads.items() for n in ns for _ in range(2)], "read string, node string, reads int")
    got = {}
    for r in hierarchy.score_hits(hits, nodes, up, most_span=2).collect():
        got.setdefault(r.read, {})[r.node] = r.score
    # Two hits under one parent are clipped to it; the cousins stay, as each is its parent's only child.
    assert got == {"one": {"x": 6.0}, "two": {"a1": 6.0}, "cousins": {"x": 3.0, "z": 3.0}, "three": {"a1": 4.0, "z": 2.0}, "far": {None: 6.0}, "lost": {None: 6.0}}
    strict = {r.read: r.node for r in hierarchy.score_hits(hits, nodes, up, most_span=0).collect()}
    assert strict["cousins"] is None and strict["two"] == "a1" and hierarchy.score_hits(hits.limit(0), nodes, up).count() == 0


def test_closure_of_deep_trees_and_cycles(spark):
    chain = spark.range(300).selectExpr("cast(id AS string) AS node", "if(id = 0, NULL, cast(id - 1 AS string)) AS parent")
    got = hierarchy.closure(spark, chain)
    assert got.count() == 300 * 301 // 2 and got.where("node = '299' AND ancestor = '0'").first().dist == 299
    odd = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "c"), (None, "a"), ("e", None)], "node string, parent string")
    found = {(r.node, r.ancestor): r.dist for r in hierarchy.closure(spark, odd).collect()}
    assert found["a", "c"] == 2 and found["d", "b"] == 2 and found["d", "c"] == 1 and found["e", "e"] == 0 and len(found) == 9 + 4 + 1
    assert hierarchy.closure(spark, odd.limit(0)).count() == 0


def test_shown_path_and_filters(spark):
    t = spark.createDataFrame([("d__B; p__; c__x; g__; s__", 1, None), ("d__B", 0, 0)], "p string, a int, b int")
    assert [r.x for r in t.select(hierarchy.shown_path(F.col("p")).alias("x")).collect()] == ["d__B; p__; c__x", "d__B"]
    assert hierarchy.filter_profile(t, ["a", "b"], 1, 1).count() == 1 and hierarchy.filter_profile(t, ["a"]).count() == 2


# -- Reads -------------------------------------------------------------------------------------------


def test_mates_merge_by_quality(spark):
    whole = "ACGTTGCAAC"
    mate2 = "".join({"A": "T", "C": "G", "G": "C", "T": "A"}[c] for c in reversed(whole[4:]))
    rows = [(whole[:7], "IIIII!5", mate2, "I!I5I!"), ("AAAA", "IIII", "CCCC", "IIII"), (None, None, "A", "I"), ("", "", "", "")]
    got = records.merge_mate_reads(spark.createDataFrame(rows, "s string, q string, t string, u string"), "s", "q", "t", "u", 3, 1.0).collect()
    # Mate 2 turned has the qualities !I5I!I; in the overlap I > !, ! < I and 5 = 5 (mate 2's).
    assert (got[0].overlap, got[0]["seq"], got[0]["qual"], got[0].seq_break) == (3, whole, "IIIIII5I!I", -1)
    assert (got[1].overlap, got[1]["seq"], got[1].seq_break) == (0, "AAAAGGGG", 4) and got[2]["seq"] is None and got[3]["seq"] == ""


def test_best_quality_counts_in_overlaps(spark):
    rows = [("AAC", "II!", "CCT", "!5I")]  # mate 2 turned: AGG with I5!
    r = records.merge_mate_reads(spark.createDataFrame(rows, "s string, q string, t string, u string"), "s", "q", "t", "u", 2, 0.5).first()
    assert (r.overlap, r["seq"], r["qual"]) == (2, "AAGG", "II5!")


def test_quality_trims_mirror_each_other(spark):
    t = spark.createDataFrame([("abcdefgh", [5] * 3 + [30] * 5), ("ab", [30, 30]), ("abcd", [2] * 4), (None, None)], "seq string, q array<int>")
    assert sorted(str(r.seq) for r in records.trim_quality_start(t, "seq", "q", 3, 3).collect()) == ["", "", "None", "defgh"]
    r = spark.createDataFrame([("ACGTAA", "x")], "seq string, y string")
    assert records.trim_probe_start(r, "seq", "TTACG", 2, 1.0).first().seq == "TAA" and records.trim_probe_end(r, "seq", "AAC", 2, 1.0).first().seq == "ACGT"


def test_clips_take_the_last_and_the_first_match(spark):
    t = spark.createDataFrame([("xABxAByyyyyyyyyyyyyy",), ("yyyyyyyyyyyyyABxABx",), ("none",), (None,)], "s string")
    got = lambda df: [r.s for r in df.collect()]
    assert got(records.clip_start(t, "s", "AB", 8)) == ["y" * 14, "y" * 13 + "ABxABx", "none", None]
    assert got(records.clip_start(t, "s", "AB", 8, keep_match=True))[0] == "ABxAB" + "y" * 14 and got(records.clip_start(t, "s", "AB", 5))[0] == "xABxAB" + "y" * 14
    assert got(records.clip_end(t, "s", "AB", 8)) == ["xABxAB" + "y" * 14, "y" * 13, "none", None] and got(records.clip_end(t, "s", "AB", 8, keep_match=True))[1] == "y" * 13 + "AB"
    for name, pattern in (("clip_pattern_start", "AB"), ("clip_pattern_end", "AB")):
        f = getattr(patterns, name)
        plain = records.clip_start if name.endswith("start") else records.clip_end
        for keep in (False, True):
            assert got(f(t, "s", pattern, 8, keep)) == got(plain(t, "s", "AB", 8, keep))


def test_barcodes(spark):
    tags = spark.createDataFrame([("AC", "s1"), ("ACG", "s2"), ("AC", "s0"), ("", "no"), (None, "no")], "tag string, sample string")
    rows = [(1, "TTACGPR", 5, [30] * 7), (2, "ACPR", 2, [30, 2, 30, 30]), (3, "APR", 1, [30] * 3), (4, "GGGGPR", 4, [30] * 6), (5, "ACxPR", 3, [30] * 5), (6, "nothing", None, [30] * 7)]
    reads = spark.createDataFrame(rows, "id int, seq string, at int, q array<int>")
    got = {r.id: (r["sample"], r.outcome) for r in records.match_barcodes(reads, "seq", "at", tags, 1, "q", 20).collect()}
    assert got == {1: ("s2", "ACG"), 2: (None, "low-quality"), 3: (None, "no-room"), 4: (None, "no-barcode"), 5: ("s0", "AC"), 6: (None, None)}
    assert {r.seq: r["sample"] for r in records.demultiplex(reads, "seq", tags).collect()} == {"TTACGPR": None, "ACPR": "s0", "APR": None, "GGGGPR": None, "ACxPR": "s0", "nothing": None}
    pairs = spark.createDataFrame([("a", "b", "s"), ("a", "b", "r")], "f_tag string, r_tag string, sample string")
    both = spark.createDataFrame([("a", "b"), ("b", "a"), (None, "b")], "f string, r string")
    assert [r["sample"] for r in records.pair_samples(both, "f", "r", pairs).orderBy("f", "r").collect()] == [None, "r", None]


def test_even_samples(spark):
    rows = [(i, "g" if i < 17 else None) for i in range(22)] + [(99, "h")]
    got = records.even_sample(spark.createDataFrame(rows, "k int, g string"), "g", ["k"], 5).collect()
    assert sorted((str(r.g), r.k) for r in got) == sorted([("g", i * 17 // 5) for i in range(5)] + [("None", 17 + i) for i in range(5)])


def test_dereplication_of_long_and_null_texts(spark):
    t = spark.createDataFrame([(3, "a" * 9000), (1, "a" * 9000), (2, None), (4, "")], "id int, s string")
    assert sorted((r.id, r.seq_count) for r in records.dereplicate(t, "s", "id").collect()) == [(1, 2), (4, 1)]


def test_words_of_any_text(spark):
    texts = ["abcd", "ab", "", "a𝔘bc𝔙", "é日本x"]
    t = spark.createDataFrame([(x,) for x in texts], "s string")
    got = [r.w for r in t.select(sequence.words(F.col("s"), 3).alias("w")).collect()]
    assert got == [[x[i : i + 3] for i in range(len(x) - 2)] for x in texts]
    assert t.select(F.size(sequence.kmers(F.lit("AACGTNAC"), 2, only="ACGT")).alias("n")).first().n == 4


# -- Patterns ----------------------------------------------------------------------------------------


def brute_matches(text, bases, m, d, i):
    """Ends of approximate matches at each place, by edits with the reference's kinds of error."""
    out = {}
    for at in range(len(text)):
        for end in range(at + 1, len(text) + 1):
            piece = text[at:end]
            best = {}

            def go(k, j, left):
                if k == len(bases):
                    if j == len(piece):
                        best[0] = min(best.get(0, 99), m + d + i - sum(left))
                    return
                a, b, c = left
                if j < len(piece):
                    if piece[j] in patterns.CODES.get(bases[k], bases[k]):
                        go(k + 1, j + 1, left)
                    elif a:
                        go(k + 1, j + 1, (a - 1, b, c))
                    if c and k:
                        go(k, j + 1, (a, b, c - 1))
                if b:
                    go(k + 1, j, (a, b - 1, c))

            go(0, 0, (m, d, i))
            if best:
                out.setdefault(at, []).append((best[0], end))
    return {k: min(v) for k, v in out.items()}


def test_patterns_by_brute_force():
    dice = random.Random(6)
    for _ in range(200):
        text = "".join(dice.choice("ACGT") for _ in range(dice.randint(0, 12)))
        bases = "".join(dice.choice("ACGTRN") for _ in range(dice.randint(2, 4)))
        m, d, i = dice.randint(0, 1), dice.randint(0, 1), dice.randint(0, 1)
        best = brute_matches(text, bases, m, d, i)
        want, at = [], 0
        while at < len(text):
            if at in best:
                want.append((at, best[at][1] - at))
                at = best[at][1]
            else:
                at += 1
        assert [x[0] for x in patterns.matches_in(text, f"{bases}[{m},{d},{i}]")] == want, (text, bases, m, d, i)


def test_pattern_elements(spark):
    assert patterns.matches_in("GGACTTTGTC", "^ GG 2...4 TT[0,0,0]") == [[(0, 0), (0, 2), (2, 2), (4, 2)]]
    assert patterns.matches_in("GGAC", "AC $") == [[(2, 2), (4, 0)]] and patterns.matches_in("GACG", "AC $") == [] and patterns.matches_in(None, "A") is None
    with pytest.raises(ValueError):
        patterns.elements("3...4")
    t = spark.createDataFrame([("ttACGTgg",), ("cccc",), (None,)], "s string")
    assert [r.s for r in patterns.extract_elements(t, "s", "TT AC GT", [1, 3]).collect()] == ["ttGT"]
    assert [r.s for r in patterns.extract_elements(t, "s", "TT AC GT", [2], complement=True).collect()] == ["GT"]
    assert [r.s for r in patterns.remove_pattern(t, "s", "ACGT").collect()] == ["ttgg", "cccc", None]
    assert [r.s for r in patterns.filter_pattern(t, "s", "ACG").collect()] == ["ttACGTgg"] and patterns.filter_pattern(t, "s", "GGGG", reverse=True).count() == 1


# -- Chimeras, clusters, alignments, chains ----------------------------------------------------------


def test_a_planted_chimera_is_found_at_its_join(spark):
    dice = random.Random(9)
    refs = ["".join(dice.choice("ACGT") for _ in range(400)) for _ in range(6)]
    reads = [(1, refs[0][:200] + refs[3][200:]), (2, refs[1]), (3, refs[2][50:350]), (4, "ACGT"), (None, refs[0]), (5, "N" * 100)]
    got = {r.read: r for r in chimera.chimera_scores(spark.createDataFrame(reads, "id long, seq string"), spark.createDataFrame(list(enumerate(refs)), "id long, seq string")).collect()}
    assert sorted(got) == [1, 2, 3, 5] and abs(got[1].position - 200) <= 12 and (got[1].left_ref, got[1].right_ref) == (0, 3)
    assert got[1].score > 100 > max(got[2].score, got[3].score) and got[5].left_ref is None and got[1].left_pct > 95
    kept = chimera.not_chimeric(spark.createDataFrame(reads, "id long, seq string"), spark.createDataFrame(list(got.values())), 100)
    assert sorted(str(r.id) for r in kept.collect()) == ["2", "3", "4", "5", "None"]


def test_similarity_options(spark):
    q = spark.createDataFrame([(1, "ACGTACCATGCA", [30] * 12), (2, "TGCATGGTACGT", [30] * 6 + [2] * 6), (None, "ACGTACCATGCA", None)], "id long, seq string, values array<int>")
    r = spark.createDataFrame([(1, "ACGTACCATGCA"), (7, "TTTTTTTTTT"), (8, "ACGTNCCATGCA")], "id long, seq string")
    got = {(x.qid, x.rid, x.strand): x.pct for x in similarity.similarities(q, r, k=4, least=50.0, top_range=100.0, strands="+-").collect()}
    assert got[1, 1, "+"] == 100.0 and got[2, 1, "-"] == 100.0
    assert (1, 1) not in {(x.qid, x.rid) for x in similarity.similarities(q, r, k=4, least=10.0, top_range=100.0, with_self=False).collect()}
    assert {x.rid: x.shared for x in similarity.similarities(q.where("id = 1"), r, k=4, least=1.0, top_range=100.0, only="ACGTU").collect()} == {1: 9, 8: 5}
    masked = similarity.similarities(q.where("id = 2"), r, k=4, least=1.0, top_range=100.0, strands="-", only="ACGTU", least_quality=20.0).collect()
    assert [(x.rid, x.shared) for x in masked if x.rid == 1] == [(1, 3)]
    # Of both strands the better one counts, + if they are equal; other characters can be read as a base.
    both = similarity.similarities(q, r, k=4, least=1.0, top_range=100.0, strands="+-").collect()
    assert len({(x.qid, x.rid) for x in both}) == len(both)
    own = spark.createDataFrame([(5, "ACGTACGT")], "id long, seq string")
    assert [(x.strand, x.pct) for x in similarity.similarities(own, own, k=4, strands="+-").collect()] == [("+", 100.0)]
    assert {x.rid: x.pct for x in similarity.similarities(q.where("id = 1"), r, k=4, least=1.0, top_range=100.0, others_as="A").collect()} == {1: 100.0, 8: 100.0}
    hot = spark.createDataFrame([(i, "ACGTACCATGCA") for i in range(100)], "id long, seq string")
    assert similarity.similarities(hot, hot, k=8, least=100.0).count() == 10_000


def test_clusters_are_those_of_going_through_by_weight(spark):
    dice = random.Random(10)
    for _ in range(3):
        items = [(i, dice.randint(1, 4)) for i in range(40)] + [(7, 1), (None, 3)]
        pairs = [tuple(dice.sample(range(40), 2)) for _ in range(60)] + [(3, 3), (1, 99), (None, 2)]
        near = {frozenset(p) for p in pairs if None not in p and len(set(p)) == 2}
        weight = {}
        for i, w in items:
            if i is not None:
                weight[i] = max(weight.get(i, 0), w)
        seeds, want = [], {}
        for i in sorted(weight, key=lambda x: (-weight[x], x)):
            of = next((s for s in seeds if frozenset((s, i)) in near), i)
            want[i] = of
            if of == i:
                seeds.append(i)
        got = {r.id: r.seed for r in similarity.greedy_clusters(spark.createDataFrame(pairs, "a int, b int"), spark.createDataFrame(items, "id int, weight int")).collect()}
        assert got == want


def test_alignment_columns(spark):
    t = spark.createDataFrame([("x", "A-C-G"), ("x", "A-T-."), ("y", "--"), (None, "-A"), ("x", None)], "ali string, seq string")
    got = sorted((str(r.ali), str(r.seq)) for r in alignment.without_gap_columns(t, "ali", "seq").collect())
    assert got == sorted([("x", "ACG"), ("x", "AT."), ("y", ""), ("None", "A"), ("x", "None")])
    assert alignment.sub_alignment(t.limit(1), "seq", [(0, 1), (4, 4)]).first().seq == "A-G"
    assert [(r.column, r.position) for r in alignment.to_sequence_positions(t.limit(1), "ali", "seq").collect()] == [(0, 0), (2, 1), (4, 2)]
    pairs = spark.createDataFrame([("x", 0, 4)], "ali string, beg int, end int")
    assert [(r.base1, r.base2, r.n) for r in alignment.pair_counts(t, "ali", "seq", pairs).collect()] == [("A", "G", 1)]
    assert t.limit(1).select(alignment.expand_codes(F.lit("ARx")).alias("e")).first().e == ["A", "AG", "x"]


def test_rectangles_and_next(spark):
    t = spark.createDataFrame([(0, 2, 0, 2, 2, 3, 2, 3), (0, 1, 0, 1, 2, 3, 0, 1)], "a int, b int, c int, d int, e int, f int, g int, h int")
    assert [r.x for r in t.select(intervals.rectangles_overlap(("a", "b", "c", "d"), ("e", "f", "g", "h")).alias("x")).collect()] == [True, False]
    assert [r.x for r in t.select(intervals.lies_within("e", "f", "a", "f").alias("x")).collect()] == [True, True]
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 35), (3, "v", 99)], "k long, g string, at long")
    right = spark.createDataFrame([("u", 5, 1), ("u", 12, 7), ("u", 80, 9), ("u", 80, 8), ("v", 10, 2)], "g string, at long, x long")
    assert {r.k: (r.found_at, r.found) for r in intervals.as_of_next(left, right, "k", "g", "at", "x", 10).collect()} == {1: (5, 1), 2: (80, 8), 3: (None, None)}


def test_valley_by_hand():
    left, right = np.array([0, 0, 0, 0, 1, 2, 3, 4]), np.array([4, 3, 2, 1, 0, 0, 0, 0])
    v = chimera.valley(left, right, 4, 8)
    assert v["join"] == 3 and v["score"] > 0 and chimera.valley(left, right, 4, 80)["score"] == 0
    flat = np.zeros(5, int)
    assert chimera.valley(flat, flat, 4, 4)["score"] == 0
    for n in range(1, 5):  # no read is too short
        for l, r in itertools.product(itertools.product(range(2), repeat=n), repeat=2):
            chimera.valley(np.array(l), np.array(r), 4, 4)


# -- Files -------------------------------------------------------------------------------------------

GENBANK = """LOCUS       AB000001     12 bp    DNA     linear   BCT 01-JAN-2000\r
DEFINITION  A gene of\r
            some kind.\r
ACCESSION   AB000001\r
SOURCE      x\r
  ORGANISM  Genus species\r
            Bacteria; Phylum;\r
            Genus.\r
ORIGIN      \r
        1 acgtacgtac gt\r
//\r
LOCUS       EMPTY 0 bp
//
"""
EMBL = """ID   X56734; SV 1; linear; mRNA; STD; PLN; 20 BP.
AC   X56734; S46826;
DE   Trifolium mRNA
DE   for a protein
KW   one; two words.
OS   Trifolium repens
OC   Eukaryota; Plants;
OC   Trifolium.
FT   source          1..20
FT                   /organism="Trifolium
FT                   repens"
FT   CDS             join(1..5,
FT                   8..12)
FT                   /gene="x"
SQ   Sequence 20 BP;
     aaacaaacca aatatggatt                                              20
//
"""
UNIPROT = """ID   CYC_BOVIN  Reviewed; 10 AA.
AC   P62894; P00006;
DE   RecName: Full=Cytochrome c;
DE            EC=1.2.3.4;
GN   Name=CYCS;
OS   Bos taurus (Bovine).
OC   Eukaryota; Metazoa.
OX   NCBI_TaxID=9913;
DR   EMBL; X1; Y1; -; mRNA.
DR   GO; GO:0005; C:mitochondrion; IEA.
SQ   SEQUENCE   10 AA;  1 MW;  A CRC64;
     MGDVEKGKKI
//
"""
OBO = """format-version: 1.2

[Term]
id: GO:1
name: root
def: "All of it." [x]

[Term]
id: GO:2
name: part
synonym: "piece" EXACT []
is_a: GO:1 ! root
relationship: part_of GO:1 ! root

[Typedef]
id: part_of

[Term]
id: GO:3
name: gone
is_obsolete: true
"""


def test_flat_files(spark, tmp_path):
    for name, text in (("gb", GENBANK), ("embl", EMBL), ("sprot", UNIPROT), ("obo", OBO), ("none", "")):
        (tmp_path / name).write_bytes(text.encode())
    gb = flatfiles.read_genbank(spark, str(tmp_path / "gb")).collect()
    assert (gb[0].id, gb[0].accession, gb[0].definition, gb[0].organism, gb[0].taxonomy, gb[0].seq) == ("AB000001", "AB000001", "A gene of some kind.", "Genus species", ["Bacteria", "Phylum", "Genus"], "ACGTACGTACGT")
    assert (gb[1].id, gb[1].organism, gb[1].taxonomy, gb[1].seq) == ("EMPTY", None, [], "") and len(gb) == 2
    e = flatfiles.read_embl(spark, str(tmp_path / "embl")).first()
    assert (e.id, e.accessions, e.description, e.keywords, e.organism, e.taxonomy, e.seq) == ("X56734", ["X56734", "S46826"], "Trifolium mRNA for a protein", ["one", "two words"], "Trifolium repens", ["Eukaryota", "Plants", "Trifolium"], "AAACAAACCAAATATGGATT")
    assert [(f.type, f.location, f.qualifiers) for f in e.features] == [("source", "1..20", '/organism="Trifolium repens"'), ("CDS", "join(1..5,8..12)", '/gene="x"')]
    u = flatfiles.read_uniprot(spark, str(tmp_path / "sprot")).first()
    assert (u.id, u.accessions, u.name, u.organism, u.tax_id, u.ec_numbers, u.seq) == ("CYC_BOVIN", ["P62894", "P00006"], "Cytochrome c", "Bos taurus (Bovine)", 9913, ["1.2.3.4"], "MGDVEKGKKI")
    assert [tuple(x) for x in u.references] == [("EMBL", "X1"), ("GO", "GO:0005")]
    terms = {t.id: t for t in flatfiles.read_ontology(spark, str(tmp_path / "obo")).collect()}
    assert sorted(terms) == ["GO:1", "GO:2", "GO:3"] and terms["GO:1"].definition == "All of it." and terms["GO:3"].obsolete and terms["GO:2"].synonyms == ["piece"]
    assert [tuple(p) for p in terms["GO:2"].parents] == [("is_a", "GO:1"), ("part_of", "GO:1")]
    for read in (flatfiles.read_genbank, flatfiles.read_embl, flatfiles.read_uniprot, flatfiles.read_ontology):
        assert read(spark, str(tmp_path / "none")).count() == 0
    kinds = [flatfiles.detect_format(spark, str(tmp_path / n)) for n in ("gb", "embl", "obo", "none")]
    assert kinds == ["genbank", "embl", "obo", None]


def test_taxonomy_dumps_and_tables(spark, tmp_path):
    (tmp_path / "nodes").write_text("1\t|\t1\t|\tno rank\t|\t\t|\n2\t|\t1\t|\tphylum\t|\tx\t|\n")
    (tmp_path / "names").write_text("2\t|\tBact\t|\t\t|\tscientific name\t|\n")
    assert [tuple(r) for r in flatfiles.read_tax_nodes(spark, str(tmp_path / "nodes")).collect()] == [(1, None, "no rank"), (2, 1, "phylum")]
    assert [tuple(r) for r in flatfiles.read_tax_names(spark, str(tmp_path / "names")).collect()] == [(2, "Bact", None, "scientific name")]
    (tmp_path / "tags").write_text("# ID\tF-tag\tnote\r\na\tac gt\tx\r\n\r\nb\tTT\t\r\n# end\r\n")
    assert [tuple(r) for r in flatfiles.read_tags(spark, str(tmp_path / "tags")).collect()] == [("a", "ACGT", None), ("b", "TT", None)]
    (tmp_path / "bad").write_text("ID\tF-tag\na\tA\na\tC\n")
    with pytest.raises(ValueError, match="repeated"):
        flatfiles.read_tags(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="lacks"):
        flatfiles.read_table(spark, str(tmp_path / "bad"), ["R-tag"])
    (tmp_path / "short").write_text("ID\tx\na\n")
    assert flatfiles.read_table(spark, str(tmp_path / "short"), ["ID"], strict=False).first().x is None
    with pytest.raises(Exception, match="wrong number of fields"):
        flatfiles.read_table(spark, str(tmp_path / "short"), ["ID"]).collect()
    hits = spark.createDataFrame([("q", 9, "a", 98.0), ("q", 9, "b", 99.5)], "qid string, n_oligos int, rid string, pct double")
    flatfiles.write_similarities(hits, str(tmp_path / "sims"))
    assert [(r.qid, r.n_oligos, [tuple(x) for x in r.sims]) for r in sequences.read_similarities(spark, str(tmp_path / "sims")).collect()] == [("q", 9, [("b", 99.5), ("a", 98.0)])]
    flatfiles.write_table(hits.coalesce(1), str(tmp_path / "t"))
    assert flatfiles.read_table(spark, str(tmp_path / "t"), ["qid", "pct"]).count() == 2


def test_fasta_with_carriage_returns(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">r1 x\r\nAC\r\nGT\r\n>r2\r\nTT\r\n")
    assert [tuple(r) for r in sequences.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("id").collect()] == [("r1", "x", "ACGT"), ("r2", None, "TT")]


def test_windowed_stream(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 01:00:00", "a"), (2, "2024-01-01 02:00:00", "a"), (3, "2024-01-09 00:00:00", "b")], "id long, t string, l string").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, t timestamp, l string").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "t", "l").writeStream.format("memory").queryName("windowed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.l, r.n) for r in spark.table("windowed").collect()] == [("a", 2)]
