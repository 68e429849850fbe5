"""Operators 11 to 13 against plain versions, and on odd tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandloom.llm import clustering, collocations, tokencount
from strandloom.llm.queries import queries

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# -- 11 ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(PIECES)


def test_counts_equal_the_library(counter):
    dice = random.Random(5)
    letters = " ▁\n\tabcThequick<s></s>0x0A.,!?-'éßñ中日本語😀\x00 ﬁàеёЖ1234…“”()  ▁▁ ­"
    texts = ["".join(dice.choice(letters) for _ in range(dice.randint(0, 60))) for _ in range(4000)]
    texts += ["", " ", "  ", "▁", "\n", "a" * 5000, "word " * 3000, " " * 999, "<unk><s>", "ﬁ" * 70]
    assert counter.exact
    assert counter.counts(texts) == [len(ids) for ids in counter.library.encode(texts)]


def test_proven_pieces_are_one_token_in_any_place(counter):
    dice = random.Random(6)
    for piece in dice.sample(sorted(counter.proven), 2000):
        inside = f"\n{piece}\n" if piece[0] != tokencount.SPACE else f"x{piece}\n"
        assert piece in counter.library.encode(inside.replace(tokencount.SPACE, " "), out_type=str)
    assert len(counter.proven) > 30_000


def test_a_small_memo_gives_the_same(counter):
    small = tokencount.Counter(PIECES, memo=3)
    texts = ["zqxv wklt " + "q" * 200, "zqxv", None, "the of and", "zzzz yyyy xxxx wwww vvvv uuuu"]
    for _ in range(3):
        assert small.counts(texts) == [len(small.library.encode(t or "")) for t in texts]
        assert len(small.known) <= len(small.proven) + 3 + 8
    assert small.merged < small.looked_up
    for memo in (2, 5, 9):
        small, dice = tokencount.Counter(PIECES, memo=memo), random.Random(memo)
        for _ in range(40):
            texts = [" ".join(f"zq{dice.randint(0, 9)}xw" for _ in range(dice.randint(0, 4))) for _ in range(3)]
            assert small.counts(texts) == [len(small.library.encode(t)) for t in texts]


def test_token_counts_of_whole_documents(spark, counter):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries()["op11_tokencount"](spark, SF).collect():
        n = len(counter.library.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)


def test_token_counts_of_odd_tables(spark):
    rows = [(1, None, 5), (1, "a b", 6), (None, "", 7), (2, "a b", 8), (2, "a b", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    found = tokencount.count_tokens(df, PIECES)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r[0] or 0, r[1], r[2]) for r in found.collect()) == [(0, 0, 0), (1, 0, 0), (1, 3, 2), (2, 3, 2), (2, 3, 2)]
    assert tokencount.count_tokens(df.limit(0), PIECES).count() == 0


# -- 12 ----------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, components, scale):
    kept = [(key, [int(np.floor(scale * float(x))) for x in v]) for key, v in rows if v is not None and len(v) == components and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{key}".encode()).hexdigest(), v) for key, v in kept if key is not None)[:k]
    centroids = [v for _, v in order]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[i]) for x in zip(*members[i], strict=True)] if i in members else c for i, c in enumerate(centroids)]
    found = [(key, *nearest(v)[::-1]) for key, v in kept]
    sums = Counter()
    for _, c, d in found:
        sums[c] += d
    total = sum(sums.values())
    return sorted(((key, c, d, sums[c], total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for key, c, d in found), key=repr)


def test_clusters_equal_plain_ones(spark):
    dice = np.random.default_rng(3)
    rows = [(int(i), dice.normal(dice.integers(-3, 3), 1, 10).tolist()) for i in range(400)]
    rows += rows[:30] + [(None, rows[5][1]), (900, None), (901, []), (902, [1.0] * 9), (903, [float("nan")] * 10), (904, [None] + [1.0] * 9), (905, [float("inf")] * 10)]
    rows += [(1000 + i, [0.5] * 10) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit(1)).withColumn("norms", F.lit(2))
    found = clustering.cluster(df, k=7, rounds=4, components=10, segment=3)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_clusters(rows, 7, 4, 10, 256)


def test_screening_measures_less_and_ties_go_to_the_smaller_number():
    dice = np.random.default_rng(4)
    centroids = dice.integers(-500, 500, (40, 64))
    centroids[30] = centroids[7]
    vectors = np.concatenate([centroids[dice.integers(0, 40, 3000)] + dice.integers(-20, 20, (3000, 64)), dice.integers(-500, 500, (200, 64))])
    screen = clustering.Screen(centroids)
    cluster, distance = screen.nearest(vectors, clustering.segment_norms(vectors))
    exact = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert 30 not in cluster and screen.measured < screen.offered / 2


def test_clusters_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert clustering.cluster(spark.createDataFrame([], schema)).count() == 0
    assert clustering.cluster(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
    few = clustering.cluster(spark.createDataFrame([(1, [1.0] * 64), (2, [-1.0] * 64), (3, [1e30] * 64)], schema)).collect()
    assert sorted((r["vec_id"], r["distance"], r["inertia"]) for r in few) == [(1, 0, 0), (2, 0, 0)]


# -- 13 ----------------------------------------------------------------------------------------------


def plain_collocations(rows, least, first):
    f, n = {}, Counter()
    for lang, text in rows:
        its = f.setdefault(lang if lang is not None else "und", Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang if lang is not None else "und"] += len(words)
            its.update(words[i : i + m] for m in range(1, 5) for i in range(len(words) - m + 1))
    out = []
    for lang, its in f.items():
        often = {p: a for p, a in its.items() if a >= least and len(p) > 1}
        kept = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items()):
                continue
            score, _, l, r = min((2000000 * a // (its[p[:k]] + its[p[k:]]), k, its[p[:k]], its[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:first])]
    return sorted(out)


def odd_phrases():
    dice = random.Random(8)
    words = ["the", "The", "a", "a\x01", "a\x0eb", "b", "c-d", "é", "É", "\x00", "x\x1fy", "new", "york", "in", " "]
    rows = []
    for i in range(500):
        text = "".join(dice.choice(words) + dice.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", "]) for _ in range(dice.randint(0, 40)))
        rows.append((dice.choice(["en", "de", None, "und", "o\tdd\n"]), None if i % 50 == 0 else text))
    return rows + [("fr", "un deux trois quatre cinq")] * 12 + [("hot", "same same same same " * 300)]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_collocations_equal_plain_ones(spark, partitions):
    rows = odd_phrases()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit("x")).withColumn("phrase", F.lit(1)).repartition(5)
        found = collocations.collocations(df, least=4, first=60).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, found)) == plain_collocations(rows, 4, 60)


def test_prefix_counts_of_any_cut_add_up():
    dice = random.Random(2)
    rows = Counter()
    for _ in range(800):
        rows["\t".join(dice.choice("abc") for _ in range(dice.randint(1, 4)))] += dice.randint(1, 3)
    order = sorted(rows.items(), reverse=True)
    expected = Counter()
    for s, n in rows.items():
        words = s.split("\t")
        for k in range(1, len(words) + 1):
            expected["\t".join(words[:k])] += n

    def counts(part, least, batch):
        stack = collocations.Stack(least, 4)
        for at in range(0, len(part), batch):
            some = part[at : at + batch]
            yield from stack.batch(pa.array([s for s, _ in some], pa.string()), np.array([n for _, n in some]))
        yield from stack.end()

    for batch in (1, 2, 7, 1000):
        found = list(counts(order, 0, batch))
        assert dict(found) == expected and len(found) == len(expected)
        for cut in range(1, len(order), 7):
            parts = Counter()
            for part in (order[:cut], order[cut : cut + 1], order[cut + 1 :]):
                for p, n in counts(part, 20, batch):
                    parts[p] += n
            assert {k: n for k, n in parts.items() if n >= 20} == {k: n for k, n in expected.items() if n >= 20}


def test_counts_beyond_64_bits_stay_exact(spark):
    big = (1 << 62) - 1
    row = spark.range(1).select(F.lit(big).alias("a"), F.lit(big).alias("l"), F.lit(big + 1).alias("r"))
    score = row.select(F.expr("(2000000 * cast(a AS decimal(20,0))) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")).first()[0]
    assert score == 2000000 * big // (2 * big + 1)


def test_collocations_of_odd_tables(spark):
    schema = "lang string, text string"
    for rows in ([], [(None, None)], [("en", "")], [("en", ". , !")], [("en", "once only")]):
        assert collocations.collocations(spark.createDataFrame(rows, schema)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, "x y. " * 30), ("und", "x y")], schema)).collect()[0][:6] == ("und", 1, "x y", 31, 31, 31)
