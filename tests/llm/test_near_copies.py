"""Near copies: every path against brute force, recall on real documents, clashing columns."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import common, simhash


def table(spark, texts):
    rows = [(i, t, i, "x", 2.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, _key long, _md5 string, _row double").withColumn("node", F.lit(1)).withColumn("component", F.lit("c"))


def sets_of(texts):
    return [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for t in texts]


def brute(texts):
    """Smallest position of each group, by all pairs that share a shingle."""
    sets = sets_of(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    where: dict = {}
    for i, s in enumerate(sets):
        for x in s or [None]:
            where.setdefault(x, []).append(i)
    pairs = {p for at in where.values() for p in itertools.combinations(at, 2)}
    for i, j in pairs:
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return sorted({find(i) for i in range(len(texts))})


def families(dice, count, rates=(0, 1, 2, 2, 3, 4)):
    texts = []
    for f in range(count):
        base = [f"w{f}x{dice.randrange(500)}" for _ in range(dice.choice([8, 40, 100, 250]))]
        for rate in rates:
            other = list(base)
            for at in dice.sample(range(len(base)), min(rate * len(base) // 100 + (rate > 0), len(base))):
                other[at] = f"new{dice.random()}"
            texts.append(" ".join(other))
    return texts


@pytest.mark.parametrize("bounds", [{}, {"BUCKET_TEXTS": 3}, {"GROUP_TEXTS": 2}, {"BUCKET_TEXTS": 2, "GROUP_SHINGLES": 50}])
def test_every_path_finds_the_same(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(simhash, name, value)
    dice = random.Random(31)
    texts = families(dice, 12) + ["", " ", None, "one", "one", "ONE", "one two", "a b c d e", "a b c d e f"]
    kept = simhash.keep_one_near(table(spark, texts))
    assert kept.columns == table(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == brute(texts)


def test_recall_on_documents(spark):
    """All near pairs of different texts among these documents end in one component."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    texts = simhash.near_texts(docs)
    of = {r.md5: r.component for r in simhash.near_components(texts, docs).join(texts.select("node", "md5"), "node").select("md5", "component").collect()}
    import hashlib

    distinct = sorted({r.text or "" for r in rows})
    sets = sets_of(distinct)
    where: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    common_ones: dict = {}
    for at in where.values():
        if len(at) < 40:  # near pairs share some rare ones
            for p in itertools.combinations(at, 2):
                common_ones[p] = common_ones.get(p, 0) + 1
    near = [p for p in common_ones if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])]
    label = lambda i: of.get(hashlib.md5(distinct[i].encode()).hexdigest())
    found = sum(label(i) is not None and label(i) == label(j) for i, j in near)
    assert len(near) > 30 and found == len(near)


def test_variants_without_a_center(spark):
    """Hundreds of variants of one text of which no two are near copies: none is lost, none joins."""
    dice = random.Random(33)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(400):
        other = list(base)
        for at in dice.sample(range(100), 4):
            other[at] = f"new{i}x{at}"
        texts.append(" ".join(other))
    assert len(simhash.keep_one_near(table(spark, texts)).collect()) == len(brute(texts))


@pytest.mark.parametrize("bounds", [{"GROUP_TEXTS": 12}, {"GROUP_SHINGLES": 900}, {"GROUP_TEXTS": 4, "BLOCKS": 2}])
def test_large_groups_are_cut_into_blocks(spark, monkeypatch, bounds):
    """A family about the least similarity, larger than a step takes: all pairs of blocks, no rounds by buckets
    but for more blocks than ``BLOCKS``."""
    calls, links = [], simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda *a: calls.append(1) or links(*a))
    dice = random.Random(41)
    base = [f"w{i}" for i in range(100)]
    texts = ["", " ", *families(dice, 3)]
    for i in range(60):
        other = list(base)
        for at in dice.sample(range(100), dice.choice([1, 1, 1, 3])):
            other[at] = f"new{i}x{at}"
        texts.append(" ".join(other))
    kept = lambda: sorted(r.doc_id for r in simhash.keep_one_near(table(spark, texts)).collect())
    want = kept()  # all of a group in one step
    assert set(want) <= set(brute(texts)) and 10 < len(want) < 50 and not calls
    for name, value in bounds.items():
        monkeypatch.setattr(simhash, name, value)
    assert kept() == want
    assert bool(calls) == ("BLOCKS" in bounds)


def test_shared_shingles_are_counted():
    dice = np.random.default_rng(2)
    for size in (1, 2, 5, 300):
        sets = [np.unique(dice.integers(0, 150, dice.integers(0, 60)).astype(np.uint64) ** np.uint64(2)) for _ in range(size)]
        common = simhash.shared(np.array([len(x) for x in sets]), np.concatenate(sets))
        for i in dice.integers(0, size, 5):
            others = np.setdiff1d(dice.permutation(size)[: size // 2 + 1], i)
            assert common(i, others).tolist() == [len(np.intersect1d(sets[i], sets[j])) for j in others]


def test_reached_is_a_spanning_forest():
    dice = np.random.default_rng(1)
    for n in (0, 1, 2, 40):
        near = dice.random((n, n)) < 0.05
        near |= near.T
        i, j = simhash.reached(n, lambda x, others: near[x, others])
        root = list(range(n))
        for a, b in zip(*np.nonzero(near), strict=True):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
        assert len(i) == n - len(set(root)) and np.array_equal(simhash._roots(np.arange(n), i, j), np.array(root, int))


def test_groups_over_batches():
    values = [1, 1, 2, 3, 3, 3, 3, 4, 5, 5]
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_pydict({"g": values[at : at + size], "i": list(range(at, min(at + size, 10)))}) for at in range(0, 10, size)]
        out = list(common.sorted_groups(iter(batches), "g"))
        assert [x for b in out for x in b.column("i").to_pylist()] == list(range(10))
        seen = [set(b.column("g").to_pylist()) for b in out]
        assert all(not a & b for a, b in itertools.combinations(seen, 2))


def test_slices_are_bounded_by_bytes():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "b" * 100, "c", "d" * 60, ""]})
    got = [b.column("t").to_pylist() for b in common.slices(batch, 4, 64)]
    assert [x for b in got for x in b] == batch.column("t").to_pylist()
    assert all(len(b) == 1 or sum(len(x or "") for x in b) <= 64 for b in got) and max(map(len, got)) <= 4


def test_hot_keys_join_where_they_lie(spark):
    rows = common.durable(spark.range(3000).selectExpr("if(id < 2000, 7, id) AS k", "id"))
    named = common.durable(spark.range(2500).selectExpr("id AS k", "id * 2 AS v"))
    got = common.join_hot(rows, named, "k")
    assert got.count() == 2000 + 500 and got.where("v <> 2 * k").count() == 0 and got.where("k = 7").count() == 2000


@pytest.mark.parametrize("bounds", [{}, {"BUCKET_TEXTS": 2, "GROUP_TEXTS": 1}])
def test_fingerprints_link_near_copies(spark, monkeypatch, bounds):
    """Texts whose fingerprints link by the trie join are near copies under the similarity of others too, but
    not those that share a repeated line alone."""
    for name, value in bounds.items():
        monkeypatch.setattr(simhash, name, value)
    dice = random.Random(37)
    line = "the same line comes again and again "
    texts = []
    for f in range(3):  # a line that rules the bits, and tails of which two thirds are the same
        tail = [f"t{f}x{dice.random()}" for _ in range(60)]
        texts += [line * 400 + " ".join(tail), line * 400 + " ".join([*tail[:50], *(f"new{dice.random()}" for _ in range(10))])]
    prints = [simhash.fingerprint(simhash.shingle_hashes(t)) for t in texts]
    sets = sets_of(texts)
    for a, b in itertools.combinations(range(6), 2):
        alike = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        assert (prints[a] ^ prints[b]).bit_count() <= simhash.BUDGET and (0.5 < alike < 0.8 if a // 2 == b // 2 else alike < 0.5)
    assert brute(texts) == [*range(6)]
    assert sorted(r.doc_id for r in simhash.keep_one_near(table(spark, texts)).collect()) == [0, 2, 4]
