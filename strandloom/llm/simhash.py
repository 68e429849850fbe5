"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: words are shingled, each shingle hashed by XXH64, and a bit of the fingerprint is set
if it is set in more than half of the hashes. Two fingerprints link if they differ in at most
``budget`` bits.

The join walks a binary trie of the distinct fingerprints against itself: from a pair of nodes to
the pairs of their children, adding up the bits in which the paths differ and dropping a pair once
they exceed the budget. To spread the work, the 64 bits are cut into budget + 2 blocks. Linked
fingerprints agree in at least two of them, so for each choice of two blocks there is a trie with
these blocks as its first levels, and the subtrees below are shared out by their path. A subtree of
over ``most`` fingerprints is cut again: of its free bits, split into budget + 1 blocks, linked
fingerprints agree in one, which gives smaller subtrees, and so on. After three cuts at most 15 bits
are free with a budget of 2, so no task ever holds more than 32,768 fingerprints of a subtree.

Edge cases. A null text, an empty one and one of white space only have the fingerprint zero, which
links like any other. Fewer words than a shingle has: the whole sequence is the only shingle. A null
doc_id is a row like others and is smaller than none: a component's id is the smallest non-null one.
Repeated rows stay. Extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, join_hot, map_lists, sorted_groups

WORDS = 3
BUDGET = 2
SEED = 42
#: Fingerprints of a subtree that one step of the join takes.
MOST = 4096
#: Near copies: words of a shingle, least Jaccard similarity, bands of MinHash values and values of each.
NEAR_WORDS = 5
SIMILARITY = 0.8
#: The least similarity of texts whose fingerprints link. A line that is repeated often fixes all bits of
#: fingerprints; texts that share little else are no copies.
LINKED_SIMILARITY = 0.5
BANDS, ROWS = 24, 5
#: The least share of equal values that two texts of the least similarity have, five standard deviations
#: under it.
ESTIMATE = SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / (BANDS * ROWS)) ** 0.5
#: Texts of a bucket that one step compares, and texts and shingles of a group that one step verifies.
#: What is larger is cut up, see ``grouped`` and ``near_links``.
BUCKET_TEXTS, GROUP_TEXTS, GROUP_SHINGLES = 4096, 8192, 1 << 22
#: Blocks of a group, each two of which are a step.
BLOCKS = 64
#: Of buckets cut up, the pairs for each row up to which all are compared.
PAIRS_A_ROW = 8
SALTS, FACTORS = np.random.default_rng(SEED).integers(1, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.uint64(1)
#: Where the counts of a byte's values begin, and the values' bits.
BYTES = np.arange(8) * 256
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII spaces count
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    begins = np.concatenate([[0], np.cumsum(sizes)])
    ends = begins[1:] - 1
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    digest = xxhash.xxh64_intdigest
    pairs = zip(begins[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, len(found) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Unsigned; bit i is set if it is set in more than half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        # How often each byte has each value, then the bits of these values.
        ones += (np.bincount((part + BYTES).ravel(), minlength=2048).reshape(8, 256) @ BITS).ravel()
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp (the fingerprint as a signed long) of every row."""

    def make():
        def each(texts):
            found = np.array([fingerprint(shingle_hashes(x, words)) for x in texts], np.uint64)
            return [[*range(len(texts))], found.view(np.int64).tolist()]

        return each

    return map_lists(documents.select(key, text), make, {"fp": "long"}, keep=key)


# -- The trie join of many subtrees at once ------------------------------------------------------


def trie_links(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, free: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of positions whose values differ in at most ``budget`` bits.

    ``values``: unsigned, ascending and distinct within each subtree [begins, ends); only the low
    ``free`` bits differ within one. A node is a range of positions with a common path; the frontier
    holds the pairs of nodes of a level with the bits in which they differ, all subtrees together.
    """
    left = [np.asarray(begins, np.int64), np.asarray(ends, np.int64)]
    right = [left[0].copy(), left[1].copy()]
    spent = np.zeros(len(left[0]), np.int8)
    for bit in range(free - 1, -1, -1):
        set_here = (values >> np.uint64(bit)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(set_here, dtype=np.int64)])
        middle = lambda node: node[1] - (ones[node[1]] - ones[node[0]])
        lm, rm = middle(left), middle(right)
        same = left[0] == right[0]
        zero_l, one_l, zero_r, one_r = (left[0], lm), (lm, left[1]), (right[0], rm), (rm, right[1])
        # Children that agree cost nothing, those that differ cost a bit. Of a node with itself the
        # two differing pairs are each other's mirror images.
        moves = [(zero_l, zero_r, 0, None), (one_l, one_r, 0, None), (zero_l, one_r, 1, None), (one_l, zero_r, 1, ~same)]
        next_left, next_right, next_spent = [], [], []
        for a, b, cost, only in moves:
            there = (a[1] > a[0]) & (b[1] > b[0]) & (spent + cost <= budget)
            if only is not None:
                there &= only
            # A leaf with itself is no pair, and neither are its descendants.
            there &= ~((a[0] == b[0]) & (a[1] - a[0] == 1))
            next_left.append((a[0][there], a[1][there]))
            next_right.append((b[0][there], b[1][there]))
            next_spent.append(spent[there] + np.int8(cost))
        left = [np.concatenate([x[i] for x in next_left]) for i in (0, 1)]
        right = [np.concatenate([x[i] for x in next_right]) for i in (0, 1)]
        spent = np.concatenate(next_spent)
        if not len(spent):
            break
    return np.minimum(left[0], right[0]), np.maximum(left[0], right[0])


def forest(first: np.ndarray, second: np.ndarray, cost: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between ``size`` positions those of a minimum spanning forest.

    Cheapest first, a part at a time; what a part has joined falls out of the rest at once, so a
    large group's many links are not looped over.
    """
    order = np.argsort(cost, kind="stable")
    first, second = first[order], second[order]
    root = list(range(size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b, step = [], [], 2 * size
    while len(first):
        for x, y in zip(first[:step].tolist(), second[:step].tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
        tops = np.fromiter((find(x) for x in range(size)), np.int64, size)
        first, second = first[step:], second[step:]
        apart = tops[first] != tops[second]
        first, second = first[apart], second[apart]
    return np.array(a, np.int64), np.array(b, np.int64)


def _cut(width: int, parts: int) -> list[tuple[int, int]]:
    edges = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _turned(nodes: DataFrame, path: list[str], free: int, budget: int, agree: int) -> tuple[DataFrame, int]:
    """Every fingerprint once for each choice of ``agree`` blocks of its ``free`` low bits.

    The chosen blocks move up and join the path, the others stay as the bits below.
    """
    blocks = _cut(free, budget + agree)
    turns = []
    widest = 0
    for k, chosen in enumerate(combinations(range(len(blocks)), agree)):
        order = [blocks[i] for i in chosen] + [b for i, b in enumerate(blocks) if i not in chosen]
        below = sum(w for _, w in order[agree:])
        widest = max(widest, below)
        moves = F.array(*(F.struct(F.lit(o).alias("offset"), F.lit(w).alias("width"), F.lit((1 << w) - 1).cast("long").alias("mask")) for o, w in order))
        turns.append(F.struct(F.lit(k).alias("turn"), F.lit(below).alias("below"), F.lit((1 << below) - 1).cast("long").alias("mask"), moves.alias("moves")))
    own = [c for c in nodes.columns if c not in ("low", *path)]
    new = nodes.select(*own, "low", *path, F.explode(F.array(*turns)).alias("t"))
    # An aggregate over a constant array, as the expression for all turns would be too long to compile.
    call = F.call_function
    add = lambda moved, m: call("shiftleft", moved, m["width"]).bitwiseOR(call("shiftrightunsigned", F.col("low"), m["offset"]).bitwiseAND(m["mask"]))
    new = new.withColumn("moved", F.aggregate("t.moves", F.lit(0).cast("long"), add))
    turn, block = f"turn{len(path)}", f"block{len(path)}"
    first = call("shiftrightunsigned", F.col("moved"), F.col("t.below"))
    return new.select(*own, *path, F.col("t.turn").alias(turn), first.alias(block), F.col("moved").bitwiseAND(F.col("t.mask")).alias("low")), widest


def links(distinct: DataFrame, budget: int = BUDGET, most: int = MOST, alike: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """Links (a, b) between the rows of ``distinct`` (fp, all different).

    Not all linked pairs, but enough for the same components: a spanning forest of each subtree. With
    ``alike``, ``distinct`` may have more long columns; the function gets them for both ends of links,
    as a dict of arrays each, and returns the links' costs, negative for those to leave out. The
    forests are then minimum ones.
    """
    own = distinct.columns
    nodes, path, free = distinct.withColumn("low", F.col("fp")), [], 64
    found = None
    for agree in (2, 1, 1):
        nodes, free = _turned(nodes, path, free, budget, agree)
        path = [c for c in nodes.columns if c not in ("low", *own)]
        sizes = nodes.groupBy(*path).agg(F.count("*").alias("size")).where("size > 1")
        nodes = durable(nodes.join(sizes, path))
        last = free <= int(np.log2(most)) or agree == 1 and len(path) == 6
        here = nodes if last else nodes.where(F.col("size") <= most)
        part = _subtree_links(here, path, own, free, budget, alike)
        found = part if found is None else found.unionByName(part)
        nodes = nodes.where(F.col("size") > most).drop("size")
        if last or nodes.isEmpty():
            break
    return found


def _subtree_links(nodes: DataFrame, path: list[str], own: list[str], free: int, budget: int, alike: Callable[..., np.ndarray] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0)
            sizes = np.asarray(pc.list_value_length(groups), np.int64)
            step = np.cumsum(sizes) // 8192  # groups of about so many fingerprints are walked together
            for k in np.unique(step):
                at = np.searchsorted(step, [k, k + 1])
                ends = np.cumsum(sizes[at[0] : at[1]])
                low, *values = (np.asarray(x) for x in groups.slice(at[0], at[1] - at[0]).flatten().flatten())
                i, j = trie_links(low.view(np.uint64), np.concatenate([[0], ends[:-1]]), ends, free, budget)
                cost = alike({n: v[i] for n, v in zip(own, values)}, {n: v[j] for n, v in zip(own, values)}) if alike else np.zeros(len(i), np.int8)
                i, j = forest(i[cost >= 0], j[cost >= 0], cost[cost >= 0], len(low))
                fp = values[own.index("fp")]
                yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["a", "b"])

    # The groups are bounded by ``most`` or by the free bits, see links().
    groups = nodes.groupBy(*path).agg(F.array_sort(F.collect_list(F.struct("low", *own))).alias("group")).select("group")
    return groups.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (the smallest node it reaches) of all nodes of ``edges`` (a, b).

    Contraction: every round a label that is linked with a smaller one points to the smallest of
    these, and moves to where the pointers lead in the end. Links between nodes of the same label fall out, so later
    rounds are small; what is left is counted, and the rounds end when nothing is.
    """
    left = durable(edges.select("a", "b").distinct())
    nodes = left.select(F.col("a").alias("node")).union(left.select(F.col("b"))).distinct()
    labels = durable(nodes.withColumn("component", F.col("node")))
    for _ in range(rounds):
        if left.isEmpty():
            return labels
        # Contract: each label offers itself to the labels it is linked with; the smallest wins.
        offers = left.groupBy("b").agg(F.min("a").alias("low")).select(F.col("b").alias("node"), "low")
        offers = offers.union(left.groupBy("a").agg(F.min("b")).select("a", "min(b)"))
        best = offers.groupBy("node").agg(F.min("low").alias("low")).where("low < node")
        # A label points to a smaller one, which may itself point on: doubled until all are at roots,
        # so that every round at least halves the labels that still have links.
        jump = durable(best.select("node", F.col("low").alias("to")))
        while True:
            doubled = jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
            doubled = durable(doubled.select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            if doubled.where("moved").isEmpty():
                break
            jump = doubled.drop("moved")
        labels = durable(
            labels.join(jump.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        )
        moved = left.join(jump.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a", "left").select("b", F.coalesce("a2", "a").alias("a"))
        moved = moved.join(jump.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b", "left").select("a", F.coalesce("b2", "b").alias("b"))
        left = durable(moved.where("a <> b").distinct())
    raise RuntimeError("components did not settle")


def near_duplicates(documents: DataFrame, words: int = WORDS, budget: int = BUDGET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id of every row."""
    prints = durable(fingerprints(documents, words, key, text))
    smallest = durable(prints.groupBy("fp").agg(F.min(key).alias("smallest")))
    found = components(links(smallest.select("fp"), budget))
    # Components of fingerprints get the smallest key of all their fingerprints.
    least = found.join(smallest.withColumnRenamed("fp", "node"), "node").groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = found.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    of = durable(smallest.join(named, "fp", "left").select("fp", F.coalesce("component_id", "smallest").alias("component_id")))
    return join_hot(prints, of, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, words: int = WORDS, budget: int = BUDGET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents``, all columns as they are, with one row of each component: of the smallest key,
    any one where that key is repeated. Rows without a key can't be named and stay."""
    kept = near_duplicates(documents, words, budget, key, text).where(F.col(key) == F.col("component_id")).select(key).distinct()
    one = documents.where(F.col(key).isNotNull()).join(kept, key, "left_semi").dropDuplicates([key])
    return one.unionByName(documents.where(F.col(key).isNull()))


# -- Near copies by shingles of five words -------------------------------------------------------


class WordHashes(dict):
    """XXH64 of words, kept for words to come; emptied at a million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, from the words' hashes; of all of them if fewer."""
    size = min(size, len(words))
    n = len(words) - size + 1 if size else 0
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out + words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set of hashes, ``BANDS`` times ``ROWS``."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, ((shingles[at : at + 1024, None] ^ SALTS) * FACTORS).min(axis=0), out=least)
    return least


def buckets(least: np.ndarray) -> np.ndarray:
    """A hash of each band of MinHash values."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for value in least.reshape(BANDS, ROWS).T:
        out = (out ^ value) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def sketch(least: np.ndarray) -> bytes:
    """A byte of each MinHash value."""
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def words_of(table: WordHashes, text: str | None) -> np.ndarray:
    found = (text or "").encode().lower().split()
    return np.fromiter(map(table.__getitem__, found), np.uint64, len(found))


def _digest(text: str) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def near_texts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per different text of rows with a key: node (a number), md5, its smallest key, n (five-word
    shingles, all different), fp (its fingerprint), bands (see ``buckets``) and sketch."""

    def make():
        table = WordHashes()

        def each(texts):
            sets = [np.unique(rolled(words_of(table, x), NEAR_WORDS)) for x in texts]
            least = [least_hashes(x) for x in sets]
            prints = np.array([fingerprint(shingle_hashes(x)) for x in texts], np.uint64).view(np.int64)
            return [[*range(len(texts))], [len(x) for x in sets], prints.tolist(), [buckets(x).view(np.int64) for x in least], [sketch(x) for x in least]]

        return each

    rows = documents.where(F.col(key).isNotNull()).select(F.struct(F.col(key).alias("key"), _digest(text).alias("md5")).alias("id"), F.col(text).alias("text"))
    prints = map_lists(rows, make, {"n": "long", "fp": "long", "bands": "array<long>", "sketch": "binary"}, keep="id").select("id.*", "n", F.struct("fp", "bands", "sketch").alias("made"))
    least = prints.groupBy("md5").agg(F.min("key").alias("key"), F.any_value("n").alias("n"), F.any_value("made").alias("made"))
    return durable(least.select(F.monotonically_increasing_id().alias("node"), "md5", "key", "n", "made.*"))


def reached(size: int, like: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join positions as ``like(i, others)`` does, a spanning forest of it: every position is
    held once against those not reached yet."""
    left, first, second = np.arange(size), [], []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = like(i, left)
            found = left[hit]
            first.append(np.full(len(found), i))
            second.append(found)
            queue += found.tolist()
            left = left[~hit]
    return np.concatenate([np.empty(0, np.int64), *first]).astype(np.int64), np.concatenate([np.empty(0, np.int64), *second]).astype(np.int64)


def resembling(n: np.ndarray, sketches: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """May texts have the least similarity, by their numbers of shingles and sketches?"""

    def like(i: int, others: np.ndarray) -> np.ndarray:
        fit = np.minimum(n[i], n[others]) >= SIMILARITY * np.maximum(n[i], n[others])
        at = np.flatnonzero(fit)
        fit[at] = (sketches[others[at]] == sketches[i]).mean(axis=1) >= ESTIMATE
        return fit

    return like


def shared(n: np.ndarray, shingles: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """How many shingles a text has in common with others. ``shingles``: those of all texts, all different
    within a text.

    Shingles of a 64th of the texts or more are bits of rows that are and-ed, so near copies, which share
    most, cost a 64th of their shingles; of the others the texts that have them are listed.
    """
    size, owner = len(n), np.repeat(np.arange(len(n)), n)
    _, which, often = np.unique(shingles, return_inverse=True, return_counts=True)
    column = np.cumsum(frequent := often >= max(2, size / 64)) - 1
    bits = np.zeros((size, column[-1] // 64 + 1 if len(column) else 0), np.uint64)
    at = frequent[which]
    place = column[which[at]]
    np.bitwise_or.at(bits, (owner[at], place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    at = ~frequent[which] & (often[which] > 1)
    own, rows = which[at], owner[at]
    begin = np.searchsorted(rows, np.arange(size + 1))
    order = np.argsort(own, kind="stable")
    listed, first = rows[order], np.searchsorted(own[order], np.arange(len(often)))

    def common(i: int, others: np.ndarray) -> np.ndarray:
        found = np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)
        mine = own[begin[i] : begin[i + 1]]
        if len(mine):
            ends = np.cumsum(often[mine])
            places = np.repeat(first[mine] - ends + often[mine], often[mine]) + np.arange(ends[-1])
            found += np.bincount(listed[places], minlength=size)[others]
        return found

    return common


def verified(n: np.ndarray, sketches: np.ndarray, prints: np.ndarray, shingles: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """Do texts have the least similarity, a lesser one if their fingerprints link? ``shingles``: those of
    all texts, all different within a text."""
    may, common = resembling(n, sketches), shared(n, shingles)

    def like(i: int, others: np.ndarray) -> np.ndarray:
        linked = np.bitwise_count(prints[others] ^ prints[i]) <= BUDGET
        linked &= np.minimum(n[i], n[others]) >= LINKED_SIMILARITY * np.maximum(n[i], n[others])
        fit = may(i, others) | linked
        at = np.flatnonzero(fit)
        if len(at) and n[i]:
            both = common(i, others[at])
            fit[at] = both >= np.where(linked[at], LINKED_SIMILARITY, SIMILARITY) * (n[others[at]] + n[i] - both)
        return fit

    return like


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BANDS * ROWS)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin and end."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def grouped(texts: DataFrame) -> DataFrame:
    """node and component of texts that may be near copies of others: a component holds all near copies
    of its texts, and some more.

    Texts whose fingerprints link are joined (``print_links``). Those that differ in more bits meet in a bucket, that is a band of MinHash values; a pair at the least similarity shares
    none with a probability of (1 - 0.8 ** 5) ** 24, under 1e-4. Within a bucket they are compared by
    their sketches; links that join them the same way come out, fewer than texts. A bucket of over
    ``BUCKET_TEXTS`` isn't compared but joined as it is.
    """
    rows = texts.select("node", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("low")).where("size > 1")
    shared = durable(rows.join(sizes, "bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sorted_groups(batches, "bucket"):
            node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            sketches, ends = _bytes(batch.column("sketch")), _runs(batch.column("bucket").to_numpy())
            first, second = [], []
            pairs = ends[:-1][np.diff(ends) == 2]  # most buckets: all of them at once
            alike = (np.minimum(n[pairs], n[pairs + 1]) >= SIMILARITY * np.maximum(n[pairs], n[pairs + 1])) & ((sketches[pairs] == sketches[pairs + 1]).mean(axis=1) >= ESTIMATE)
            first.append(pairs[alike])
            second.append(pairs[alike] + 1)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if b - a > 2:
                    i, j = reached(b - a, resembling(n[a:b], sketches[a:b]))
                    first.append(i + a)
                    second.append(j + a)
            i, j = np.concatenate(first), np.concatenate(second)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

    small = shared.where(F.col("size") <= BUCKET_TEXTS).join(texts.select("node", "n", "sketch"), "node").select("bucket", "node", "n", "sketch")
    near = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")
    large = shared.where((F.col("size") > BUCKET_TEXTS) & (F.col("node") > F.col("low"))).select(F.col("low").alias("a"), F.col("node").alias("b"))
    return components(near.unionByName(large).unionByName(print_links(texts)))


def print_links(texts: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of ``texts`` by the trie join of their fingerprints (see ``links``): texts
    of an equal one are linked with the first of them, and these with each other."""
    first = durable(texts.groupBy("fp").agg(F.min("node").alias("first")))
    equal = join_hot(texts.select("node", "fp"), first, "fp").where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    apart = links(first.select("fp")).distinct().withColumnsRenamed({"a": "fa", "b": "fb"})
    apart = apart.join(first.toDF("fa", "a"), "fa").join(first.toDF("fb", "b"), "fb")
    return equal.unionByName(apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def whole_texts(documents: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """node and s (its shingles, ascending) of the rows of ``wanted`` (node, key, md5)."""

    def shingled():
        table = WordHashes()
        return lambda found: [[*range(len(found))], [np.unique(rolled(words_of(table, x), NEAR_WORDS)).view(np.int64) for x in found]]

    named = documents.select(F.col(key).alias("_key"), _digest(text).alias("_md5"), F.col(text).alias("text"))
    whole = named.join(wanted.select("node", "key", "md5"), (F.col("_md5") == F.col("md5")) & (F.col("_key") == F.col("key"))).select("node", "text")
    return map_lists(whole, shingled, {"s": "array<long>"}, keep="node").groupBy("node").agg(F.any_value("s").alias("s"))


def near_components(texts: DataFrame, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """node and component (its smallest node) of the texts of ``near_texts`` that have near copies: sets
    of five-word shingles (fewer words: the whole sequence) with a Jaccard similarity of
    ``SIMILARITY``, or of ``LINKED_SIMILARITY`` where fingerprints differ in ``BUDGET`` bits at most. Texts
    of no word are near copies.

    Every link is verified on the shingles. The groups of ``grouped`` are verified in a task each, all
    pairs that aren't joined yet; those of over ``GROUP_TEXTS`` texts or ``GROUP_SHINGLES`` shingles are cut
    into blocks, each two of which are verified together. Groups of over ``BLOCKS`` blocks go through
    ``near_links``, where only texts of a bucket meet.
    """
    held = texts.select("node", "key", "md5", "n").join(grouped(texts), "node")
    sizes = held.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    held = durable(held.join(sizes, "component"))
    fits = (F.col("size") <= GROUP_TEXTS) & (F.col("total") <= GROUP_SHINGLES)
    shingles = durable(whole_texts(documents, held, key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sorted_groups(batches, "part"):
            node, n, fp, sketches = *(batch.column(c).to_numpy() for c in ("node", "n", "fp")), _bytes(batch.column("sketch"))
            s = batch.column("s").flatten().to_numpy().view(np.uint64)
            ends, begin = _runs(batch.column("part").to_numpy()), np.concatenate([[0], np.cumsum(n)])
            nodes, roots = [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                i, j = reached(b - a, verified(n[a:b], sketches[a:b], fp.view(np.uint64)[a:b], s[begin[a] : begin[b]]))
                root = _roots(node[a:b], i, j)
                linked = np.zeros(b - a, bool)
                linked[i] = linked[j] = True
                nodes.append(node[a:b][linked])
                roots.append(root[linked])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(roots))], names=["node", "component"])

    def joined(parts: DataFrame) -> DataFrame:
        """node and component of the texts of each part (part, node, n) that have near copies in it."""
        rows = parts.join(shingles, "node").join(texts.select("node", "fp", "sketch"), "node").select("part", "node", "n", "fp", "sketch", "s")
        return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "node long, component long")

    found = joined(held.where(fits).select(F.col("component").alias("part"), "node", "n"))
    cut = held.where(~fits).withColumn("blocks", F.ceil(F.greatest(F.col("size") / max(GROUP_TEXTS // 2, 1), F.col("total") / max(GROUP_SHINGLES // 2, 1))))
    if cut.isEmpty():
        return found
    # A text's block meets every block, itself too. (Of two parts of one hash the texts meet, which does no harm.)
    own = F.pmod(F.xxhash64("node"), "blocks")
    two = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.xxhash64("component", F.least(own, x), F.greatest(own, x)))
    met = joined(cut.where(F.col("blocks") <= BLOCKS).select(F.explode(two).alias("part"), "node", "n"))
    edges = met.where("component <> node").select(F.col("component").alias("a"), F.col("node").alias("b"))
    large = durable(cut.where(F.col("blocks") > BLOCKS).select("node"))
    if not large.isEmpty():
        edges = edges.unionByName(near_links(texts.join(large, "node", "left_semi"), shingles))
    return found.unionByName(components(edges))


def _roots(names: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The smallest name that each position reaches by links of a forest as ``reached`` makes it: the
    first end of a link was reached before."""
    root = list(range(len(names)))
    for i, j in zip(first.tolist(), second.tolist(), strict=True):
        root[j] = i
    for i in range(len(root)):
        path, at = [], i
        while root[at] != at:
            path.append(at)
            at = root[at]
        for x in path:
            root[x] = at
    least: dict[int, int] = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, names[i]), names[i])
    return np.array([least[r] for r in root], np.int64)


def _print_buckets(fp: str) -> Column:
    """A bucket for each choice of two of the blocks of a fingerprint: those that link agree in one."""
    blocks = [F.lit(((1 << w) - 1) << o if o + w < 64 else -1 << o).cast("long") for o, w in _cut(64, BUDGET + 2)]
    return F.array(*(F.xxhash64(F.lit(k), F.col(fp).bitwiseAND(a.bitwiseOR(b))) for k, (a, b) in enumerate(combinations(blocks, 2))))


def near_links(texts: DataFrame, shingles: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of ``texts`` (``near_texts``) that are near copies: not all such pairs,
    but enough for the same components. ``shingles``: node and s.

    For groups that no task holds: buckets (bands, and blocks of fingerprints) aren't gathered, pairs meet by joins. Every candidate is
    verified before it joins anything. A family of many near copies isn't compared pair by pair: of each
    bucket the text that meets most others is compared with all of the bucket and then leaves it.
    Buckets whose texts are all joined are done. Once the pairs that are left are few for the number of
    rows, they are all compared.
    """
    rows = texts.select("node", "n", F.explode(F.concat("bands", _print_buckets("fp"))).alias("bucket"))
    prints = shingles.join(texts.select("node", "fp"), "node").select("node", "s", "fp")
    common = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    members = durable(rows.join(common, "bucket").withColumn("label", F.col("node")))

    def checked(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(prints.toDF("a", "sa", "fa"), "a").join(prints.toDF("b", "sb", "fb"), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        least = F.when(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= BUDGET, LINKED_SIMILARITY).otherwise(SIMILARITY)
        return durable(both.where(common >= least * (F.size("sa") + F.size("sb") - common)).drop("sa", "sb", "fa", "fb"))

    # Sizes this far apart exclude the similarity.
    sizes_fit = F.least("n", "n2") >= LINKED_SIMILARITY * F.greatest("n", "n2")
    pair = (F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
    found = None
    while True:
        open_ = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        live = durable(members.join(open_.select("bucket", "size"), "bucket"))
        # Of the ordered pairs of each bucket those of one label fall out.
        labelled = live.groupBy("bucket", "label").agg(F.count("*").alias("m"))
        rows_left, apart = labelled.join(open_.select("bucket", "size"), "bucket").agg(F.sum("m"), F.sum(F.col("m") * (F.col("size") - F.col("m"))) / 2).first()
        if not rows_left:
            break
        if apart <= PAIRS_A_ROW * rows_left:
            others = live.select("bucket", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("label").alias("label2"))
            last = checked(live.join(others, "bucket").where((F.col("label") < F.col("label2")) & sizes_fit).select(*pair))
            found = last if found is None else found.unionByName(last)
            break
        degree = live.groupBy("node").agg(F.sum("size").alias("degree"))
        center = F.max(F.struct("degree", "node", "n", "label")).alias("c")
        centers = live.join(degree, "node").groupBy("bucket").agg(center).select("bucket", F.col("c.node").alias("node2"), F.col("c.n").alias("n2"), F.col("c.label").alias("label2"), F.col("c.degree").alias("degree2"))
        beside = durable(live.drop("size").join(centers, "bucket").where("node <> node2"))
        star = checked(beside.where((F.col("label") != F.col("label2")) & sizes_fit).select(F.col("node").alias("a"), F.col("node2").alias("b"), "label2", "degree2"))
        part = star.select("a", "b")
        found = part if found is None else found.unionByName(part)
        # Equal labels mean joined texts; each takes the label of its most central neighbour.
        labels = star.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("degree2", "b", "label2")).alias("c")).select("node", F.col("c.label2").alias("new"))
        members = beside.join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("new", "label").alias("label"))
    if found is None:
        return texts.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    return found.distinct()


def keep_one_near(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents``, all columns as they are, with one row of each group of copies and near copies
    (``near_components``): that of the smallest key (and md5, where texts share a key), any one where
    that key is repeated with the same text. Rows without a key can't be named and stay. A null text is
    the empty text; an empty table gives an empty one."""
    texts = near_texts(documents, key, text)
    found = durable(near_components(texts, documents, key, text).join(texts.select("node", F.struct("key", "md5").alias("id")), "node"))
    best = found.groupBy("component").agg(F.min("id").alias("best"))
    gone = found.join(best, "component").where("id <> best").select("node")
    firsts = texts.join(gone, "node", "left_anti").select("key", "md5")
    rows = documents.select(F.col(key).alias("_key"), _digest(text).alias("_md5"), F.struct("*").alias("_row"))
    here = (F.col("_md5") == F.col("md5")) & (F.col("_key") == F.col("key"))
    one = rows.where("_key IS NOT NULL").join(firsts, here, "left_semi").dropDuplicates(["_key", "_md5"])
    return one.unionByName(rows.where("_key IS NULL")).select("_row.*")
