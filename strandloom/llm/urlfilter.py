"""URL filters by a Bloom filter cascade.

Level 0 holds the listed keys. Level 1 holds the keys of the corpus that level 0 takes in wrongly,
level 2 the listed keys that level 1 takes in wrongly, and so on until a level has no false
positive. The universe is complete (every key that any row of the corpus asks for), so the depth at
which a key first fails tells exactly whether it is listed, and rows need no join with the list.

A url asks for its host and every parent domain, each with the path prefixes of the lengths that
occur in the rules. The longest listed key wins; of two equally long ones, that with the longer
host. Host and path follow the text of the url as it stands: a null url or one without ``://`` has
both empty and fits no rule. Repeated rows get equal results; extra columns are dropped; an empty
list or table gives no rule for any row.

Size: level 0 takes ``bits_per_key`` bits for a listed key, each later level ``bits_per_key`` for a
false positive of the level before, i.e. a few thousandths of the keys asked for. Levels are built
on the executors, combined with bit_or, and reach the driver as columns. Keys are dealt by hash into
so many segments that a segment's cascade takes about ``most_bytes``; each has a cascade of its own,
and with more than one, they are shipped and asked one after the other, the answers so far written
in between. So what a task or the driver holds doesn't grow with the list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


#: host and path prefix, and what the rule says
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.substring(rest, F.length(host) + 1, F.length(rest))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys that a url asks for: parent domains times path prefixes of the given lengths."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    domains = F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    )
    prefixes = F.array(*(F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths))
    found = F.filter(prefixes, lambda x: x.isNotNull())
    return F.flatten(F.transform(domains, lambda d: F.transform(found, lambda p: F.concat(d, p))))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: np.ndarray  # uint64


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of a hash: each level needs its own, or the false positives of a level would be
    false positives of all."""
    x = x.astype(np.int64).view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _positions(first: np.ndarray, second: np.ndarray, k: int, bits: int, hashes: int) -> np.ndarray:
    """The bits of keys, given by two hashes, in level k."""
    a, b = _mixed(first, 2 * k + 1), _mixed(second, 2 * k + 2) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(1, hashes + 1, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def _depth(levels: list[Level], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The first level that doesn't take a key in; the number of levels if all do."""
    depth, alive = np.full(len(first), len(levels)), np.ones(len(first), bool)
    for k, level in enumerate(levels):
        at = np.flatnonzero(alive)
        if not len(at):
            break
        spot = _positions(first[at], second[at], k, level.bits, level.hashes)
        here = ((level.words[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
        depth[at[~here]] = k
        alive[at[~here]] = False
    return depth


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("first"), F.xxhash64(key, F.lit("second")).alias("second")]


def _build(keys: DataFrame, k: int, bits_per_key: int, hashes: int) -> Level | None:
    """A level over the rows of ``keys`` (first, second); None if there are none."""
    n = keys.count()
    if not n:
        return None
    bits = max(64, -(-n * bits_per_key // 64) * 64)

    @F.pandas_udf("array<long>")
    def spots(first: pd.Series, second: pd.Series) -> pd.Series:
        at = _positions(first.to_numpy(), second.to_numpy(), k, bits, hashes)
        return pd.Series(list(at))

    words = (
        keys.select(F.explode(spots("first", "second")).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("value"))
        .toArrow()
    )
    held = np.zeros(bits // 64, np.int64)
    held[words.column("word").to_numpy()] = words.column("value").to_numpy()
    return Level(bits, hashes, held.view(np.uint64))


def _segment(segments: int) -> Column:
    return F.pmod(F.col("first").bitwiseXOR(F.col("second")), F.lit(segments))


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = 16, hashes: int = 6) -> list[Level]:
    """Levels for the distinct ``key`` of ``listed`` over the distinct ``key`` of ``universe``."""
    return _cascade(*_apart(listed, universe), bits_per_key, hashes)


def _apart(listed: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hashes of the listed keys and of those asked for that aren't listed."""
    inside = durable(listed.select(*_hashes(F.col("key"))).distinct())
    # A short list is sent to the keys; the result is the same either way.
    short = F.broadcast(inside) if inside.count() < 100_000 else inside
    return inside, durable(universe.select(*_hashes(F.col("key"))).distinct().join(short, ["first", "second"], "left_anti"))


def _cascade(inside: DataFrame, outside: DataFrame, bits_per_key: int, hashes: int) -> list[Level]:
    levels: list[Level] = []
    turn, other = inside, outside
    while (level := _build(turn, len(levels), bits_per_key, hashes)) is not None:
        levels.append(level)
        turn, other = durable(_passing(inside.sparkSession, other, level, len(levels) - 1)), turn
    return levels


def _passing(spark: SparkSession, keys: DataFrame, level: Level, k: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def passes(first: pd.Series, second: pd.Series) -> pd.Series:
        x = shared.value
        spot = _positions(first.to_numpy(), second.to_numpy(), k, x.bits, x.hashes)
        return pd.Series(((x.words[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1))

    return keys.where(passes("first", "second"))


def member(spark: SparkSession, levels: list[Level]):
    """A vectorised test of an array of keys: which of them are listed."""
    shared = spark.sparkContext.broadcast(levels)

    @F.pandas_udf("array<boolean>")
    def listed(first: pd.Series, second: pd.Series) -> pd.Series:
        sizes = first.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series([np.zeros(0, bool)] * len(first))
        a, b = np.concatenate(first.to_list()), np.concatenate(second.to_list())
        inside = _depth(shared.value, a.astype(np.int64), b.astype(np.int64)) % 2 == 1
        return pd.Series(np.split(inside, np.cumsum(sizes)[:-1]))

    return listed


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", column: str = "url", bits_per_key: int = 16, hashes: int = 6, most_bytes: int = 64 << 20) -> DataFrame:
    """key, host, path, rule and verdict of every row; see the module for the semantics.

    Where no rule fits, the verdict is the cascade's: an unlisted key is allowed.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(column))
    lengths = sorted({len(r.path) for r in rules})
    split = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    keyed = split.withColumn("keys", candidates(F.col("host"), F.col("path"), lengths) if rules else F.array().cast("array<string>"))
    inside, outside = _apart(spark.createDataFrame([(r.key,) for r in rules], "key string"), keyed.select(F.explode("keys").alias("key")))
    segments = max(1, -(-len(rules) * bits_per_key // 8 // most_bytes))
    first, second = F.transform("keys", lambda x: F.xxhash64(x)), F.transform("keys", lambda x: F.xxhash64(x, F.lit("second")))
    found = keyed.withColumn("inside", F.transform("keys", lambda _: F.lit(False)))
    for s in range(segments):
        own = [x.where(_segment(segments) == s) if segments > 1 else x for x in (inside, outside)]
        levels = _cascade(*own, bits_per_key, hashes)
        test = member(spark, levels)(first, second)
        mine = F.zip_with(first, second, lambda a, b: F.pmod(a.bitwiseXOR(b), F.lit(segments)) == s)
        found = found.withColumn("test", test).withColumn("inside", F.zip_with("inside", F.zip_with("test", mine, lambda a, b: a & b), lambda a, b: a | b)).drop("test")
        if segments > 1:
            found = durable(found)
    hits = F.filter(F.col("keys"), lambda x, i: F.element_at("inside", i + 1))
    # Longest first; the keys of longer hosts come first among the candidates.
    best = F.aggregate(hits, F.lit("").cast("string"), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    rule = F.nullif(best, F.lit(""))
    ruled = found.withColumn("rule", rule)
    if len(rules) <= 1000:
        says = F.create_map(*(F.lit(x) for r in rules for x in (r.key, r.verdict))) if rules else F.lit(None).cast("map<string,string>")
        return ruled.select(key, "host", "path", "rule", F.coalesce(says[F.col("rule")], F.lit("allow")).alias("verdict"))
    # A long list's verdicts don't fit into an expression.
    says = spark.createDataFrame([(r.key, r.verdict) for r in rules], "rule string, says string").dropDuplicates(["rule"])
    return ruled.join(says, "rule", "left").select(key, "host", "path", "rule", F.coalesce("says", F.lit("allow")).alias("verdict"))
