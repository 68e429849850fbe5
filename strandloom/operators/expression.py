"""Expression profiles: from matches to weighted counts, and filters, scales and groups of their rows.

Edge cases. Null values are not defined: they count for no mean or sum. Rows without a defined value have
null means and pass no filter on them. Equal rows are rows of their own; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(matches: DataFrame, keys: list[str], count: str, p_value: str, pct: str) -> DataFrame:
    """keys, weighted (whole), total, matches and best_pct: counts of a key's matches, weighted by how its
    best p-value compares with theirs, and not weighted. Null p-values weigh nothing."""
    best = matches.groupBy(*(F.col(k).alias(f"__sl_{k}") for k in keys)).agg(F.min(p_value).alias("__sl_best"))
    same = [F.col(k).eqNullSafe(F.col(f"__sl_{k}")) for k in keys]
    weight = F.when(F.col(p_value) == F.col("__sl_best"), 1.0).otherwise(F.col("__sl_best") / F.col(p_value))
    joined = matches.join(best, same)
    return joined.groupBy(*keys).agg(F.floor(F.sum(F.col(count) * weight) + 1e-9).alias("weighted"), F.sum(count).alias("total"), F.count("*").alias("matches"), F.max(pct).alias("best_pct"))


def _defined(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def row_mean(values: Column) -> Column:
    """The mean of an array's defined values."""
    held = _defined(values)
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, v: a + v) / F.size(held))


def row_variation(values: Column) -> Column:
    """The mean distance of an array's defined values from their mean, over the mean; null for a mean of 0."""
    held = _defined(values)
    away = _once(row_mean(values), lambda mean: F.aggregate(held, F.lit(0.0), lambda a, v: a + F.abs(v - mean)) / F.nullif(mean, F.lit(0.0)))
    return away / F.size(held)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, where ``use`` asks for it at every element of an array."""
    return F.get(F.transform(F.array(value), use), 0)


def filter_rows(rows: DataFrame, values: str, defined_pct: float = 0.0, least_value: float = float("-inf"), mean: tuple[float, float] | None = None, variation: tuple[float, float] | None = None, name: tuple[str, str] | None = None) -> DataFrame:
    """Rows of which ``defined_pct`` percent of the values are defined and ``least_value`` or more, whose mean
    and variation lie in ranges, and whose column matches a pattern in any case (``name``: both)."""
    v = F.col(values)
    enough = F.size(F.filter(v, lambda x: x >= least_value)) >= F.lit(defined_pct / 100) * F.size(v)
    kept = rows.where(enough)
    if mean is not None:
        kept = kept.where(row_mean(v).between(*mean))
    if variation is not None:
        kept = kept.where(row_variation(v).between(*variation))
    return kept if name is None else kept.where(F.col(name[0]).rlike(f"(?i){name[1]}"))


def scaled_rows(a: Column, b: Column, by: str = "mean") -> tuple[Column, Column]:
    """Two arrays, the smaller one (by its mean or median) scaled up to the other; as they are if its is 0."""

    def level(x: Column) -> Column:
        if by == "mean":
            return row_mean(x)
        held = F.sort_array(_defined(x))
        n = F.size(held)
        at = lambda i: F.get(held, i.cast("int"))
        return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2

    la, lb = level(a), level(b)
    grown = lambda x, own, other: _once(F.when((own > 0) & (own < other), other / own).otherwise(1.0), lambda times: F.transform(x, lambda v: v * times))
    return grown(a, la, lb), grown(b, lb, la)


def mean_ratio(a: Column, b: Column) -> Column:
    """The smaller mean over the larger one; 1 if both are 0."""
    ma, mb = row_mean(a), row_mean(b)
    return F.when((ma == 0) & (mb == 0), 1.0).otherwise(F.least(ma, mb) / F.nullif(F.greatest(ma, mb), F.lit(0.0)))


def balanced_groups(weights: list[float], groups: int) -> list[list[float]]:
    """Weights dealt, the heaviest first, to the lightest group so far: for lists such as files to be read.
    Ties go to the first group."""
    import heapq

    held = [(0.0, i) for i in range(groups)]
    out: list[list[float]] = [[] for _ in range(groups)]
    for w in sorted(weights, reverse=True):
        total, i = heapq.heappop(held)
        out[i].append(w)
        heapq.heappush(held, (total + w, i))
    return out
