"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are dealt into buckets of similar length, longest first. A query starts with a threshold
(the k-th best product among the vectors of its seed bucket). In each bucket the threshold over the
lengths gives a local cosine threshold: over 1, the bucket is pruned by length; high, coordinate
pruning keeps the vectors whose strongest query coordinates lie in the range that such a cosine
allows; low, vectors are cut off at the length that could still reach the threshold. What is left is
verified by integer products.

Edge cases. Vectors that are null, empty, or hold a null or non-finite component take no part, as
query or as candidate; those of another dimension than the first by vec_id neither. A null vec_id
takes no part. Rows with a repeated vec_id are candidates of their own; a query's own id is never
among its results. Query rows of one id but different vectors are queries of their own, with a list
each; equal rows are one query. A null query condition asks for nothing. Products are exact while the sum of |q_i p_i| is under 2^53. Ties go to the smaller vec_id. Extra columns are dropped; an empty table gives an
empty result.

Queries come in blocks of at most about ``block`` vectors, each shipped to the tasks as one bounded
broadcast; every block reads the prepared vectors once. With more than one, a block's results are
written and its broadcast ended before the next begins. Tasks return at most k rows per query; these
are merged in two steps, first for some of the tasks together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

K = 10
SCALE = 1024
BUCKET = 2048
BLOCK = 16_384
#: Local cosine from which coordinate pruning pays.
COORDINATE_FROM = 0.6
COORDINATES = 3


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as long; null unless all components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def prepared(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long) and norm2 of the vectors that take part."""
    v = vectors.select(F.col(key).alias("vec_id"), quantised(F.col(column), scale).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return v.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def allowed_range(coordinate: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Where a coordinate of a unit vector lies whose cosine with a query is ``cosine`` or more, from
    the same coordinate of the unit query."""
    spread = math.sqrt(max(0.0, 1 - cosine * cosine)) * np.sqrt(np.maximum(0.0, 1 - coordinate * coordinate))
    low = np.where(coordinate <= -cosine, -1.0, coordinate * cosine - spread)
    high = np.where(coordinate >= cosine, 1.0, coordinate * cosine + spread)
    return low - 1e-9, high + 1e-9


class Retrieval:
    """Running top-k of a block of queries over buckets."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, vectors, k
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.unit = vectors / np.maximum(self.norm, 1e-9)[:, None]
        self.strongest = np.argsort(-np.abs(self.unit), axis=1)[:, :COORDINATES]
        self.floor = floor.astype(np.float64)  # k-th best product so far
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(ids)
        self.verified = self.offered = 0

    def bucket(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """A bucket, longest first."""
        norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-norm, kind="stable")
        ids, vectors, norm = ids[order], vectors[order], norm[order]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(self.norm * norm[0] > 0, self.floor / (self.norm * norm[0]), np.where(self.floor > 0, 2.0, -1.0))
        self.offered += len(self.ids) * len(ids)
        alive = np.flatnonzero(local <= 1 + 1e-9)  # the others can't reach their threshold: length pruning
        steep = local[alive] >= COORDINATE_FROM
        self._products(alive[~steep], ids, vectors, norm)
        if steep.any():
            unit = vectors / np.maximum(norm, 1e-9)[:, None]
            for q in alive[steep]:
                # The cosine threshold of the longest vector holds for all shorter ones too.
                at = np.arange(len(ids))
                for f in self.strongest[q]:
                    low, high = allowed_range(self.unit[q, f], float(min(local[q], 1.0)))
                    at = at[(unit[at, f] >= low) & (unit[at, f] <= high)]
                if len(at):
                    self.verified += len(at)
                    self._take(q, ids[at], vectors[at] @ self.v[q])

    def _products(self, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, norm: np.ndarray) -> None:
        for at in range(0, len(queries), 512):
            some = queries[at : at + 512]
            # Length pruning within the bucket: up to the shortest vector that any of them can use.
            need = self.floor[some] / np.maximum(self.norm[some], 1e-9)
            upto = int(np.searchsorted(-norm, -(need.min() * (1 - 1e-9)), side="right")) if need.min() > 0 else len(norm)
            if not upto:
                continue
            products = self.v[some].astype(np.float64) @ vectors[:upto].T.astype(np.float64)
            self.verified += products.size
            rows, columns = np.nonzero(products >= self.floor[some][:, None])
            starts = np.searchsorted(rows, np.arange(len(some) + 1))
            for i, q in enumerate(some):
                c = columns[starts[i] : starts[i + 1]]
                if len(c):
                    self._take(q, ids[c], products[i, c])

    def _take(self, q: int, ids: np.ndarray, products: np.ndarray) -> None:
        there = (ids != self.ids[q]) & (products >= self.floor[q])
        ids, products = ids[there], products[there].astype(np.int64)
        if not len(ids):
            return
        held = self.best[q]
        if held is not None:
            ids, products = np.concatenate([held[0], ids]), np.concatenate([held[1], products])
        order = np.lexsort((ids, -products))[: self.k]
        self.best[q] = ids[order], products[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], products[order[-1]])


def top_k(vectors: DataFrame, queries: Column, k: int = K, key: str = "vec_id", column: str = "embedding", scale: int = SCALE, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of each row for which ``queries`` holds."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    schema = "query long, query_id long, vec_id long, score long"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready = prepared(vectors, key, column, scale)
    first = ready.select(F.min_by(F.size("v"), "vec_id")).first()[0]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if first is None:
        return empty
    ready = ready.where(F.size("v") == first)
    # Similar lengths together; the id splits vectors of one length, however many there are.
    ready = durable(ready.repartitionByRange(parts, F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id"))
    asked = ready.where(queries).withColumnRenamed("vec_id", "query_id")
    n = asked.count()
    blocks = max(1, -(-n // block))
    # The seed: a bounded bucket of the longest vectors, the same for all queries.
    seed = ready.orderBy(F.desc("norm2"), "vec_id").limit(bucket // 2).select("vec_id", "v").collect()
    if not n:
        return empty
    seed_ids = np.array([r["vec_id"] for r in seed], np.int64)
    seed_v = np.array([r["v"] for r in seed], np.int64)
    found = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "v").distinct().collect()
        if not rows:
            continue
        ids, v = np.array([r["query_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.int64)
        floor = np.full(len(ids), -np.inf)
        for at in range(0, len(ids), 1024):
            products = v[at : at + 1024].astype(np.float64) @ seed_v.T.astype(np.float64)
            products[ids[at : at + 1024, None] == seed_ids[None, :]] = -np.inf
            if products.shape[1] > k:
                floor[at : at + 1024] = -np.partition(-products, k - 1, axis=1)[:, k - 1]
        shared = sc.broadcast((np.arange(len(ids)) * blocks + b, ids, v, floor))
        part = ready.select("vec_id", "v").mapInArrow(_searcher(shared, k, bucket, first), schema).withColumn("part", F.spark_partition_id())
        if blocks > 1:
            part = durable(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return empty
    some = Window.partitionBy("query", F.pmod("part", F.lit(max(1, math.isqrt(parts))))).orderBy(F.desc("score"), "vec_id")
    fewer = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    ranked = fewer.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searcher(shared, k: int, bucket: int, dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, v, floor = shared.value
        search = Retrieval(ids, v, floor, k)
        for batch in batches:
            for at in range(0, batch.num_rows, bucket):
                part = batch.slice(at, bucket)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                search.bucket(part.column(0).to_numpy(zero_copy_only=False), flat.reshape(-1, dimension))
        for q, held in enumerate(search.best):
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held[0]), names[q])), pa.array(np.full(len(held[0]), ids[q])), pa.array(held[0]), pa.array(held[1])], names=["query", "query_id", "vec_id", "score"])

    return run
