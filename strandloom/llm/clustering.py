"""Centroid clustering in integers, screened by block norms.

Vectors become integers once, and the norms of their segments (``SEGMENT`` components each) are worked out and
written with them. By Cauchy and Schwarz the product of a vector and a centroid is at most the sum over segments
of the products of their norms, so these few numbers give a lower bound of every distance. A batch of
vectors starts from the centroid of the smallest bound; of the others only those whose bound isn't over the best
distance so far get an exact integer distance. Bounds are floats, less a margin far over their rounding; they
only decide what is left out, never a distance.

A round goes over all vectors where they lie: tasks add up members and components per cluster, one row per
cluster and task is shuffled, and as many rows as there are centroids come to the driver, which floors the exact
quotients. Centroids are what is broadcast (k x components integers).

Edge cases. Vectors that are null, of another length than ``components``, or hold a null or non-finite component
take no part; nor do those with a component of 2^27 or more in size after scaling, whose distances might
not fit a long. Rows with a repeated key are vectors of their own. A null key can't be hashed, so it starts no
centroid; its vector is clustered like others. Fewer vectors than centroids make as many centroids; starts of
equal hash go by their components. A cluster that lost all vectors keeps its centroid. A sum of distances that doesn't fit a
long is null. Extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .topk import quantised

K = 40
ROUNDS = 5
COMPONENTS = 64
SEGMENT = 8
SCALE = 256
LARGEST = 1 << 27


def segment_norms(vectors: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Euclidean norms of the segments of each row; the last one may be shorter."""
    squares = vectors.astype(np.float64) ** 2
    return np.sqrt(np.add.reduceat(squares, np.arange(0, vectors.shape[1], segment), axis=1))


class Screen:
    """Nearest centroids of batches of vectors. ``offered`` and ``measured`` count the pairs there were and the
    exact distances that were worked out."""

    def __init__(self, centroids: np.ndarray, segment: int = SEGMENT):
        self.centroids = centroids.astype(np.int64)
        self.norms = segment_norms(self.centroids, segment)
        self.squares = (self.norms**2).sum(axis=1)
        self.offered = self.measured = 0

    def _distances(self, vectors: np.ndarray, numbers: np.ndarray | int) -> np.ndarray:
        apart = vectors - self.centroids[numbers]
        self.measured += len(apart)
        return np.einsum("ij,ij->i", apart, apart)

    def nearest(self, vectors: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (the smaller of equally near ones) and its squared distance."""
        own = (norms**2).sum(axis=1)
        scale = own[:, None] + self.squares
        bounds = scale - 2 * (norms @ self.norms.T) - 1e-10 * scale
        self.offered += bounds.size
        first = bounds.argmin(axis=1)
        best, cluster = self._distances(vectors, first), first.copy()
        for number in range(len(self.centroids)):
            rows = np.flatnonzero((bounds[:, number] <= best) & (first != number))
            if not len(rows):
                continue
            distances = self._distances(vectors[rows], number)
            nearer = (distances < best[rows]) | ((distances == best[rows]) & (number < cluster[rows]))
            best[rows[nearer]], cluster[rows[nearer]] = distances[nearer], number
        return cluster, best


def prepared(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, segment: int = SEGMENT, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The key, v (integers) and norms (of segments) of the vectors that take part."""
    v = vectors.select(F.col(key), F.when(F.size(column) == components, quantised(F.col(column), scale)).alias("v"))
    v = v.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: (x >= LARGEST) | (x <= -LARGEST))).withColumn("v", F.col("v").cast("array<int>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = segment_norms(_matrix(batch.column(1), components), segment)
            offsets = np.arange(0, norms.size + 1, norms.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, norms.ravel())], names=[*batch.schema.names, "norms"])

    return v.mapInArrow(run, f"`{key}` {v.schema[0].dataType.simpleString()}, v array<int>, norms array<double>")


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _assigned(ready: DataFrame, centroids: np.ndarray, segment: int, make, schema: str) -> DataFrame:
    """``make(batch, vectors, clusters, distances)`` over the batches of ``ready``, each result a record batch."""
    shared = ready.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(shared.value, segment)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"), screen.centroids.shape[1]).astype(np.int64)
                yield make(batch, v, *screen.nearest(v, _matrix(batch.column("norms"), screen.norms.shape[1])))

    return ready.mapInArrow(run, schema)


def _sums(batch: pa.RecordBatch, vectors: np.ndarray, clusters: np.ndarray, distances: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(clusters, kind="stable")
    numbers, starts = np.unique(clusters[order], return_index=True)
    sums = np.add.reduceat(vectors[order], starts, axis=0)
    members = np.diff(np.append(starts, len(order)))
    offsets = np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(members, pa.int64()), pa.ListArray.from_arrays(offsets, sums.ravel())], names=["cluster", "n", "sums"])


def starts(ready: DataFrame, k: int = K, key: str = "vec_id", salt: str = "2:") -> np.ndarray:
    """The vectors of the k smallest hashes of their keys, in the order of the hashes."""
    hashed = ready.select(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256).alias("h"), "v").where(F.col("h").isNotNull())
    return np.array([row["v"] for row in hashed.orderBy("h", "v").limit(k).collect()], np.int64)


def moved(ready: DataFrame, centroids: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Centroids after a round: the floored mean of each one's vectors, or itself where it has none."""
    width = centroids.shape[1]
    totals = _assigned(ready, centroids, segment, _sums, "cluster int, n long, sums array<long>").groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    after = centroids.copy()
    for row in totals.collect():  # a row per centroid
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return after


def cluster(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, segment: int = SEGMENT, key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    ready = durable(prepared(vectors, components, scale, segment, key, column))
    kind = ready.schema[key].dataType.simpleString()
    centroids = starts(ready, k, key)
    if not len(centroids):
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(ready, centroids, segment)

    def rows(batch, vectors, clusters, distances):
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(clusters, pa.int32()), pa.array(distances, pa.int64())], names=[key, "cluster", "distance"])

    found = _assigned(ready, centroids, segment, rows, f"`{key}` {kind}, cluster int, distance long")
    held = {r["cluster"]: r["held"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("held")).collect()}
    fits = lambda x: int(x) if x < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, fits(x), fits(sum(held.values())), digests[c]) for c, x in held.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row per centroid


CLUSTER_START = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (SELECT id, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v
), c0 AS (
  SELECT row_number() OVER (ORDER BY h, e) - 1 AS cluster, e
  FROM (SELECT sha256('2:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT 40)
)"""

CLUSTER_ROUND = """, a{n} AS MATERIALIZED (
  SELECT id, vec_id, cluster, distance FROM (
    SELECT v.id, v.vec_id, c.cluster, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM v, c{n} c
  ) QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cluster) = 1
)"""

CLUSTER_MOVE = """, m{n} AS (
  SELECT cluster, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY i) AS e FROM (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS k FROM a{n} JOIN parts USING (id) GROUP BY ALL) GROUP BY cluster
), c{m} AS MATERIALIZED (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN m{n} m ON m.cluster = c.cluster)"""

CLUSTER_SQL = (
    CLUSTER_START
    + "".join(CLUSTER_ROUND.format(n=n) + CLUSTER_MOVE.format(n=n, m=n + 1) for n in range(ROUNDS))
    + CLUSTER_ROUND.format(n=ROUNDS)
    + f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c USING (cluster)
"""
)
