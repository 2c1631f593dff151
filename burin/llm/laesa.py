"""Centroid clustering with a LAESA pivot table.

Vectors become integers, floor(1024 * x). The first centroids are also the pivots: the distance
of every vector to every pivot is computed once and stored with the vector in the shared folder.
In each round a centroid's distances to the pivots are computed once, and for every vector the
largest difference of the two over the pivots bounds its distance to the centroid from below. The
centroid of the least bound gets its exact integer distance first; centroids whose bound lies
above the best distance are gone, and of those left the next least is computed, until none is
left. Each task adds up its clusters, Spark adds the tasks' sums, and only the centroids reach
the driver.

Defined results: rows whose vector is null, has not exactly `width` components or holds a null,
NaN or infinite one are left out; a null id is an id after all others in the choice of centroids,
where equal ids come in the order of their vectors. Repeated rows are rows of their own; with
fewer rows than centroids there are as many centroids as rows. A tie goes to the smaller number.
Without usable rows there is no row. Components beyond exact 64-bit distances raise an
ArithmeticError. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burin.llm.common import persisted
from burin.llm.integer_vectors import Sums, floors, integers, moved, rounds_sql, usable

SCALE, WIDTH, CENTROIDS, ROUNDS, SALT = 1024, 64, 8, 10, 3


def first_centroids(rows: DataFrame, key: str, vector: str, n: int, width: int, scale: int, salt: int) -> np.ndarray:
    """The n usable vectors whose `salt:key` has the smallest SHA-256, in that order, as integers."""
    v, h = F.col(vector), F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256)
    found = rows.where(usable(v) & (F.size(v) == width)).select(h.alias("h"), v.alias("v")).orderBy(F.asc_nulls_last("h"), "v").limit(n).select(floors(F.col("v"), scale).alias("v")).collect()
    return np.array([r["v"] for r in found], np.int64).reshape(len(found), width)


def roots(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances (rows of x, rows of to) in float64."""
    return np.stack([np.sqrt(((x - t) ** 2).sum(1).astype(np.float64)) for t in to], 1)


def pivot_table(rows: DataFrame, pivots: np.ndarray, scale: int, key: str, vector: str) -> DataFrame:
    """key, x (the integer components, little-endian 32 or 64 bits) and d (distances to the pivots, float64) of the usable rows."""
    kind = rows.select(key).schema[0].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in integers(batch.column(1), scale, pivots.shape[1]):
                narrow = x.astype("<i4") if np.abs(x).max() < 1 << 31 else x.astype("<i8")
                near = roots(x, pivots)
                yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array([r.tobytes() for r in narrow], pa.binary()), pa.array([r.tobytes() for r in near], pa.binary())], ["key", "x", "d"])

    return rows.select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInArrow(apply, f"key {kind}, x binary, d binary")


def nearest(x: np.ndarray, near: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance, how many distances were computed) of each row of x, whose distances to the pivots are near.

    to_pivots are the centroids' distances to the pivots. Rounding of the square roots is
    allowed for, so that no centroid at the least distance is ever gone.
    """
    n, k = len(x), len(centroids)
    bound = np.zeros((n, k))
    for p in range(near.shape[1]):
        np.maximum(bound, np.abs(near[:, p, None] - to_pivots[None, :, p]), out=bound)
    slack = 1e-9 * (1.0 + near.max(1) + to_pivots.max())
    cluster, best = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    left, computed = np.arange(n), 0
    for _ in range(k):
        c = bound[left].argmin(1)
        d = ((x[left] - centroids[c]) ** 2).sum(1)
        computed += len(left)
        bound[left, c] = np.inf
        nearer = (d < best[left]) | ((d == best[left]) & (c < cluster[left]))
        rows = left[nearer]
        cluster[rows], best[rows] = c[nearer], d[nearer]
        left = left[bound[left].min(1) <= np.sqrt(best[left].astype(np.float64)) + slack[left]]
    return cluster, best, computed


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, components, cluster, squared distance) of batches whose last columns are x and d."""
    to_pivots = roots(centroids, pivots)
    width = centroids.shape[1]
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = batch.column(batch.num_columns - 2)
        sizes = pc.binary_length(raw).to_numpy()
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            own = batch if len(rows) == len(sizes) else batch.take(pa.array(rows))
            x = np.frombuffer(b"".join(own.column(own.num_columns - 2).to_pylist()), f"<i{size // width}").reshape(len(rows), width).astype(np.int64)
            near = np.frombuffer(b"".join(own.column(own.num_columns - 1).to_pylist()), np.float64).reshape(len(rows), len(pivots))
            cluster, best, _ = nearest(x, near, centroids, to_pivots)
            yield own, x, cluster, best


def _summing(centroids: np.ndarray, pivots: np.ndarray):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(*centroids.shape)
        for _, x, cluster, _ in _assigned(batches, centroids, pivots):
            sums.add(cluster, x)
        yield sums.batch()

    return apply


def assign(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """key, cluster, distance of every row of a pivot table."""
    kind = stored.schema["key"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, best in _assigned(batches, centroids, pivots):
            yield pa.record_batch([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(best)], ["key", "cluster", "distance"])

    return stored.mapInArrow(apply, f"key {kind}, cluster int, distance long")


def fit(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = WIDTH, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, salt: int = SALT) -> tuple[DataFrame, np.ndarray, np.ndarray] | None:
    """(pivot table, centroids after the rounds, pivots), or None without usable rows."""
    pivots = first_centroids(rows, key, vector, centroids, width, scale, salt)
    if not len(pivots):
        return None
    stored = persisted(pivot_table(rows, pivots, scale, key, vector))
    now = pivots
    for _ in range(rounds):
        now = moved(stored.select("x", "d"), _summing(now, pivots), now)
    return stored, now, pivots


def cluster(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", **settings: int) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable row."""
    made = fit(rows, key, vector, **settings)
    long = lambda n: F.lit(n).cast("long")
    if made is None:
        none = rows.where("false").select(F.col(key).alias("k"))
        return none.select(F.col("k").alias(key), F.lit(0).alias("cluster"), long(0).alias("distance"), long(0).alias("cluster_inertia"), long(0).alias("inertia"), F.lit("").alias("centroid_sha256"))
    found = assign(*made)
    totals = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    each = range(len(made[1]))
    of = lambda values: F.array(*values)[F.col("cluster")]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in made[1].tolist()]
    return found.select(
        F.col("key").alias(key), "cluster", "distance", of([long(totals.get(c, 0)) for c in each]).alias("cluster_inertia"),
        long(sum(totals.values())).alias("inertia"), of([F.lit(h) for h in digests]).alias("centroid_sha256"),
    )


SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, embedding) AS n, vec_id,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {WIDTH}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (SELECT n, 0 AS p, v AS s FROM kept),
c0 AS MATERIALIZED (SELECT 0 AS p, n - 1 AS e, v AS s FROM kept WHERE n <= {CENTROIDS}),
{rounds_sql(ROUNDS)}
SELECT vec_id, CAST(m.e AS INTEGER) AS cluster, m.d AS distance,
  CAST(sum(m.d) OVER (PARTITION BY m.e) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.s, ',')) AS centroid_sha256
FROM a{ROUNDS + 1} a JOIN kept USING (n) JOIN c{ROUNDS} c ON c.e = a.m.e
"""
