"""Exact integer k-means with Hamerly's bounds.

Every vector keeps, from round to round, its cluster, an upper bound of the
distance to that centroid and a lower bound of the distance to any other one.
When centroids move, the upper bound grows by the own centroid's drift and the
lower one shrinks by the largest drift of the others.  While the upper bound is
below the lower one (or below half the way to the nearest other centroid) the
cluster cannot change and nothing is computed; else the own distance is
measured, and if that does not settle it, all of them, in exact integers.

A round is one pass: it writes the vectors with their new bounds to the shared
folder and, in the same files, a row for each task and cluster with what its
moved vectors add to the cluster's sum.  Sums never leave exact arithmetic; the
driver holds the centroids and nothing else.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.llm import core
from lanternflow.llm.core import column, numbers

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Beside rounded square roots the bounds keep this margin.
MARGIN = 1e-12
#: Below this, squares of differences of 64-bit components can be summed without overflow.
NARROW = 2**27
MOST = 2**63 - 1
STATE = "vec_id long, v array<long>, cluster int, upper double, lower double, distance long, n long, added array<decimal(38,0)>"


def integer_vectors(rows: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x; rows that are not ``dims`` finite numbers go."""
    plain = rows.toDF(*[c if c in ("vec_id", "embedding") else f"_{i}" for i, c in enumerate(rows.columns)])
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf")))
    kept = plain.where(x.isNotNull() & (F.size(x) == dims)).where(F.coalesce(fine, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the least hash; rows of one id by components, a null id last; fewer if there are fewer rows."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.v for r in vectors.orderBy(mark.asc_nulls_last(), "v").select("v").limit(k).collect()]


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return (d * d).sum(1)


def _sum(v: np.ndarray) -> np.ndarray:
    """Exact sum of rows, as Python numbers."""
    if len(v) and v.dtype != object and max(-int(v.min()), int(v.max())) * len(v) < 2**62:
        return v.sum(0).astype(object)
    return v.astype(object).sum(0) if len(v) else np.zeros(v.shape[1], object)


def _low(distances: np.ndarray) -> np.ndarray:
    """Squared distances as longs; larger ones are the largest long."""
    return np.array([min(int(x), MOST) for x in distances], np.int64) if distances.dtype == object else distances


class Round:
    """What a round knows of the centroids: their places, drifts since the last round, and half the way to the nearest other one."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None) -> None:
        self.places = np.array(centroids, object)
        self.fits = max(max(map(abs, c)) for c in centroids) < NARROW
        k = len(centroids)
        away = lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))
        self.half = np.array([min([away(centroids[i], centroids[j]) for j in range(k) if j != i], default=math.inf) / 2 for i in range(k)]) * (1 - MARGIN)
        drift = [0.0] * k if before is None else [away(a, b) for a, b in zip(before, centroids, strict=True)]
        self.drift = np.array(drift) * (1 + MARGIN)
        self.others = np.array([max([d for j, d in enumerate(self.drift) if j != i], default=0.0) for i in range(k)])

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, measure: bool):
        """New cluster and bounds of each vector, the distance where it was measured (all, if asked for), and how many were scanned in full; cluster -1: none yet."""
        n, k = len(v), len(self.places)
        narrow = self.fits and (not n or max(-int(v.min()), int(v.max())) < NARROW)
        c = self.places.astype(np.int64) if narrow else self.places
        v = v if narrow else v.astype(object)
        distance = np.zeros(n, v.dtype)
        cluster, known = cluster.copy(), cluster >= 0
        own = np.maximum(cluster, 0)
        upper = np.where(known, upper + self.drift[own], np.inf)
        lower = np.where(known, lower - self.others[own], -np.inf)
        enough = np.maximum(lower, self.half[own])
        near = np.flatnonzero(known & (measure | (upper >= enough)))
        if len(near):
            distance[near] = _squared(v[near], c[own[near]])
            upper[near] = np.sqrt(distance[near].astype(np.float64)) * (1 + MARGIN)
        scan = np.flatnonzero(upper >= enough)
        if len(scan):
            rows = v[scan]
            every = np.stack([_squared(rows, c[j]) for j in range(k)], 1)
            best = every.argmin(1)  # the first of equals
            at = np.arange(len(scan))
            distance[scan] = every[at, best]
            cluster[scan] = best
            upper[scan] = np.sqrt(distance[scan].astype(np.float64)) * (1 + MARGIN)
            rest = every.astype(np.float64)
            rest[at, best] = np.inf
            lower[scan] = np.sqrt(rest.min(1)) * (1 - MARGIN)
        return cluster, upper, lower, distance, len(scan)


def _pass(now, dims: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step: Round = now.value
        k = len(step.places)
        added, count = np.zeros((k, dims), object), [0] * k
        for b in batches:
            if not b.num_rows:
                continue
            v = column(b, "v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            was = numbers(b, "cluster").astype(np.int32)
            cluster, upper, lower, distance, _ = step.assign(v, was, numbers(b, "upper"), numbers(b, "lower"), last)
            if not last:
                for j in np.unique(np.concatenate([cluster[cluster != was], was[(cluster != was) & (was >= 0)]])).tolist():
                    come, gone = (cluster == j) & (was != j), (was == j) & (cluster != j)
                    added[j] += _sum(v[come]) - _sum(v[gone])
                    count[j] += int(come.sum()) - int(gone.sum())
            yield _rows(b.num_rows, vec_id=column(b, "vec_id"), v=None if last else column(b, "v"), cluster=cluster, upper=upper, lower=lower, distance=_low(distance) if last else None)
        moved = [j for j in range(k) if count[j] or any(added[j])]
        if moved:
            sums = pa.array([[Decimal(int(x)) for x in added[j]] for j in moved], pa.list_(pa.decimal128(38, 0)))
            yield _rows(len(moved), cluster=np.array(moved, np.int32), n=np.array([count[j] for j in moved]), added=sums)

    return run


_TYPES = {"vec_id": pa.int64(), "v": pa.list_(pa.int64()), "cluster": pa.int32(), "upper": pa.float64(), "lower": pa.float64(), "distance": pa.int64(), "n": pa.int64(), "added": pa.list_(pa.decimal128(38, 0))}


def _rows(size: int, **given) -> pa.RecordBatch:
    """A batch of state rows; columns that are not given are null."""
    cols = [pa.nulls(size, t) if given.get(c) is None else given[c] if isinstance(given[c], pa.Array) else pa.array(given[c], t) for c, t in _TYPES.items()]
    return pa.RecordBatch.from_arrays(cols, names=list(_TYPES))


def cluster_vectors(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Assign every vector to one of k centroids after so many rounds.

    Takes vec_id and embedding (other columns are ignored, whatever their
    names).  Returns vec_id, cluster, distance (squared), cluster_inertia,
    inertia and centroid_sha256.

    Null vectors, vectors of another length and those with a null, NaN or
    infinite component are left out.  A null vec_id is clustered and starts a
    centroid only if fewer than k rows have an id.  Rows that repeat are
    vectors of their own; equal starts share a place, and the smaller number
    takes all ties.  Fewer than k vectors: as many centroids.  Components are
    64-bit integers (larger ones are the nearest such), sums are exact, and a
    distance or inertia over the largest long is given as that.  An empty table
    gives an empty table.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows, dims, scale)
    centroids = first_centroids(vectors, k, seed)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], out)
    k = len(centroids)
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    state = vectors.selectExpr("vec_id", "v", "-1 AS cluster", "0D AS upper", "0D AS lower")
    before, held = None, None
    for i in range(rounds + 1):
        now = spark.sparkContext.broadcast(Round(centroids, before))
        new = core.stored(state.mapInArrow(_pass(now, dims, i == rounds), STATE), f"kmeans-{i}")
        if held is not None:
            core.free(held)
        held = new
        state = new.where("n IS NULL").select("vec_id", "v", "cluster", "upper", "lower")
        if i == rounds:
            break
        for r in new.where("n IS NOT NULL").select("cluster", "n", F.posexplode("added")).groupBy("cluster", "pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n")).collect():
            sums[r.cluster][r.pos] += int(r.s)
            if r.pos == 0:
                counts[r.cluster] += r.n
        before = centroids
        centroids = [[s // n for s in row] if n else old for row, n, old in zip(sums, counts, centroids, strict=True)]
    whole = held.where("n IS NULL")
    inertia = {r.cluster: int(r.s) for r in whole.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    by = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1)
    return whole.select(
        "vec_id", "cluster", "distance",
        by([min(inertia.get(j, 0), MOST) for j in range(k)], "long").alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), MOST)).cast("long").alias("inertia"),
        by([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids], "string").alias("centroid_sha256"),
    )


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    core.small_batches(spark)
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """Plain k-means: every distance of every round."""
    steps = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {DIMS}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1)::INT AS j, v AS c FROM v QUALIFY j < {k})"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT r, vec_id, v, j, d FROM (SELECT r, vec_id, v, j, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, c)])::BIGINT AS d FROM v, c{i})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)""")
        if i < rounds:
            steps.append(f"""
m{i} AS MATERIALIZED (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS c
  FROM (SELECT j, p, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range({DIMS})) AS p FROM a{i}) GROUP BY j, p) GROUP BY j),
c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (j))""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, j AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (j)"""  # fmt: skip


QUERIES = {"op12_centroid_clustering": op12_centroid_clustering}
SQL = {"op12_centroid_clustering": _sql()}
