"""Exact integer k-means with Elkan's bounds.

Each vector keeps, from round to round, its cluster, an upper bound of its distance to that cluster's centroid and a lower
bound of its distance to every centroid. After a round the centroids' shifts loosen the bounds; a centroid is skipped where
its lower bound, or half its distance from the vector's own centroid, is over the upper bound. What is not skipped is
computed in integers. Bounds are floats that are rounded to the safe side, and only a strict excess skips, so a tie with a
centroid of a smaller number is always computed and seen.

Scale: the vectors and their bounds are a written table for each round, which takes the last one's place; a round is one
pass without a shuffle, and one partial sum a cluster and task for the new centroids. Only centroids go to the driver:
k x 64 sums, whatever the input.

Defined cases: vectors that are null, of another length, or with a component that is null or not finite are left out, and
so are those with an integer component beyond +-2 ** 27, since squared distances of these need not fit a long; repeated ids
are vectors of their own; equal hashes are ordered by components; a null id has no hash and comes last; under k vectors are as
many centroids; an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import deleted, fresh_path

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1
LARGEST = 1 << 27
STATE = "vec_id long, x array<int>, cluster int, distance long, upper float, lower array<float>"


def up(x: np.ndarray) -> np.ndarray:
    """Square roots as 32-bit floats that are no smaller; `down` no larger."""
    return np.nextafter(np.nextafter(np.sqrt(np.asarray(x, np.float64)), np.inf).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(np.asarray(x, np.float64)), -np.inf).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def more(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a + b, rounded up; `less`: a - b, rounded down, 0 at least."""
    return np.nextafter(a + b, np.float32(np.inf))


def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(a - b, np.float32(-np.inf)), np.float32(0))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """Centroids as integers, half the distances between them, rounded down, and how far each has come, rounded up."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now
        self.half = np.stack([down(squared(now, c)) for c in now]) / np.float32(2)
        self.shift = np.zeros(len(now), np.float32) if before is None else np.where((now == before).all(1), np.float32(0), up(squared(now, before)))


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, squared distance or -1 where it was not needed, upper, lower, distances computed). cluster: any to start with."""
    cluster, upper, lower = cluster.copy(), more(upper, c.shift[cluster]), less(lower, c.shift[None, :])
    distance, computed = np.full(len(x), -1, np.int64), 0
    for k in range(len(c.now)):
        open_ = np.flatnonzero((cluster != k) & (lower[:, k] <= upper) & (c.half[cluster, k] <= upper))
        # The own distance first, where it is not known yet: it may close the case.
        loose = open_[distance[open_] < 0]
        if len(loose):
            distance[loose] = squared(x[loose], c.now[cluster[loose]])
            upper[loose] = up(distance[loose])
            lower[loose, cluster[loose]] = down(distance[loose])
            open_ = open_[(lower[open_, k] <= upper[open_]) & (c.half[cluster[open_], k] <= upper[open_])]
            computed += len(loose)
        if not len(open_):
            continue
        d = squared(x[open_], c.now[k])
        computed += len(open_)
        lower[open_, k] = down(d)
        nearer = (d < distance[open_]) | ((d == distance[open_]) & (k < cluster[open_]))
        won = open_[nearer]
        cluster[won], distance[won], upper[won] = k, d[nearer], up(d[nearer])
    return cluster, distance, upper, lower, computed


def vectors(table: DataFrame, column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the vectors that are kept, as integers."""
    v = F.col(column)
    fits = (F.size(v) == dimensions) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * scale) <= float(LARGEST)))
    return table.filter(F.coalesce(fits, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda e: F.floor(e.cast("double") * scale).cast("int")).alias("x"))


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def round_of(state: DataFrame, c: Centroids, last: bool, dimensions: int) -> DataFrame:
    """state (STATE) after one more assignment; after the last one all distances are told."""
    k = len(c.now)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), np.int64, dimensions)
            cluster, distance, upper, lower, _ = assign(x, b.column(2).to_numpy().astype(np.int64), b.column(4).to_numpy().astype(np.float32), matrix(b.column(5), np.float32, k), c)
            rest = np.flatnonzero(distance < 0) if last else []
            if len(rest):
                distance[rest] = squared(x[rest], c.now[cluster[rest]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(upper, pa.float32()), lists(lower, pa.float32())], ["vec_id", "x", "cluster", "distance", "upper", "lower"])

    return state.mapInArrow(assigned, STATE)


def means(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """The centroids of the clusters as they are now: exact floors; an empty one stays."""
    k, dimensions = now.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, cluster = matrix(b.column(0), np.int64, dimensions), b.column(1).to_numpy()
            for i in np.unique(cluster):
                own = cluster == i
                total[i] += x[own].sum(0)
                count[i] += own.sum()
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some], pa.int64()), lists(total[some], pa.int64())], ["cluster", "n", "total"])

    parts = state.select("x", "cluster").mapInArrow(sums, "cluster int, n long, total array<long>")
    out = now.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[j]) for j in range(dimensions)]).alias("total")).collect():
        out[r.cluster] = [t // r.n for t in r.total]
    return out


def fitted(table: DataFrame, column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(a written table of vec_id, cluster, distance; the centroids)."""
    spark = table.sparkSession
    kept = vectors(table, column, dimensions, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(digest.alias("digest"), "x").orderBy(F.col("digest").asc_nulls_last(), "x").limit(clusters).collect()
    now = np.array([r.x for r in first], np.int64).reshape(-1, dimensions)
    if not len(now):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), now
    unknown = F.array_repeat(F.lit(0.0).cast("float"), len(now))
    state, at, before = kept.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(-1).cast("long").alias("distance"), F.lit(float("inf")).cast("float").alias("upper"), unknown.alias("lower")), None, None
    for r in range(rounds + 1):
        after = fresh_path(spark, f"round{r}")
        done = round_of(state, Centroids(now, before), r == rounds, dimensions)
        (done.select("vec_id", "cluster", "distance") if r == rounds else done).write.parquet(after)
        state = spark.read.parquet(after)
        if at is not None:
            deleted(spark, [at])
        at = after
        if r < rounds:
            before, now = now, means(state, now)
    return state, now


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, with the sums of distance over the cluster and over all, and the final centroid's digest."""
    spark = assigned.sparkSession
    own = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(i, own[i], sum(own.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids) if i in own]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*fitted(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))


def oracle(rounds: int = ROUNDS, clusters: int = CLUSTERS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same as SQL: every distance of every round, without bounds."""
    span = f"range(1, {dimensions + 1})"
    parts = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * {scale}) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e) AND abs(CAST(e AS DOUBLE) * {scale}) <= {LARGEST})) = {dimensions})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1 AS c, x AS m FROM k ORDER BY c LIMIT {clusters})",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT r, c, list_sum(list_transform({span}, lambda i: (x[i] - m[i]) * (x[i] - m[i]))) AS d FROM k, c{r})")
        parts.append(f"a{r} AS MATERIALIZED (SELECT k.r, any_value(vec_id) AS vec_id, any_value(x) AS x, min(d) AS d, arg_min(c, d * 1000 + c) AS c FROM d{r} JOIN k ON k.r = d{r}.r GROUP BY k.r)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT c, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest({span}) AS j) GROUP BY c, j)")
            parts.append(f"u{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM s{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(u{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN u{r} ON u{r}.c = c{r}.c)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a{rounds}.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON a{rounds}.c = c{rounds}.c"""


ORACLE_SQL = oracle()
