"""Operator 13, centroid clustering by scalar lookup tables.

Vectors are turned into integers once.  In a round, every batch of vectors tabulates, for
each dimension, the squared difference between each integer that occurs there and each
centroid; a vector's distances are then gathers from these tables and their sum.  So a
difference is squared once for each occurring value, not for each vector, and the tables
hold no more than a batch has values.  A task adds up its vectors by cluster and sends one
row for each; those sums, ``k`` rows in all, give the next centroids on the driver.

Defined results: vectors that are null, of another length, or holding a null or non-finite
component take no part, nor do those with an integer beyond +-2**27 (their squared
distance may not fit a long); fewer vectors than ``k`` give so many centroids; starting
vectors come by hash, equal hashes (repeated ids) by their integers; a row without an id
is clustered but is no starting vector; a repeated row counts as often as it stands; other
columns are ignored; an empty table gives no rows.  Sums are exact at any number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import load, written

DIMS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
LARGEST = 1 << 27


def quantise(rows: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): the kept vectors as integers floor(scale * component)."""
    inf = F.lit(float("inf"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < inf, F.lit(False)))
    kept = rows.select("vec_id", "embedding").where((F.size("embedding") == dims) & finite)
    inside = F.forall("embedding", lambda x: F.abs(x.cast("double") * scale) < LARGEST)
    return kept.where(inside).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("q"))


def starting(vectors: DataFrame, k: int = CLUSTERS, seed: str = "1") -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of seed and id, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id is not null").orderBy(key, "q").limit(k).select("q").collect()  # at most k rows
    return np.array([r["q"] for r in first], np.int64)


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of integers; ties: the smaller number."""
    total = np.zeros((len(values), len(centroids)), np.int64)
    for d in range(values.shape[1]):
        occurring, place = np.unique(values[:, d], return_inverse=True)
        table = (occurring.astype(np.int64)[:, None] - centroids[None, :, d]) ** 2
        total += table[place]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(values)), cluster]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(centroids: np.ndarray):
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            values = _matrix(b.column("q"), dims)
            cluster, _ = nearest(values, centroids)
            counts += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            met, first = np.unique(cluster[order], return_index=True)
            if len(met):
                sums[met] += np.add.reduceat(values[order].astype(np.int64), first, axis=0)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), pa.array(counts[met], pa.int64()), pa.array(list(sums[met]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])
    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; a centroid without vectors stays."""
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    parts = vectors.select("q").mapInArrow(_sums(centroids), "cluster int, n bigint, sums array<bigint>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[exact(F.col("sums")[d]) for d in range(centroids.shape[1])]).alias("sums"))
    out = centroids.copy()
    for row in totals.collect():  # one row for each centroid
        out[row["cluster"]] = [int(s) // row["n"] for s in row["sums"]]
    return out


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance = nearest(_matrix(b.column("q"), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])
    return run


def cluster(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the last centroids."""
    vectors = written(quantise(rows, dims, scale), "quantised")
    centroids = starting(vectors, k, seed)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0), np.zeros((0, dims), np.int64)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint"
    return written(vectors.mapInArrow(_assign(centroids), schema), "clusters"), centroids


def op13_scalar_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(load(spark, sf_dir, "embeddings"))
    inertia = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digest = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    # a row for each centroid
    digests = spark.createDataFrame(digest, "cluster int, centroid_sha256 string")
    per_cluster = {r["cluster"]: r["cluster_inertia"] for r in inertia.collect()}
    totals = spark.createDataFrame([(c, n, sum(per_cluster.values())) for c, n in per_cluster.items()], "cluster int, cluster_inertia bigint, inertia bigint")
    facts = digests.join(F.broadcast(totals), "cluster")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds(n: int) -> str:
    """SQL of ``n`` rounds: centroids c1..cn after c0."""
    out = []
    for i in range(n):
        out.append(f"""
a{i} AS MATERIALIZED ({_assigned(f"c{i}")}),
m{i} AS MATERIALIZED (
  SELECT cluster, dim, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} JOIN p USING (nr) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, c.dim, CASE WHEN m.n IS NULL THEN c.v ELSE ((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::BIGINT END AS v
  FROM c{i} c LEFT JOIN m{i} m ON c.cluster = m.cluster AND c.dim = m.dim),""")
    return "".join(out)


def _assigned(centroids: str) -> str:
    return f"""SELECT nr, arg_min(cluster, d * 16 + cluster) AS cluster, min(d) AS distance FROM (
  SELECT nr, cluster, sum((p.v - c.v) * (p.v - c.v))::BIGINT AS d FROM p JOIN {centroids} c USING (dim) GROUP BY ALL) GROUP BY nr"""


OP13_SQL = f"""
WITH r AS MATERIALIZED (
  SELECT row_number() OVER () AS nr, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
p AS MATERIALIZED (SELECT nr, unnest(range(1, 65)) AS dim, floor(64 * unnest(e)::DOUBLE)::BIGINT AS v FROM r),
s AS (SELECT nr, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS cluster FROM r QUALIFY cluster < 16),
c0 AS MATERIALIZED (SELECT cluster, dim, v FROM s JOIN p USING (nr)),
{_rounds(ROUNDS)}
z AS MATERIALIZED ({_assigned(f"c{ROUNDS}")}),
digest AS (SELECT cluster, sha256(string_agg(v::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM z JOIN r USING (nr) JOIN digest USING (cluster)
"""
