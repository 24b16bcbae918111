"""Centroid clustering: Lloyd's rounds on integer vectors, exact and the same on any cluster.

Components are quantised once, in the JVM, into a table that every round reads.
The centroids (k vectors, whatever the input holds) are broadcast; tasks assign
their rows batch by batch and send one row of integer sums a cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import materialise, parquet

#: Components of this size or more aren't kept: 64 of their squared differences needn't fit a 64-bit integer.
LARGEST = 1 << 27


def quantised(vectors: DataFrame, dim: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v): the vectors with ``dim`` finite components, each as floor(scale * x)."""
    e = F.col("embedding").cast("array<double>")
    fit = (F.size("embedding") == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / scale))
    return vectors.where(fit).select("vec_id", F.transform(e, lambda x: F.floor(x * scale).cast("int")).alias("v"))


def first_by_hash(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, in that order; equal hashes go by components, rows without vec_id last.

    Hashes are uniform, so a share of them that holds some 16 times ``k`` rows is
    looked at first; only where it holds too few is it widened.
    """
    n = vectors.count()
    hashed = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    share = 16 * k / max(n, 1)
    while share < 1:
        low = hashed.where(F.col("h") < f"{int(share * (1 << 64)):016x}").orderBy("h", "v").limit(k).collect()
        if len(low) == k:
            return [r.v for r in low]
        share *= 16
    return [r.v for r in hashed.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each row; the lowest number of equals."""
    squared = np.empty((len(x), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        d = x - centroid
        squared[:, c] = np.einsum("ij,ij->i", d, d)
    best = squared.argmin(1)
    return best, squared[np.arange(len(x)), best]


def _rows(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame["v"].tolist(), np.int64)


def _sums(centroids: Broadcast):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, dim = centroids.value.shape
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for frame in frames:
            if len(frame):
                x = _rows(frame)
                best, _ = nearest(x, centroids.value)
                np.add.at(total, best, x)
                count += np.bincount(best, minlength=k)
        some = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": some.astype(np.int32), "n": count[some], "total": list(total[some])})

    return run


def _assigned(centroids: Broadcast, fields: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best, distance = nearest(_rows(frame), centroids.value) if len(frame) else ([], [])
            yield frame[[fields]].assign(cluster=np.asarray(best, np.int32), distance=np.asarray(distance, np.int64))

    return run


def moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Centroids after a round: floor of the mean of their vectors, those without vectors as they were.

    Sums of partitions are added as decimals, which no number of rows overflows; k rows reach the driver.
    """
    dim, out = centroids.shape[1], centroids.copy()
    add = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *add).collect():
        out[r.cluster] = [int(Decimal(r[f"s{i}"])) // r.n for i in range(dim)]
    return out


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", dim: int = 64, scale: int = 256) -> DataFrame:
    """Per kept row of ``vectors``: vec_id, cluster, distance, cluster_inertia, inertia, centroid (its final components), centroid_sha256.

    A row is kept if it has exactly ``dim`` components, none null or not finite
    or of a size of ``LARGEST / scale`` or more. Only vec_id and embedding are
    read. Repeated rows each count and get a row; rows without vec_id get one
    too, and start a centroid only where fewer than ``k`` have an id. With fewer
    than ``k`` kept rows there are as many centroids; with none, no rows.
    Vectors that are as near to two centroids go to the lower number.
    """
    spark = vectors.sparkSession
    kept = materialise(quantised(vectors, dim, scale))
    now = np.array(first_by_hash(kept, k, seed), np.int64).reshape(-1, dim)
    for _ in range(rounds if len(now) else 0):
        shared = spark.sparkContext.broadcast(now)
        now = moved(now, kept.select("v").mapInPandas(_sums(shared), "cluster int, n long, total array<long>"))
        shared.unpersist()
    id_type = dict(kept.dtypes)["vec_id"]
    last = materialise(kept.mapInPandas(_assigned(spark.sparkContext.broadcast(now), "vec_id"), f"vec_id {id_type}, cluster int, distance long"))
    own = last.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # at most k rows
    digest = [(c, v.tolist(), hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(now)]
    known = spark.createDataFrame(digest, "cluster int, centroid array<long>, centroid_sha256 string")
    facts = own.join(known, "cluster").crossJoin(own.agg(F.sum("cluster_inertia").alias("inertia")))  # at most k rows and one
    return last.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def op13_lloyd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(parquet(spark, sf_dir, "embeddings")).drop("centroid")


def _oracle(k: int, rounds: int, seed: str) -> str:
    """DuckDB: every round as components in rows."""
    parts = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v AS m FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        squared = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))"
        parts.append(f"a{r} AS (SELECT vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, v, c, {squared} AS d FROM v, c{r}) GROUP BY vec_id)")
        if r < rounds:
            parts.append(f"m{r} AS (SELECT c, list(f ORDER BY i) AS m FROM (SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS f FROM (SELECT c, unnest(range(64)) AS i, unnest(v) AS x FROM a{r}) GROUP BY c, i) GROUP BY c)")
            parts.append(f"c{r + 1} AS (SELECT c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN m{r} n USING (c))")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


ORACLE = _oracle(40, 5, "2")
