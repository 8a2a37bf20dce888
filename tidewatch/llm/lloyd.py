"""Centroid clustering by Lloyd's rounds in whole numbers, so that results do not depend on how vectors are dealt to tasks.

Components become floor(1024 x). A round broadcasts the centroids (K rows), mapInPandas takes the squared differences to
each of them in NumPy integers, argmin the smallest number among nearest ones; every partition gives at most K rows of
counts and component sums, which groupBy merges. The new centroid is the exact floor of sum over count.

Defined cases: vectors that are null, hold null or non-finite components or have another length take no part; rows that
share a vec_id, or have none, are vectors of their own (a null id counts as empty text where ids are hashed, and first
centroids of equal hashes go by their components); fewer than K vectors make as many centroids; a centroid without
vectors stays; other columns are ignored; an empty table gives an empty result. A component of LIMIT or more is an
error, as squared distances above it leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

DIMS, SCALE, K, ROUNDS, SALT = 64, 1024.0, 8, 10, "3:"
#: Components of so much times 1024 keep 64 squared differences, and the sums of 2**36 vectors, within 64 bits.
LIMIT = float(1 << 17)


def scaled(rows: DataFrame, dims: int = DIMS, scale: float = SCALE) -> DataFrame:
    """vec_id, v: the vectors that take part, as integers."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    sound = (F.size("embedding") == dims) & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(wide, lambda x: F.when(F.abs(x) < LIMIT, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component of {LIMIT} or more")).cast("long")))
    return rows.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long"), whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, salt: str = SALT) -> np.ndarray:
    """The k vectors of the smallest hashes of their ids, in ascending order."""
    h = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid, the smallest of several, and the squared distance to it."""
    squared = np.stack([np.square(x - c).sum(1) for c in centroids], 1)
    at = squared.argmin(1)
    return at, squared[np.arange(len(x)), at]


def summed(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """The count and the component sums of each centroid's vectors, K rows at most."""
    sent, dims = vectors.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = np.zeros(len(sent.value), np.int64), np.zeros(sent.value.shape, np.int64)
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["v"])
                at, _ = nearest(x, sent.value)
                n += np.bincount(at, minlength=len(n))
                for c in np.unique(at):
                    sums[c] += x[at == c].sum(0)
        held = np.flatnonzero(n)
        if len(held):
            yield pd.DataFrame({"cluster": held.astype(np.int32), "n": n[held], "sums": list(sums[held])})

    parts = vectors.select("v").mapInPandas(run, "cluster int, n long, sums array<long>")
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dims))).alias("sums")).collect()
    sent.destroy()
    return {r.cluster: (r.n, r.sums) for r in merged}


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                at, squared = nearest(np.stack(pdf["v"]), sent.value)
                yield pd.DataFrame({"vec_id": pdf["vec_id"].astype("Int64"), "cluster": at.astype(np.int32), "distance": squared})

    return vectors.mapInPandas(run, "vec_id long, cluster int, distance long")


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, salt: str = SALT) -> np.ndarray:
    """The centroids after all rounds."""
    centroids = first_centroids(vectors, k, salt)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, sums) in summed(vectors, centroids).items():
            centroids[c] = [s // n for s in sums]
    return centroids


def clusters(rows: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance of every vector that takes part, with its cluster's final centroid and sums of distances."""
    spark, kinds = rows.sparkSession, "cluster int, centroid array<long>, cluster_inertia long, inertia long"
    vectors = common.written(scaled(rows), "lloyd-vectors")
    centroids = fit(vectors, k, rounds)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, distance long, " + kinds)
    found = assigned(vectors, centroids)
    inertia = {r.cluster: r.x for r in found.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}
    total = sum(inertia.values())
    table = spark.createDataFrame([(c, centroids[c].tolist(), x, total) for c, x in inertia.items()], kinds)
    return found.join(F.broadcast(table), "cluster")  # K rows


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after ten rounds from eight hashed vectors."""
    found = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256).alias("centroid_sha256"))


_NEAREST = "d{i} AS MATERIALIZED (SELECT r, min({{'d': list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': c}}) AS x FROM k, c{i} GROUP BY r)"
_ROUND = """{near}, s{j} AS (SELECT x.c AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM d{i} JOIN k USING (r), range(1, 65) t(i) GROUP BY ALL),
c{j} AS MATERIALIZED (SELECT c, coalesce(m2, m) AS m FROM c{i} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m2 FROM s{j} GROUP BY c) USING (c))"""
ORACLE = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v AS m FROM k ORDER BY c LIMIT 8),
{", ".join(_ROUND.format(near=_NEAREST.format(i=i), i=i, j=i + 1) for i in range(ROUNDS))}, {_NEAREST.format(i=ROUNDS)}
SELECT vec_id, CAST(x.c AS INTEGER) AS cluster, CAST(x.d AS BIGINT) AS distance, CAST(sum(x.d) OVER (PARTITION BY x.c) AS BIGINT) AS cluster_inertia, CAST(sum(x.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM d{ROUNDS} JOIN k USING (r) JOIN c{ROUNDS} ON c = x.c"""
