"""Centroid clustering: plain Lloyd over whole-number vectors.

The centroids, of which there are `k`, are broadcast. Each round maps the vectors through
NumPy, a block at a time: the squared differences to one centroid after another, and the
first of the smallest. A partition gives a row for each cluster and dimension, with the number
of its vectors and the sum of their components, and these rows meet in a groupBy. The driver
gets a sum for each component of a centroid a round, whatever the number of vectors, and the
vectors are read where they lie: none is shuffled.

All sums and distances are whole numbers, so results do not depend on the order or the
number of partitions. Blocks are computed in 32 or 64 bits where that is exact, and in
Python's numbers otherwise.

Cases: vectors that are null, of another length, or with a null or non-finite component
take no part. A component whose multiple is beyond 64 bits counts as the nearest such
number; a distance or an inertia beyond 64 bits is given as the largest. Ids are only
carried and hashed: repeated rows count as often as they are there, and are each a
starting centroid if their hash is among the smallest; rows without an id take part but
come last in that order. Equal hashes are in the order of the vectors. With fewer vectors
than k, each is a centroid at first. Ties of distance go to the smaller number. An empty
table gives no rows. Further columns may have any name; they are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import ship, staged

K, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
#: Vectors whose differences are computed at once.
BLOCK = 2048
_MOST = (1 << 63) - 1


def quantised(embedding: str = "embedding", scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(embedding: str = "embedding", dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has exactly so many components, all of them finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(embedding) == dimensions) & ~F.exists(embedding, bad), F.lit(False))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The vectors with the k smallest SHA-256 of `seed:id`, in the order of these."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["vec"]) for r in vectors.select(key.alias("h"), "vec").orderBy(F.col("h").asc_nulls_last(), "vec").limit(k).collect()]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid, and the squared distance to it, of each vector (whole numbers, exact)."""
    reach = max((int(abs(int(m))) for a in (vectors, centroids) for m in (a.min(), a.max())), default=0)
    bound = 4 * reach * reach * vectors.shape[1]
    kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object
    cluster, least = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), kind)
    for at in range(0, len(vectors), BLOCK):
        block = vectors[at : at + BLOCK].astype(kind)
        distances = np.empty((len(centroids), len(block)), kind)
        for c, centroid in enumerate(centroids.astype(kind)):
            difference = block - centroid
            distances[c] = (difference * difference).sum(1) if kind is object else np.einsum("ij,ij->i", difference, difference)
        own = distances.argmin(0)  # the first of the smallest
        cluster[at : at + BLOCK], least[at : at + BLOCK] = own, distances[own, np.arange(len(block))]
    return cluster, least


def _long(numbers: np.ndarray) -> np.ndarray:
    return (np.minimum(numbers, _MOST) if numbers.dtype == object else numbers).astype(np.int64)


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.int64)


def partial_sums(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """For each partition, cluster and dimension d: how many vectors (n) and the sum of their components (total)."""
    spark = vectors.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(np.array(centroids, np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = shared.value
        k, dims = numbers.shape
        counts, sums = [0] * k, [[0] * dims for _ in range(k)]
        for batch in batches:
            if not len(batch):
                continue
            rows = _stack(batch["vec"])
            cluster, _ = nearest(rows, numbers)
            wide = int(max(abs(int(rows.min())), abs(int(rows.max())))) * len(rows) >= 1 << 63
            for c in np.unique(cluster).tolist():
                own = rows[cluster == c]
                counts[c] += len(own)
                sums[c] = [a + b for a, b in zip(sums[c], own.astype(object if wide else np.int64).sum(0).tolist(), strict=True)]
        used = [c for c in range(k) if counts[c]]
        rows = [(c, d, counts[c], Decimal(x)) for c in used for d, x in enumerate(sums[c])]
        yield pd.DataFrame(rows, columns=["cluster", "d", "n", "total"])

    return vectors.select("vec").mapInPandas(run, "cluster int, d int, n long, total decimal(38,0)")


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """Centroids after so many rounds, from vectors (vec_id, vec: array of long of one length)."""
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return centroids
    for _ in range(rounds):
        merged = partial_sums(vectors, centroids).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        moved = [list(c) for c in centroids]
        for r in merged.collect():  # a row for each component of a centroid at most
            moved[r["cluster"]][r["d"]] = int(r["total"]) // r["n"]
        centroids = moved
    return centroids


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster and distance (squared) of each vector."""
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
    shared = spark.sparkContext.broadcast(np.array(centroids, np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cluster, distance = nearest(_stack(batch["vec"]), shared.value)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": cluster.astype(np.int32), "distance": _long(distance)})

    return vectors.select("vec_id", "vec").mapInPandas(run, f"vec_id {kind}, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Lloyd's rounds, then each vector with its cluster, its squared distance, the inertia of its cluster and of all, and the digest of its centroid."""
    spark = vectors.sparkSession
    centroids = fit(vectors, k, rounds, seed)
    rows = staged(assigned(vectors, centroids), "clusters")  # narrow; read again for the sums over all
    long = lambda c: F.least(c, F.lit(Decimal(_MOST))).cast("long")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_own"))  # a row a cluster
    whole = sums.agg(F.sum("_own").alias("_all"))
    forms = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids)], "cluster int, _form string")
    facts = sums.crossJoin(F.broadcast(whole)).join(F.broadcast(forms), "cluster").select(
        "cluster", long(F.col("_own")).alias("cluster_inertia"), long(F.col("_all")).alias("inertia"), F.sha2("_form", 256).alias("centroid_sha256")
    )
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def lloyd_sql(k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in DuckDB's SQL over the table embeddings: a step an assignment, a step a round's centroids."""
    steps = [f"""
        kept AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
            FROM embeddings
            WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        flat AS (SELECT vec_id, unnest(range({dimensions})) AS d, unnest(vec) AS x FROM kept),
        c0 AS (
            SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, vec
            FROM kept ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
        p{i} AS MATERIALIZED (SELECT c, unnest(range({dimensions})) AS d, unnest(vec) AS y FROM c{i}),
        a{i} AS MATERIALIZED (
            SELECT vec_id, c, dist FROM (
                SELECT vec_id, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS dist FROM flat JOIN p{i} USING (d) GROUP BY vec_id, c)
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, c) = 1)""")
        if i < rounds:
            steps.append(f"""
        m{i} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM a{i} JOIN flat USING (vec_id) GROUP BY c, d),
        n{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY d) AS vec FROM m{i} GROUP BY c),
        c{i + 1} AS (SELECT c, coalesce(n{i}.vec, c{i}.vec) AS vec FROM c{i} LEFT JOIN n{i} USING (c))""")
    return f"""
        WITH {",".join(steps)}
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, dist AS distance,
               CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(vec, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (c)
    """
