"""Exact top-k search by columnar branch and bound.

Vectors are kept dimension by dimension (one row of a matrix a dimension). Inner
products are accumulated one block of dimensions after another; what the rest can
still add is at most the product of the two rests' lengths, so a candidate whose
bound is under the k-th best score that is certain by then is dropped, and the
columns of the survivors are compacted for the next block.

Queries and candidates meet in the cells of a grid: queries are dealt into groups
of at most QUERY_GROUP, candidates into groups of at most CANDIDATE_GROUP, and a
cell holds one group of each. Each cell gives at most k rows a query, and starts
from a floor that a bounded sample of candidates gives each query, so that most
cells give fewer.

Cases: vectors that are null, empty, or have a null or non-finite component take
no part, nor do rows without an id. Only vectors of the same length meet. Rows
with the query's own id are no candidates for it. With fewer than k candidates
all are returned. Rows that repeat an id are separate candidates; as queries they
ask together, each distinct vector once, for the k best scores of all. Ties go to
the smaller id. Scores beyond 64 bits wrap round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import ship, staged

K = 5
SCALE = 256
QUERY_GROUP, CANDIDATE_GROUP = 16384, 65536
#: Groups of candidates are at least so many, so that small tables use all cores.
LEAST_GROUPS = 24
#: Queries whose first block is multiplied at once.
QUERIES_AT_ONCE = 64
#: Dimensions of a block.
BLOCK = 16
#: Candidates, drawn by hash, that give every query its floor.
FLOOR_SAMPLE = 512


def quantised(embedding: str = "embedding", scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(embedding: str = "embedding") -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(embedding) > 0) & ~F.exists(embedding, bad), F.lit(False))


def _stack(vectors: pd.Series) -> np.ndarray:
    """One row a vector: whole numbers as doubles where all sums of their products are exact, else as int64."""
    m = np.array(vectors.tolist(), np.int64)
    exact = m.size == 0 or float(np.abs(m).max()) ** 2 * m.shape[1] < 2.0**52
    return m.astype(np.float64) if exact else m


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int, floors: np.ndarray | None = None
) -> list[tuple[int, int, int]]:
    """The best k of one group of candidates for each query as (query_id, vec_id, score); at least `floors`."""
    order = np.argsort(-np.abs(queries).mean(0), kind="stable")  # heavy dimensions first
    columns = np.ascontiguousarray(candidates[:, order].T)
    queries = queries[:, order]
    dims = len(order)
    cuts = list(range(0, dims, BLOCK)) + [dims]
    # Lengths of what is left after each block, of candidates and queries, rounded up.
    left = [np.sqrt((columns[c:].astype(np.float64) ** 2).sum(0)) for c in cuts[1:]]
    left_q = [np.sqrt((queries[:, c:].astype(np.float64) ** 2).sum(1)) for c in cuts[1:]]
    found = []
    for i, query_id in enumerate(query_ids):
        if i % QUERIES_AT_ONCE == 0:
            first = queries[i : i + QUERIES_AT_ONCE, : cuts[1]] @ columns[: cuts[1]]
        alive = np.flatnonzero(ids != query_id)
        partial = first[i % QUERIES_AT_ONCE, alive]
        least = -np.inf if floors is None else floors[i]
        for b in range(1, len(cuts)):
            slack = left[b - 1][alive] * left_q[b - 1][i] * (1 + 1e-9) + 1e-6
            if len(alive) > k:
                least = max(least, np.partition(partial - slack, len(alive) - k)[len(alive) - k])
            keep = partial + slack >= least
            alive, partial = alive[keep], partial[keep]
            if b < len(cuts) - 1:
                c, d = cuts[b], cuts[b + 1]
                partial = partial + queries[i, c:d] @ columns[c:d, alive]
        best = np.lexsort((ids[alive], -partial))[:k]
        found += [(int(query_id), int(ids[alive[j]]), int(partial[j])) for j in best]
    return found


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score (inner product) of each query's k best candidates.

    Both tables have vec_id and vec (array of long without nulls).
    """
    spark = candidates.sparkSession
    ship(spark)
    queries = staged(queries.select("vec_id", "vec").dropDuplicates(), "queries")
    size, asked = candidates.count(), queries.count()
    rows = max(1, -(-asked // QUERY_GROUP))
    columns = max(1, -(-size // CANDIDATE_GROUP), min(LEAST_GROUPS, -(-size // 256)))
    dealt = F.xxhash64("vec_id")
    q = queries.withColumn("qg", F.pmod(dealt, F.lit(rows)).cast("int"))
    c = candidates.select("vec_id", "vec", F.pmod(dealt, F.lit(columns)).cast("int").alias("cg"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        for length, qs in left.groupby(left["vec"].str.len()):
            cs = right[right["vec"].str.len() == length]
            if len(cs):
                floor = qs["floor"].astype("float64").fillna(-np.inf).to_numpy() if "floor" in qs else None
                found += search_block(qs["vec_id"].to_numpy(), _stack(qs["vec"]), cs["vec_id"].to_numpy(), _stack(cs["vec"]), k, floor)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    result = "query_id long, vec_id long, score long"
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A bounded sample of candidates meets all queries first: its k-th best score is a floor for each query.
    sample = c.where(F.pmod(F.xxhash64("vec_id", F.lit("floor")), F.lit(1 << 30)) < int(min(1.0, FLOOR_SAMPLE / max(1, size)) * (1 << 30)))
    spread = max(1, min(LEAST_GROUPS, -(-asked // 8)))
    q_spread = queries.withColumn("g", F.pmod(dealt, F.lit(max(spread, rows))).cast("int"))
    scores = (
        q_spread.groupBy("g").cogroup(sample.withColumn("g", every(max(spread, rows))).groupBy("g"))
        .applyInPandas(cell, result)
    )
    floors = scores.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    ready = q.join(floors, q["vec_id"] == floors["query_id"], "left").select("vec_id", "vec", "qg", "floor")
    cells = (
        ready.withColumn("cg", every(columns)).groupBy("qg", "cg")
        .cogroup(c.withColumn("qg", every(rows)).groupBy("qg", "cg"))
        .applyInPandas(cell, result)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
