"""Approximate nearest neighbours by cosine: randomly rotated one-bit codes with error bounds.

Each vector is brought to length 1 and turned by a random rotation; of the result only the
signs are kept, packed into bits, and one correction scalar: the inner product of the
vector with the vector of its signs (components +-1 / sqrt(dimensions)). The inner product
of a query with the signs, divided by that scalar, estimates the cosine without bias, and
the scalar bounds the error: with c the scalar, it is within
EPSILON * sqrt((1 - c^2) / (c^2 * (dimensions - 1))) but for a small share of vectors.

Search: queries and coded vectors meet in the cells of a grid, groups of bounded size of
each. In a cell, every coded vector gets its estimate; a vector whose estimate plus bound
is under the query's floor is left alone, the others are ranked again by their exact
cosine. The floor starts from a bounded sample of candidates that all queries meet, and
rises by the exact cosines of the vectors with the best estimates. A cell gives at most
k rows a query.

Every distinct vector is coded once; of the ids that share it, the k + 1 smallest are kept
with it, since no others can be among the k best of any query. So copies, however many,
are one candidate. Nothing is fitted but the rotation, which a seed gives.

Cases: vectors that are null, empty, zero, or have a null or non-finite component take no
part, nor do rows without an id. Only vectors of the same length meet. Rows with the
query's own id are no candidates for it. Rows that repeat an id and a vector count once;
different vectors under one id are separate candidates, and ask together. With fewer
candidates than k all that are found are returned. Ties go to the smaller id. An empty
table gives no rows. Further columns may have any name; they are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import map_text
from millrace.session import ship, staged

K = 5
#: How many times the standard width of the error a bound allows for.
EPSILON = 2.2
SEED = 11
QUERY_GROUP, CANDIDATE_GROUP = 16384, 65536
#: Groups of candidates are at least so many, so that small tables use all cores.
LEAST_GROUPS = 24
#: Queries whose estimates are held at once.
QUERIES_AT_ONCE = 64
#: Candidates, drawn by hash, that give every query its first floor.
FLOOR_SAMPLE = 512


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector has components, all finite and not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(embedding) > 0) & ~F.exists(embedding, bad) & F.exists(embedding, lambda x: x != 0), F.lit(False))


@functools.lru_cache(maxsize=8)
def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    """A random rotation: the orthogonal factor of a matrix of normal numbers, its signs made certain."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dimensions]).standard_normal((dimensions, dimensions)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A row a vector, in double, each divided by a power of 2 that makes its largest component about 1 (which changes no cosine)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(m, -np.frexp(np.abs(m).max(1, keepdims=True))[1])


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(1))


def signs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: the packed signs after rotation, and the inner product of each with the vector of its signs."""
    turned = m @ rotation(m.shape[1])
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / math.sqrt(m.shape[1])


def index(vectors: DataFrame, k: int = K) -> DataFrame:
    """vec, ids (the k + 1 smallest), code and correction of each distinct vector of (vec_id, vec)."""
    once = vectors.select("vec_id", "vec").dropDuplicates()
    order = Window.partitionBy("vec").orderBy("vec_id")  # cut to k + 1 before the shuffle already
    firsts = once.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    distinct = firsts.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            codes, corrections = [b""] * b.num_rows, np.zeros(b.num_rows)
            sizes = b.column(0).value_lengths().to_numpy()
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                m = _matrix(b.column(0).take(pa.array(own)))
                packed, corrections[own] = signs(m / _lengths(m)[:, None])
                for i, row in zip(own.tolist(), packed, strict=True):
                    codes[i] = row.tobytes()
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary()), pa.array(corrections)], names=["vec", "ids", "code", "correction"])

        return batch

    kind = dict(vectors.dtypes)["vec"]
    return map_text(distinct.select("vec", "ids"), f"vec {kind}, ids array<long>, code binary, correction double", make)


class _Best:
    """The k best (score, id) of a query so far, by falling score, then rising id."""

    def __init__(self, own: int, k: int):
        self.own, self.k = own, k
        self.rows: list[tuple[float, int]] = []

    def take(self, scores: np.ndarray, ids: list[list[int]]) -> None:
        found = [(-s, i) for s, own in zip(scores.tolist(), ids, strict=True) for i in own if i != self.own]
        self.rows = sorted(self.rows + found)[: self.k]

    def floor(self) -> float:
        return -self.rows[-1][0] if len(self.rows) == self.k else -math.inf


def _cosines(query: np.ndarray, vectors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors have equal scores."""
    return (vectors * query).sum(1) / (lengths * math.sqrt((query * query).sum()))


def search_block(
    query_ids: list[int], queries: np.ndarray, floors: np.ndarray, ids: list[list[int]], vectors: np.ndarray, codes: np.ndarray, corrections: np.ndarray,
    k: int, epsilon: float,
) -> list[tuple[int, int, float]]:
    """The best k of one group of coded vectors for each query as (query_id, vec_id, score), as far as they reach its floor."""
    dims = vectors.shape[1]
    lengths = _lengths(vectors)
    bits = (np.unpackbits(codes, axis=1, count=dims).astype(np.float32) * 2 - 1).T / np.float32(math.sqrt(dims))
    bound = epsilon * np.sqrt(np.maximum(1 - corrections**2, 0) / (corrections**2 * max(dims - 1, 1))) + 1e-6
    turned = ((queries / _lengths(queries)[:, None]) @ rotation(dims)).astype(np.float32)
    found = []
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        estimates = (turned[at : at + QUERIES_AT_ONCE] @ bits) / corrections.astype(np.float32)
        for i, estimate in enumerate(estimates, at):
            best = _Best(query_ids[i], k)
            floor = floors[i]
            chosen = np.flatnonzero(estimate + bound >= floor)
            if len(chosen) > 2 * k:  # the best by estimate raise the floor
                split = np.argpartition(-estimate[chosen], 2 * k)
                first, chosen = chosen[split[: 2 * k]], chosen[split[2 * k :]]
                best.take(_cosines(queries[i], vectors[first], lengths[first]), [ids[j] for j in first])
                floor = max(floor, best.floor())
                chosen = chosen[estimate[chosen] + bound[chosen] >= floor]
            scores = _cosines(queries[i], vectors[chosen], lengths[chosen])
            reach = scores >= floor
            best.take(scores[reach], [ids[j] for j in chosen[reach]])
            found += [(query_ids[i], j, -s) for s, j in best.rows if -s >= floors[i]]
    return found


def _cell(k: int, epsilon: float):
    """Searches one group of queries (vec_id, vec, floor) in one group of the index."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        left, right = left.combine_chunks(), right.combine_chunks()
        if left.num_rows and right.num_rows:
            pick = lambda t: t.column("vec").combine_chunks().value_lengths().to_numpy()
            sizes_l, sizes_r = pick(left), pick(right)
            for size in np.intersect1d(sizes_l, sizes_r):
                q, c = left.filter(pa.array(sizes_l == size)), right.filter(pa.array(sizes_r == size))
                floors = np.array([-math.inf if f is None else f for f in q.column("floor").to_pylist()])
                codes = np.frombuffer(b"".join(c.column("code").to_pylist()), np.uint8).reshape(c.num_rows, -1)
                found += search_block(
                    q.column("vec_id").to_pylist(), _matrix(q.column("vec")), floors, c.column("ids").to_pylist(), _matrix(c.column("vec")), codes,
                    c.column("correction").to_numpy(), k, epsilon,
                )
        return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def search(queries: DataFrame, coded: DataFrame, k: int = K, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of each query's k nearest found; queries (vec_id, vec), and what index() made with the same k."""
    ship(coded.sparkSession)
    queries = staged(queries.select("vec_id", "vec").dropDuplicates(), "ann-queries")
    coded = staged(coded.select("vec", "ids", "code", "correction"), "ann-index")
    size, asked = coded.count(), queries.count()
    rows = max(1, -(-asked // QUERY_GROUP))
    columns = max(1, -(-size // CANDIDATE_GROUP), min(LEAST_GROUPS, -(-size // 256)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    draw = lambda c, n, salt: F.pmod(F.xxhash64(F.col(c), F.lit(salt)), F.lit(n)).cast("int")
    result = "query_id long, vec_id long, score double"

    # A bounded sample meets all queries first: the k-th best score of it is a floor for each query.
    share = int(min(1.0, FLOOR_SAMPLE / max(1, size)) * (1 << 30))
    spread = max(rows, min(LEAST_GROUPS, -(-asked // 8)), 1)
    sample = coded.where(draw("vec", 1 << 30, 2) < share).withColumn("g", every(spread))
    asking = queries.withColumn("floor", F.lit(None).cast("double")).withColumn("g", draw("vec_id", spread, 3))
    tried = asking.groupBy("g").cogroup(sample.groupBy("g")).applyInArrow(_cell(k, math.inf), result)
    floors = tried.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))  # an id that asks with several vectors has none

    ready = queries.join(floors, queries["vec_id"] == floors["query_id"], "left").select("vec_id", "vec", "floor")
    cells = (
        ready.withColumn("qg", draw("vec_id", rows, 4)).withColumn("cg", every(columns)).groupBy("qg", "cg")
        .cogroup(coded.withColumn("cg", draw("vec", columns, 5)).withColumn("qg", every(rows)).groupBy("qg", "cg"))
        .applyInArrow(_cell(k, epsilon), result)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = cells.dropDuplicates()  # the same neighbour of several vectors of one id, at the same score
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
