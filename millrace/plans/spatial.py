"""Spatial and model queries: nations are cells of a grid of 5 by 5, 5 km wide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import flows, spatial, stats
from millrace.plans import fits
from millrace.plans.flows import _A, _LINES, area_code, codes, summed
from millrace.session import table

METRES = 5000
PERMUTATIONS = 199


def cells(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, d, "nation").select(area_code("n_nationkey").alias("code"), (key % 5).alias("cx"), F.floor(key / 5).cast("int").alias("cy"), key.alias("key"))


def areas(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).select("code", (F.col("cx") * METRES).cast("double").alias("x"), (F.col("cy") * METRES).cast("double").alias("y"))


def mass(spark: SparkSession, d: str) -> DataFrame:
    return flows.destination_mass(summed(spark, d), areas(spark, d).select("code"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return spatial.touching(spatial.cell_vertices(cells(spark, d)))


def balances(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 2).alias("value"))
    return by.select(area_code("c_nationkey").alias("code"), "value")


def islands(spark: SparkSession, d: str) -> DataFrame:
    some = cells(spark, d).where("key % 4 = 0 OR key = 1")
    return spatial.islands(some, spatial.touching(spatial.cell_vertices(some)))


def model_frame(spark: SparkSession, d: str) -> DataFrame:
    """Per area: people with a fixed workplace as counts, employed people as exposure, and two standardised predictors."""
    everywhere = areas(spark, d).select("code")
    totals = flows.origin_aggregates(summed(spark, d), everywhere)
    access = spatial.gravity_access(areas(spark, d), mass(spark, d), (5,))
    raw = totals.join(access, "origin").select(
        "origin", "fixed", "employed", "home",
        F.log1p("access_5km").alias("log_access"), (F.col("home") / F.col("employed")).alias("home_share"),
    )
    return stats.standardised(raw, ["log_access", "home_share"])


def part_frame(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select("p_partkey", "p_size", (F.col("p_partkey") % 10).alias("digit"), F.length("p_name").alias("name_length"), F.col("p_retailprice").alias("price"))


def ridge(spark: SparkSession, d: str) -> DataFrame:
    fit = stats.fit_ridge(part_frame(spark, d), ["p_size", "digit", "name_length"], "price", 4.0)
    rows = [("intercept", fit.intercept), *zip(fit.columns, fit.weights.tolist(), strict=True)]
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in rows], "term string, weight double")


def ridge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores by stored parameters."""
    stored = stats.Ridge(["p_size", "digit", "name_length"], [25.0, 4.5, 30.0], [14.0, 3.0, 5.0], [2.5, -1.25, 0.5], 1400.0)
    return part_frame(spark, d).select("p_partkey", F.round(stored.score(), 6).alias("score"))


def standardised_parts(spark: SparkSession, d: str) -> DataFrame:
    own = part_frame(spark, d).select("p_partkey", F.col("p_size").cast("double").alias("size"), "price", F.lit(7.0).alias("constant"))
    z = stats.standardised(own, ["size", "price", "constant"])
    return z.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("size", "price", "constant")])


def said(fit: DataFrame) -> DataFrame:
    """A fit's table without p-values, which SQL has no function for, to 5 places."""
    return fit.select("term", *[F.round(c, 5).alias(c) for c in ("estimate", "robust_error", "confidence_low", "confidence_high")])


QUERIES = {
    "gravity_access": lambda s, d: spatial.gravity_access(areas(s, d), mass(s, d)),
    "mean_local_distance": lambda s, d: spatial.mean_local_distance(areas(s, d), flows.local_pairs(summed(s, d), codes(s, d))),
    "queen_edges": edges,
    "queen_islands": islands,
    "morans_i": lambda s, d: spatial.morans_i(balances(s, d), edges(s, d)).withColumn("moran_i", F.round("moran_i", 6)),
    "moran_permutation": lambda s, d: spatial.moran_permutation(balances(s, d), edges(s, d), PERMUTATIONS).withColumn("observed", F.round("observed", 6)),
    "count_model_frame": lambda s, d: model_frame(s, d).select("origin", "fixed", "employed", "home", F.round("log_access", 6).alias("log_access"), F.round("home_share", 6).alias("home_share")),
    "standardize": standardised_parts,
    "ridge_fit": ridge,
    "ridge_score": ridge_scores,
    "poisson_glm": lambda s, d: said(stats.poisson_glm(model_frame(s, d), "fixed", "employed", ["log_access", "home_share"])),
    "nb2_glm": lambda s, d: said(stats.nb2_glm(model_frame(s, d), "fixed", "employed", ["log_access", "home_share"])),
    "binomial_glm": lambda s, d: said(stats.binomial_glm(model_frame(s, d), "home", "employed", ["log_access"])),
}

_AREAS = """
    areas AS (SELECT 'E020' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS code, n_nationkey AS key, n_nationkey % 5 AS cx, n_nationkey // 5 AS cy,
              5000.0 * (n_nationkey % 5) AS x, 5000.0 * (n_nationkey // 5) AS y FROM nation),
    mass AS (SELECT code, CAST(coalesce(sum(people), 0) AS BIGINT) AS mass FROM areas LEFT JOIN flows ON destination = code AND indicator = 3 GROUP BY code),
    edges AS (SELECT a.code AS a, b.code AS b FROM areas a JOIN areas b ON a.code < b.code AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1),
    balances AS (SELECT 'E020' || lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS code, round(avg(c_acctbal), 2) AS value FROM customer GROUP BY c_nationkey)
"""
_S = f"WITH {_LINES}, {_AREAS}"

_MODEL = (_A + ", " + _AREAS).replace("FROM nation WHERE n_regionkey < 3", "FROM nation") + """
    , access AS (SELECT a.code AS origin, round(sum(mass * exp(-sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 5000.0)), 6) AS access
                 FROM areas a CROSS JOIN areas b JOIN mass ON mass.code = b.code GROUP BY a.code),
    raw AS (SELECT origin, fixed, employed, home, ln(1 + access) AS la, home / employed AS hs FROM aggregates JOIN access USING (origin)),
    frame AS (
        SELECT origin, fixed, employed, home, (la - avg(la) OVER ()) / stddev_pop(la) OVER () AS log_access, (hs - avg(hs) OVER ()) / stddev_pop(hs) OVER () AS home_share FROM raw), """

ORACLE_SQL = {
    "gravity_access": _S + """
        SELECT a.code AS origin,
               round(sum(mass * exp(-sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 3000.0)), 6) AS access_3km,
               round(sum(mass * exp(-sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 5000.0)), 6) AS access_5km,
               round(sum(mass * exp(-sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 10000.0)), 6) AS access_10km
        FROM areas a CROSS JOIN areas b JOIN mass ON mass.code = b.code GROUP BY a.code""",
    "mean_local_distance": _S + """
        SELECT o.code AS origin, round(coalesce(sum(people * sqrt((o.x - e.x) ** 2 + (o.y - e.y) ** 2)) / nullif(sum(people), 0), 0), 6) AS mean_metres
        FROM areas o LEFT JOIN (SELECT * FROM flows WHERE indicator = 3 AND origin IN (SELECT code FROM codes) AND destination IN (SELECT code FROM codes)) f ON f.origin = o.code
        LEFT JOIN areas e ON e.code = f.destination GROUP BY o.code""",
    "queen_edges": _S + "SELECT a, b FROM edges",
    "queen_islands": _S + """
        , chosen AS (SELECT * FROM areas WHERE key % 4 = 0 OR key = 1)
        SELECT code FROM chosen s WHERE NOT EXISTS (SELECT 1 FROM chosen t WHERE t.code <> s.code AND abs(t.cx - s.cx) <= 1 AND abs(t.cy - s.cy) <= 1)""",
    "morans_i": _S + """
        , z AS (SELECT code, value - avg(value) OVER () AS z FROM balances),
        twice AS (SELECT a AS i, b AS j FROM edges UNION ALL SELECT b, a FROM edges),
        w AS (SELECT i, j, 1.0 / count(*) OVER (PARTITION BY i) AS w FROM twice)
        SELECT (SELECT count(*) FROM z) AS n, round(sum(w * p.z * q.z) / (SELECT sum(z * z) FROM z) * (SELECT count(*) FROM z) / sum(w), 6) AS moran_i
        FROM w JOIN z p ON p.code = i JOIN z q ON q.code = j""",
    "count_model_frame": _MODEL[:-2] + "SELECT origin, fixed, employed, home, round(log_access, 6) AS log_access, round(home_share, 6) AS home_share FROM frame",
    "poisson_glm": _MODEL + fits.poisson("frame", "fixed", "employed", ["log_access", "home_share"]),
    "nb2_glm": _MODEL + fits.nb2("frame", "fixed", "employed", ["log_access", "home_share"]),
    "binomial_glm": _MODEL + fits.binomial("frame", "home", "employed", ["log_access"]),
    "ridge_fit": fits.ridge("SELECT p_size, p_partkey % 10 AS digit, length(p_name) AS name_length, p_retailprice FROM part", ["p_size", "digit", "name_length"], "p_retailprice", 4.0),
    "moran_permutation": _S + f"""
        , places AS (SELECT code, value, row_number() OVER (ORDER BY code) AS place FROM balances),
        drawn AS (SELECT r AS round, value, row_number() OVER (PARTITION BY r ORDER BY sha256('7|' || r || '|' || code)) AS place FROM balances CROSS JOIN range({PERMUTATIONS}) t(r)),
        dealt AS (SELECT round, p.code, d.value FROM drawn d JOIN places p USING (place) UNION ALL SELECT -1, code, value FROM balances),
        z AS (SELECT round, code, value - avg(value) OVER (PARTITION BY round) AS z FROM dealt),
        twice AS (SELECT a AS i, b AS j FROM edges UNION ALL SELECT b, a FROM edges),
        w AS (SELECT i, j, 1.0 / count(*) OVER (PARTITION BY i) AS w FROM twice),
        crossed AS (SELECT p.round, sum(w * p.z * q.z) / sum(w) AS c FROM w JOIN z p ON p.code = i JOIN z q ON q.code = j AND q.round = p.round GROUP BY 1),
        moran AS (SELECT round, c * count(*) / sum(z * z) AS v, count(*) AS n FROM crossed JOIN z USING (round) GROUP BY round, c),
        observed AS (SELECT v, n FROM moran WHERE round = -1)
        SELECT round(o.v, 6) AS observed, o.n, (count(*) FILTER (abs(m.v + 1.0::DOUBLE / (o.n - 1)) >= abs(o.v + 1.0::DOUBLE / (o.n - 1)) - 1e-12::DOUBLE) + 1) / (count(*) + 1) AS p_value, count(*) AS permutations
        FROM moran m CROSS JOIN observed o WHERE m.round >= 0 GROUP BY o.v, o.n""",
    "standardize": """
        SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS size,
               round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS price, 0.0::DOUBLE AS constant FROM part""",
    "ridge_score": """
        SELECT p_partkey, round(1400.0::DOUBLE + (p_size - 25.0) / 14.0 * 2.5 + (p_partkey % 10 - 4.5) / 3.0 * -1.25 + (length(p_name) - 30.0) / 5.0 * 0.5, 6) AS score FROM part""",
}
