"""Queries of rule catalogues, expected values, matching over connected parts, and the versioned store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import instances, rules
from millrace.operators.versioned import Store, store_rebuilt
from millrace.plans.results import _points_sql, points
from millrace.session import new_path, table

PATTERN = "C[0-9]{6}"


def area_table(spark: SparkSession, d: str) -> DataFrame:
    """Customers as areas, their orders as people by priority; by the key, some rows break a rule."""
    key = F.col("o_custkey")
    each = [F.count(F.when(F.substring("o_orderpriority", 1, 1) == str(i), 1)).alias(f"n{i}") for i in range(1, 6)]
    n = table(spark, d, "orders").groupBy(key.alias("k")).agg(*each)
    k = F.col("k")
    on = lambda m, x: F.when(k % m == 0, F.lit(x)).otherwise(F.lit(type(x)(0)))
    n = n.withColumns({
        "code": F.concat(F.when(k % 43 == 0, "X").otherwise("C"), F.lpad(k.cast("string"), 6, "0")),
        "home": F.col("n1"), "other": F.col("n2"), "fixed": F.expr("n3 + n4 + n5"), "employed": F.expr("n1 + n2 + n3 + n4 + n5") + on(11, 1),
        "local": F.expr("n3 + n4") + on(13, 5), "outside": F.col("n5"), "same_area": F.col("n3") + on(17, 9), "inbound": F.col("n5") - on(19, 3),
    })
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return n.withColumns({
        "retention": share("local", "fixed") * F.when(k % 23 == 0, 1.01).otherwise(1.0),
        "home_share": F.when(k % 29 == 0, float("nan")).otherwise(share("home", "employed")),
        "access_3km": F.col("n1") * 0.5, "access_5km": F.col("n1") * F.when(k % 31 == 0, 0.25).otherwise(0.75),
        "access_10km": F.when(k % 37 != 0, F.col("n1") * F.when(k % 47 == 0, 0.125).otherwise(1.0)), "mean_km": F.when(k % 41 == 0, float("inf")).otherwise(k / 10.0),
    })


def contract_faults(spark: SparkSession, d: str) -> DataFrame:
    return rules.checked(area_table(spark, d), rules.area_contract(PATTERN), ["code"])


def manifest_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Rows and characters of each source of documents against a manifest that is wrong on one language and lists another."""
    docs = table(spark, d, "documents").where("lang IS NOT NULL")
    facts = docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    pairs = F.explode(F.array(F.struct(F.concat(F.lit("rows:"), "lang").alias("rule"), F.col("n").alias("v")), F.struct(F.concat(F.lit("chars:"), "lang").alias("rule"), F.col("c").alias("v"))))
    observed = facts.select(pairs.alias("p")).select("p.rule", F.col("p.v").alias("observed"))
    wrong = F.when(F.col("rule") == "rows:de", F.col("observed") + 1).otherwise(F.col("observed"))
    expected = observed.where("rule <> 'chars:en'").select("rule", wrong.alias("expected"))
    expected = expected.unionByName(spark.createDataFrame([("rows:none", 3)], "rule string, expected long"))
    return rules.against(observed, expected)


def matching_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Matches of each plot at a threshold where parts of the graph are chains."""
    return instances.matches(points(spark, d, 1), 0.3).groupBy("plot").agg(F.count("*").alias("matches"))


def versioned_batches(spark: SparkSession, d: str) -> DataFrame:
    """Orders by customer, a batch a priority, made again from their states before it is stored, and offered twice; then the schema moves on."""
    root = new_path(spark, "versioned")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    store = Store(spark, root)
    for priority in [r[0] for r in orders.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]:  # five
        own = orders.where(F.col("o_orderpriority") == priority)
        offered = own.groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("n"))
        states = own.groupBy(F.col("o_custkey").alias("entity"), "o_orderstatus").agg(F.count("*").alias("n"))
        rebuilt = states.groupBy("entity").agg(F.sum("n").alias("n"))
        if [store_rebuilt(store, {"priority": priority}, offered, rebuilt) for _ in range(2)] != ["inserted", "replayed"]:
            raise RuntimeError("a batch is stored once")
    level = lambda t: t | {"runs": t["runs"].withColumn("level", F.substring("priority", 1, 1).cast("int"))}
    store = Store(spark, root, 2, {1: level})
    return store.read("rows").join(store.read("runs"), "run_id").select("run_id", "level", "n_rows", "entity", "n")


QUERIES = {
    "area_contract_faults": contract_faults,
    "manifest_agreement": manifest_agreement,
    "instance_matching_sizes": matching_sizes,
    "versioned_batches": versioned_batches,
}

_NUMBERS = [*rules.COUNTS, *rules.SHARES, *rules.REACH]
_BROKEN = {
    "code_malformed": "NOT regexp_full_match(code, 'C[0-9]{6}')",
    **{f"{c}_not_finite": f"{c} IS NULL OR NOT isfinite(CAST({c} AS DOUBLE))" for c in _NUMBERS},
    **{f"{c}_negative": f"coalesce({c} < 0, false)" for c in _NUMBERS},
    "employed_not_positive": "NOT employed > 0",
    "fixed_not_positive": "NOT fixed > 0",
    "employed_not_reconciled": "employed <> home + other + fixed",
    "local_above_fixed": "local > fixed",
    "same_area_above_local": "same_area > local",
    "flows_not_conserved": "fixed <> local + outside",
    "retention_not_a_ratio": "NOT abs(retention - local / nullif(fixed, 0)) <= 1e-10::DOUBLE",
    "home_share_not_a_ratio": "NOT abs(home_share - home / nullif(employed, 0)) <= 1e-10::DOUBLE",
    "access_3km_above_5km": "access_3km > access_5km",
    "access_5km_above_10km": "access_5km > access_10km",
}
_AREAS = """
    n AS (
        SELECT o_custkey AS k, count(*) FILTER (o_orderpriority LIKE '1%') AS n1, count(*) FILTER (o_orderpriority LIKE '2%') AS n2, count(*) FILTER (o_orderpriority LIKE '3%') AS n3,
               count(*) FILTER (o_orderpriority LIKE '4%') AS n4, count(*) FILTER (o_orderpriority LIKE '5%') AS n5 FROM orders GROUP BY 1),
    c AS (
        SELECT *, CASE WHEN k % 43 = 0 THEN 'X' ELSE 'C' END || lpad(CAST(k AS VARCHAR), 6, '0') AS code, n1 AS home, n2 AS other, n3 + n4 + n5 AS fixed,
               n1 + n2 + n3 + n4 + n5 + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS employed, n3 + n4 + CASE WHEN k % 13 = 0 THEN 5 ELSE 0 END AS local, n5 AS outside,
               n3 + CASE WHEN k % 17 = 0 THEN 9 ELSE 0 END AS same_area, n5 - CASE WHEN k % 19 = 0 THEN 3 ELSE 0 END AS inbound FROM n),
    areas AS (
        SELECT *, local / nullif(fixed, 0) * CASE WHEN k % 23 = 0 THEN 1.01::DOUBLE ELSE 1 END AS retention,
               CASE WHEN k % 29 = 0 THEN 'nan'::DOUBLE ELSE home / nullif(employed, 0) END AS home_share, n1 * 0.5::DOUBLE AS access_3km,
               n1 * CASE WHEN k % 31 = 0 THEN 0.25::DOUBLE ELSE 0.75 END AS access_5km, CASE WHEN k % 37 <> 0 THEN n1 * CASE WHEN k % 47 = 0 THEN 0.125::DOUBLE ELSE 1 END END AS access_10km,
               CASE WHEN k % 41 = 0 THEN 'inf'::DOUBLE ELSE k / 10.0::DOUBLE END AS mean_km FROM c)
"""

ORACLE_SQL = {
    "area_contract_faults": f"WITH {_AREAS} SELECT 'empty' AS rule, CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) AS broken FROM areas UNION ALL SELECT 'repeated_key', count(*) - count(DISTINCT code) FROM areas "
    + " ".join(f"UNION ALL SELECT '{rule}', count(*) FILTER (coalesce({broken}, true)) FROM areas" for rule, broken in _BROKEN.items()),
    "manifest_agreement": """
        WITH facts AS (SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS c FROM documents WHERE lang IS NOT NULL GROUP BY 1),
        o AS (SELECT 'rows:' || lang AS rule, n AS observed FROM facts UNION ALL SELECT 'chars:' || lang, c FROM facts),
        e AS (SELECT rule, observed + CASE WHEN rule = 'rows:de' THEN 1 ELSE 0 END AS expected FROM o WHERE rule <> 'chars:en' UNION ALL SELECT 'rows:none', 3)
        SELECT rule, CAST(expected AS BIGINT) AS expected, observed, coalesce(expected = observed, false) AS agrees FROM o FULL JOIN e USING (rule)""",
    # Each instance has two partners at most, so connected parts are paths, of which a largest matching takes every other edge.
    "instance_matching_sizes": "WITH RECURSIVE " + _points_sql(1) + """,
        edges AS (SELECT plot, pred, ref FROM p_iou WHERE iou >= 0.3::DOUBLE),
        ends AS (SELECT plot, 2 * pred AS a, 2 * ref + 1 AS b FROM edges UNION ALL SELECT plot, 2 * ref + 1, 2 * pred FROM edges),
        reach AS (SELECT DISTINCT plot, a AS node, a AS seen FROM ends UNION SELECT r.plot, r.node, e.b FROM reach r JOIN ends e ON e.plot = r.plot AND e.a = r.seen),
        parts AS (SELECT plot, node, min(seen) AS part FROM reach GROUP BY 1, 2),
        sizes AS (SELECT plot, part, count(*) AS nodes FROM parts GROUP BY 1, 2)
        SELECT plot, CAST(sum(nodes // 2) AS BIGINT) AS matches FROM sizes GROUP BY 1""",
    "versioned_batches": """
        WITH b AS (SELECT o_orderpriority, o_custkey AS entity, count(*) AS n FROM orders GROUP BY 1, 2)
        SELECT sha256(o_orderpriority) AS run_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level, count(*) OVER (PARTITION BY o_orderpriority) AS n_rows, entity, n FROM b""",
}
