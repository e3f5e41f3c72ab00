"""Flow queries: origins are customers' nations, destinations suppliers' nations, people the quantities ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import flows
from millrace.session import table

#: Regions whose nations are the listed areas.
LISTED = 3
INDICATOR = {"R": flows.HOME, "A": flows.OTHER, "N": flows.FIXED}


def area_code(key: str):
    return F.concat(F.lit("E020"), F.lpad(F.col(key).cast("string"), 5, "0"))


def codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").where(F.col("n_regionkey") < LISTED).select(area_code("n_nationkey").alias("code"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """A row an order line: origin, destination, indicator, people, and what the dirty variant needs."""
    customers = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    customers = customers.select("c_custkey", area_code("c_nationkey").alias("origin"), F.col("n_name").alias("origin_label"))
    suppliers = table(spark, d, "supplier").select("s_suppkey", area_code("s_nationkey").alias("destination"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    flag = F.col("l_returnflag")
    indicator = F.when(flag == "R", flows.HOME).when(flag == "A", flows.OTHER).when(flag == "N", flows.FIXED)
    return (
        table(spark, d, "lineitem")
        .select("l_orderkey", "l_suppkey", "l_linenumber", indicator.alias("indicator"), F.col("l_quantity").cast("long").alias("people"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("origin", "origin_label", "destination", "indicator", "people", "l_orderkey", "l_linenumber")
    )


def summed(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).groupBy("origin", "origin_label", "destination", "indicator").agg(F.sum("people").alias("people"))


def dirty(spark: SparkSession, d: str) -> DataFrame:
    """The lines as raw text, with faults on some of them."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    return lines(spark, d).select(
        F.when(key % 101 != 0, F.col("origin")).alias("origin"),
        F.when((key + line) % 97 == 0, F.concat("origin_label", F.lit(" (old)"))).otherwise(F.col("origin_label")).alias("origin_label"),
        F.when(key % 103 != 0, F.col("destination")).alias("destination"),
        F.when(key % 107 == 0, F.lit("x")).otherwise(F.col("indicator").cast("string")).alias("indicator"),
        F.when(key % 109 == 0, F.lit("-1")).when(key % 113 == 0, F.concat(F.col("people").cast("string"), F.lit("\n"))).otherwise(F.col("people").cast("string")).alias("people"),
    )


_LINES = f"""
    lines AS (
        SELECT 'E020' || lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS origin, n_name AS origin_label,
               'E020' || lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS destination,
               CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 WHEN 'N' THEN 3 END AS indicator,
               CAST(l_quantity AS BIGINT) AS people, l_orderkey, l_linenumber
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON l_suppkey = s_suppkey),
    codes AS (SELECT 'E020' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS code FROM nation WHERE n_regionkey < {LISTED}),
    flows AS (SELECT origin, origin_label, destination, indicator, CAST(sum(people) AS BIGINT) AS people FROM lines GROUP BY ALL),
    dirty AS (
        SELECT CASE WHEN l_orderkey % 101 <> 0 THEN origin END AS origin,
               CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN origin_label || ' (old)' ELSE origin_label END AS origin_label,
               CASE WHEN l_orderkey % 103 <> 0 THEN destination END AS destination,
               CASE WHEN l_orderkey % 107 = 0 THEN 'x' ELSE CAST(indicator AS VARCHAR) END AS indicator,
               CASE WHEN l_orderkey % 109 = 0 THEN '-1' WHEN l_orderkey % 113 = 0 THEN CAST(people AS VARCHAR) || chr(10) ELSE CAST(people AS VARCHAR) END AS people
        FROM lines)
"""
_AGGREGATES = """,
    aggregates AS (
        SELECT f.origin, min(origin_label) AS label,
               CAST(sum(CASE WHEN indicator IN (1, 2, 3) THEN people ELSE 0 END) AS BIGINT) AS employed,
               CAST(sum(CASE WHEN indicator = 1 THEN people ELSE 0 END) AS BIGINT) AS home,
               CAST(sum(CASE WHEN indicator = 2 THEN people ELSE 0 END) AS BIGINT) AS elsewhere,
               CAST(sum(CASE WHEN indicator = 3 THEN people ELSE 0 END) AS BIGINT) AS fixed,
               CAST(sum(CASE WHEN indicator = 3 AND d.code IS NOT NULL THEN people ELSE 0 END) AS BIGINT) AS fixed_local,
               CAST(sum(CASE WHEN indicator = 3 AND f.destination = f.origin THEN people ELSE 0 END) AS BIGINT) AS fixed_same
        FROM flows f JOIN codes o ON f.origin = o.code LEFT JOIN codes d ON f.destination = d.code GROUP BY f.origin)
"""
_W = "WITH " + _LINES
_A = _W + _AGGREGATES

QUERIES = {
    "flow_invalid_rows": lambda s, d: flows.invalid_rows(dirty(s, d)),
    "flow_duplicate_keys": lambda s, d: flows.duplicate_keys(dirty(s, d)),
    "flow_inconsistent_origins": lambda s, d: flows.inconsistent_origins(dirty(s, d), codes(s, d)),
    "flow_origin_aggregates": lambda s, d: flows.origin_aggregates(summed(s, d), codes(s, d)),
    "flow_destination_mass": lambda s, d: flows.destination_mass(summed(s, d), codes(s, d)),
    "flow_local_pairs": lambda s, d: flows.local_pairs(summed(s, d), codes(s, d)),
    "flow_retention": lambda s, d: flows.retention(flows.origin_aggregates(summed(s, d), codes(s, d))),
    "flow_totals": lambda s, d: flows.totals(flows.origin_aggregates(summed(s, d), codes(s, d))),
    "flow_contract_violations": lambda s, d: flows.contract_violations(
        flows.origin_aggregates(summed(s, d).where("people > 40"), codes(s, d)), codes(s, d)
    ),
}

ORACLE_SQL = {
    "flow_invalid_rows": _W + """
        SELECT count(*) AS n_rows, CAST(sum(CASE WHEN origin IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_origin,
               CAST(sum(CASE WHEN destination IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_destination,
               CAST(sum(CASE WHEN try_cast(indicator AS INTEGER) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS bad_indicator,
               CAST(sum(CASE WHEN people IS NULL OR NOT regexp_full_match(people, '[0-9]+') THEN 1 ELSE 0 END) AS BIGINT) AS bad_people,
               CAST(sum(CASE WHEN origin IS NULL OR destination IS NULL OR try_cast(indicator AS INTEGER) IS NULL
                         OR people IS NULL OR NOT regexp_full_match(people, '[0-9]+') THEN 1 ELSE 0 END) AS BIGINT) AS n_invalid
        FROM dirty""",
    "flow_duplicate_keys": _W + "SELECT origin, destination, indicator, count(*) AS n FROM dirty GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "flow_inconsistent_origins": _W + """
        SELECT origin, count(DISTINCT origin_label) AS n_labels, count(DISTINCT CASE WHEN indicator IN ('1', '2', '3') THEN indicator END) AS n_indicators
        FROM dirty WHERE origin IN (SELECT code FROM codes) GROUP BY origin
        HAVING count(DISTINCT origin_label) <> 1 OR count(DISTINCT CASE WHEN indicator IN ('1', '2', '3') THEN indicator END) <> 3""",
    "flow_origin_aggregates": _A + "SELECT * FROM aggregates",
    "flow_destination_mass": _W + """
        SELECT code, CAST(coalesce(sum(people), 0) AS BIGINT) AS mass
        FROM codes LEFT JOIN flows ON destination = code AND indicator = 3 GROUP BY code""",
    "flow_local_pairs": _W + """
        SELECT origin, destination, people FROM flows
        WHERE indicator = 3 AND origin IN (SELECT code FROM codes) AND destination IN (SELECT code FROM codes)""",
    "flow_retention": _A + """
        SELECT origin, fixed - fixed_local AS fixed_outside, round(coalesce(fixed_local / nullif(fixed, 0), 0), 9) AS retention,
               round(coalesce(home / nullif(employed, 0), 0), 9) AS home_share FROM aggregates""",
    "flow_totals": _A + """
        SELECT count(*) AS areas, CAST(sum(employed) AS BIGINT) AS employed, CAST(sum(fixed) AS BIGINT) AS fixed,
               CAST(sum(fixed_local) AS BIGINT) AS fixed_local, round(sum(fixed_local) / sum(fixed), 9) AS retention FROM aggregates""",
    "flow_contract_violations": (_A + """
        SELECT count(*) AS areas, CAST(sum(CASE WHEN origin IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing,
               CAST(sum(CASE WHEN least(employed, home, elsewhere, fixed, fixed_local, fixed_same) < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative,
               CAST(sum(CASE WHEN home + elsewhere + fixed <> employed THEN 1 ELSE 0 END) AS BIGINT) AS parts_differ,
               CAST(sum(CASE WHEN fixed_local > fixed THEN 1 ELSE 0 END) AS BIGINT) AS local_over_fixed,
               CAST(sum(CASE WHEN fixed_same > fixed_local THEN 1 ELSE 0 END) AS BIGINT) AS same_over_local,
               CAST(sum(CASE WHEN fixed > 0 AND (fixed_local / fixed < -1e-10 OR fixed_local / fixed > 1 + 1e-10) THEN 1 ELSE 0 END) AS BIGINT) AS share_out_of_range
        FROM codes LEFT JOIN aggregates ON code = origin""").replace("FROM flows f JOIN", "FROM (SELECT * FROM flows WHERE people > 40) f JOIN"),
}
