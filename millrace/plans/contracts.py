"""Queries of contracts between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import contracts
from millrace.session import table


def tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Customers' balances against a copy with some changed, some a little, and some missing."""
    own = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    k = F.col("c_custkey")
    copy = own.where(k % 50 != 7).withColumn("c_acctbal", F.col("c_acctbal") + F.when(k % 40 == 0, 0.25).when(k % 41 == 0, 1e-12).otherwise(0.0))
    return contracts.apart(own, copy, ["c_custkey"], ["c_acctbal"]).withColumn("difference", F.round("difference", 6))


def page(spark: SparkSession, d: str) -> DataFrame:
    """The first orders of one priority by SQL with parameters."""
    table(spark, d, "orders").createOrReplaceTempView("millrace_orders")
    return spark.sql(
        "SELECT o_orderkey, o_totalprice FROM millrace_orders WHERE o_orderpriority = :priority AND o_orderstatus IN (:a, :b) ORDER BY o_orderkey LIMIT 100",
        args={"priority": "1-URGENT", "a": "F", "b": "O"},
    )


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("customers"))


QUERIES = {
    "validated_merge": lambda s, d: contracts.one_to_one(suppliers(s, d), customers(s, d), ["s_nationkey"]),
    "aligned_codes": lambda s, d: contracts.aligned(table(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey")), customers(s, d), "s_nationkey"),
    "import_filtered": lambda s, d: contracts.import_filtered(table(s, d, "lineitem").withColumn("quantity", F.col("l_quantity").cast("long")), ["l_suppkey"], "l_returnflag", ["A", "R"], ["quantity"], [3, 5]),
    "import_audit": lambda s, d: contracts.import_audit(table(s, d, "lineitem"), "l_linestatus", ["l_orderkey"], "l_returnflag", ["A", "R"]),
    "identity_audit": lambda s, d: contracts.identity_audit(table(s, d, "labels").select("doc_id"), table(s, d, "documents").select("doc_id"), ["doc_id"]),
    "tolerance_difference": tolerance,
    "parameterised_page": page,
}

ORACLE_SQL = {
    "validated_merge": """
        SELECT s_nationkey, suppliers, customers FROM (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1)
        JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) ON s_nationkey = c_nationkey""",
    "aligned_codes": "SELECT n_nationkey AS s_nationkey, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
    "import_filtered": "SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_suppkey NOT IN (3, 5) GROUP BY 1",
    "import_audit": """
        WITH e AS (SELECT l_linestatus, l_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag IN ('A', 'R') THEN 1 ELSE 0 END) AS k FROM lineitem GROUP BY 1, 2)
        SELECT l_linestatus, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(k) AS BIGINT) AS kept, CAST(sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) AS BIGINT) AS entities,
               CAST(sum(greatest(k - 1, 0)) AS BIGINT) AS duplicates, CAST(sum(n - k) AS BIGINT) AS excluded FROM e GROUP BY 1""",
    "identity_audit": """
        WITH r AS (SELECT doc_id FROM labels), i AS (SELECT doc_id FROM documents)
        SELECT (SELECT count(*) FROM i WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = i.doc_id)) AS missing,
               (SELECT count(DISTINCT doc_id) FROM r WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = r.doc_id)) AS unexpected,
               (SELECT count(*) FROM (SELECT doc_id FROM r GROUP BY doc_id HAVING count(*) > 1)) AS repeated""",
    "tolerance_difference": """
        SELECT c_custkey, CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE round((c_acctbal + 0.25) - c_acctbal, 6) END AS difference
        FROM customer WHERE c_custkey % 50 = 7 OR c_custkey % 40 = 0""",
    "parameterised_page": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'O') ORDER BY o_orderkey LIMIT 100",
}
