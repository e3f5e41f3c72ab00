"""Queries of written forms, batches and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import instances, metrics, sequence, store
from millrace.plans.results import points
from millrace.session import new_path, table
from millrace.sources import readers, writers

PATIENCE = 3
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def fixed_csv(spark: SparkSession, d: str) -> DataFrame:
    """Prices from very small to very large, written in fixed form and read as text."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(key % 3 == 0, price).when(key % 3 == 1, price * 1e9).otherwise(price / 1e12).alias("price"))
    path = new_path(spark, "fixed-csv")
    writers.fixed_csv(rows, path, ["o_orderkey"])
    return readers.strict_csv(spark, path, ["o_orderkey", "price"])


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as CSV and read strictly, as text."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    path = new_path(spark, "csv")
    writers.fixed_csv(rows, path, ["c_custkey"])
    return readers.strict_csv(spark, path, rows.columns)


def features(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_name")
    return writers.geojson_features(rows.withColumn("x", F.col("c_custkey").cast("long")), "x", "c_nationkey", ["c_name"])


def batches(spark: SparkSession, d: str) -> DataFrame:
    """Each priority's orders as a batch that is written twice; the second time finds it there."""
    root = new_path(spark, "store")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    for run in PRIORITIES:
        own = orders.where(F.col("o_orderpriority") == run)
        if not store.write_batch(spark, root, run, own) or store.write_batch(spark, root, run, own):
            raise RuntimeError("a batch is written once")
    return spark.read.parquet(*[f"{root}/run={run}" for run in PRIORITIES])


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("run_id"), F.col("o_custkey").alias("rank"), F.col("o_orderkey").alias("entity"))


def found(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("entity"))
    return store.lookup(table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), "o_orderkey"), wanted)[0]


def unknown(spark: SparkSession, d: str) -> DataFrame:
    offered = table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("model_id"))
    return store.unknown_models(offered, table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("model_id"))).select("batch_id", "model_id")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """The class of the highest score, and its probability."""
    scores = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("scores"))
    return scores.withColumn("p", metrics.softmax("scores")).select("vec_id", metrics.argmax("p").alias("decided"), F.round(F.array_max("p"), 6).alias("p"))


def stopped(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders in time as epochs, prices as scores."""
    epoch = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    history = table(spark, d, "orders").select("o_custkey", epoch.alias("epoch"), F.col("o_totalprice").alias("score"))
    return sequence.early_stop(history, ["o_custkey"], "score", PATIENCE)


QUERIES = {
    "fixed_csv": fixed_csv,
    "csv_round_trip": csv_round_trip,
    "geojson_features": features,
    "stored_batches": batches,
    "store_page": lambda s, d: store.page(predictions(s, d), "1-URGENT", 100),
    "store_lookup": found,
    "unknown_models": unknown,
    "class_decisions": decisions,
    "early_stop": stopped,
    "instance_matches_low": lambda s, d: instances.matches(points(s, d), 0.3).withColumn("iou", F.round("iou", 6)),
}

ORACLE_SQL = {
    "fixed_csv": """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
               printf('%.12g', CASE o_orderkey % 3 WHEN 0 THEN o_totalprice::DOUBLE WHEN 1 THEN o_totalprice::DOUBLE * 1e9::DOUBLE ELSE o_totalprice::DOUBLE / 1e12::DOUBLE END) AS price FROM orders""",
    "csv_round_trip": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, trim(c_name) AS c_name, trim(c_mktsegment) AS c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer",
    "geojson_features": """
        SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || c_custkey || ',' || c_nationkey || ']},"properties":{"c_name":"' || c_name || '"}}' AS feature FROM customer""",
    "stored_batches": "SELECT o_orderkey, o_orderpriority FROM orders",
    "store_page": "SELECT o_orderpriority AS run_id, o_custkey AS rank, o_orderkey AS entity FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY rank, entity LIMIT 100",
    "store_lookup": "SELECT o_custkey AS entity, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "unknown_models": "SELECT o_orderkey AS batch_id, o_custkey AS model_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "class_decisions": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS s FROM embeddings)
        SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS decided, round(1 / list_sum(list_transform(s, lambda x: exp(x - list_max(s)))), 6) AS p FROM e""",
    "early_stop": f"""
        WITH h AS (SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS epoch, o_totalprice AS score FROM orders),
        m AS (SELECT *, max(score) OVER (PARTITION BY o_custkey ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
        b AS (SELECT *, max(CASE WHEN before IS NULL OR score > before THEN epoch END) OVER (PARTITION BY o_custkey ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best FROM m),
        s AS (SELECT o_custkey, coalesce(min(CASE WHEN epoch - best >= {PATIENCE} THEN epoch END), max(epoch)) AS stopped FROM b GROUP BY 1)
        SELECT o_custkey, stopped, best AS best_epoch FROM s JOIN b USING (o_custkey) WHERE epoch = stopped""",
}
