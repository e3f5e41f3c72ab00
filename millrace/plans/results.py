"""Queries of instance scoring, storage and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import episodes, instances, store
from millrace.operators.ranking import numbered
from millrace.session import table

PLOTS = 8


def points(spark: SparkSession, d: str, shift: int = 3) -> DataFrame:
    """Order lines as points: the order is the reference, some lines are predicted into a neighbouring order of the plot."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    pred = F.when(F.col("l_partkey") % 17 == 0, 0).when(F.col("l_partkey") % 29 == 0, -1).when((line == 1) & (key % shift == 0), key + PLOTS).otherwise(key)
    cls = (
        F.when(F.col("l_suppkey") % 4 == 0, instances.BOUNDARY).when(F.col("l_returnflag") == "A", 4).when(F.col("l_returnflag") == "R", 5)
        .when(F.col("l_linestatus") == "O", 6).otherwise(1)
    )
    return table(spark, d, "lineitem").select((key % PLOTS).alias("plot"), pred.cast("long").alias("pred"), key.alias("ref"), cls.cast("int").alias("cls"))


def plot_scores(spark: SparkSession, d: str) -> DataFrame:
    return instances.plot_scores(points(spark, d)).withColumn("site", (F.col("plot") % 2).cast("int"))


def both_variants(spark: SparkSession, d: str) -> DataFrame:
    a = instances.plot_scores(points(spark, d, 3)).select("plot", F.lit("a").alias("variant"), "f1")
    return a.unionByName(instances.plot_scores(points(spark, d, 2)).select("plot", F.lit("b").alias("variant"), "f1"))


def reconstruction(spark: SparkSession, d: str) -> DataFrame:
    """Site aggregates made by one pass against those made level by level, with a fault in one of them."""
    scores = plot_scores(spark, d)
    made = instances.aggregated(scores, [["site"], []])
    apart = instances.aggregated(scores, [["site"]]).unionByName(instances.aggregated(scores, [[]]).withColumn("site", F.lit(None).cast("int")), allowMissingColumns=True)
    stored = apart.withColumn("tp", F.when(F.col("site") == 1, F.col("tp") + 1).otherwise(F.col("tp")))
    return instances.differing(stored, made)


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as batch runs: a customer's priority is the key."""
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("model"), F.col("o_orderpriority").alias("season"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("run_id"), "o_totalprice"
    )


def models(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_brand", "p_type", "p_size")
    stored = part.where("p_size <= 25").select("p_brand", "p_type").distinct()
    stored = stored.withColumn("model_id", store.digest(["p_brand", "p_type"]))
    return store.register(stored, part.select("p_brand", "p_type"), ["p_brand", "p_type"])


def status(spark: SparkSession, d: str) -> DataFrame:
    """Customers offered again as batches: some are new, some the same, some changed."""
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("batch_id"), "c_name", "c_nationkey", "c_mktsegment")
    stored = own.where("batch_id % 3 <> 0").withColumn("c_mktsegment", F.when(F.col("batch_id") % 5 == 0, F.lit("OTHER")).otherwise(F.col("c_mktsegment")))
    return store.replay_status(stored, own, ["c_name", "c_nationkey"], ["c_name", "c_nationkey", "c_mktsegment"])


def steps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    return e.select(
        "event_id", "user_id", "ts", (cents / 100).alias("raw"), ((cents % 200 - 100) / 100).alias("x"), ((cents % 70) / 100).alias("y"),
        ((cents % 90 - 45) / 100).alias("vx"), ((cents % 60 - 45) / 100).alias("vy"), ((cents % 50 - 25) / 100).alias("angle"),
        (F.col("event_id") % 2 == 0).alias("left"), (F.col("event_id") % 3 == 0).alias("right"), (F.col("event_id") % 11 == 0).alias("terminal"),
    )


def shaped(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return steps(spark, d).select("event_id", F.round(episodes.shaped_reward(c("raw"), c("x"), c("y"), c("vx"), c("vy"), c("angle"), c("left"), c("right"), c("terminal")), 6).alias("reward"))


def episode_summary(spark: SparkSession, d: str) -> DataFrame:
    by = steps(spark, d).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.round(F.sum("raw"), 2).alias("reward"))
    made = episodes.summary(by, "reward", 20.0)
    return made.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in made.dtypes])


QUERIES = {
    "boundary_excluded": lambda s, d: instances.boundary_excluded(points(s, d)),
    "instance_iou": lambda s, d: instances.overlaps(points(s, d)).withColumn("iou", F.round(F.col("shared") / F.col("whole"), 6)),
    "instance_matches": lambda s, d: instances.matches(points(s, d)).withColumn("iou", F.round("iou", 6)),
    "matched_counts": lambda s, d: instances.plot_scores(points(s, d)).select("plot", "points", "evaluated", "predicted", "referenced", "excluded"),
    "plot_scores": plot_scores,
    "site_overall_aggregates": lambda s, d: instances.aggregated(plot_scores(s, d), [["site"], []]),
    "variant_pairs": lambda s, d: instances.variant_pairs(both_variants(s, d), ["plot"], ["a", "b"]),
    "aggregate_reconstruction": reconstruction,
    "dense_index": lambda s, d: instances.dense_index(numbered(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], "row_index"), "row_index"),
    "register_model": models,
    "batch_replay_status": status,
    "latest_batch": lambda s, d: store.latest(runs(s, d), ["season"]),
    "table_digest": lambda s, d: store.table_digest(table(s, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]),
    "store_counts": lambda s, d: store.counts({n: table(s, d, n) for n in ("customer", "orders", "part")}),
    "epsilon_schedule": lambda s, d: table(s, d, "orders").select("o_orderkey", F.round(episodes.epsilon(F.col("o_orderkey") % 700), 6).alias("epsilon")),
    "shaped_reward": shaped,
    "episode_summary": episode_summary,
    "replay_latest_n": lambda s, d: episodes.latest_n(steps(s, d).select("event_id", "user_id"), 20, ["user_id"], "event_id"),
    "replay_sample": lambda s, d: episodes.sample(steps(s, d).select("event_id", "user_id"), 64, "event_id"),
}


def _points_sql(shift: int = 3, name: str = "p") -> str:
    return f"""
    {name}_points AS (
        SELECT l_orderkey % {PLOTS} AS plot, CASE WHEN l_partkey % 17 = 0 THEN 0 WHEN l_partkey % 29 = 0 THEN -1 WHEN l_linenumber = 1 AND l_orderkey % {shift} = 0 THEN l_orderkey + {PLOTS} ELSE l_orderkey END AS pred,
               l_orderkey AS ref, CASE WHEN l_suppkey % 4 = 0 THEN 3 WHEN l_returnflag = 'A' THEN 4 WHEN l_returnflag = 'R' THEN 5 WHEN l_linestatus = 'O' THEN 6 ELSE 1 END AS cls FROM lineitem),
    {name}_out AS (SELECT plot, pred, count(*) AS n, CAST(sum(CASE WHEN cls = 3 THEN 1 ELSE 0 END) AS BIGINT) AS boundary FROM {name}_points WHERE pred NOT IN (0, -1)
            GROUP BY 1, 2 HAVING 2 * sum(CASE WHEN cls = 3 THEN 1 ELSE 0 END) > count(*)),
    {name}_active AS (SELECT p.plot, p.pred, ref, p.pred NOT IN (0, -1) AND o.pred IS NULL AS pa, cls IN (4, 5, 6) AND ref > 0 AS ra FROM {name}_points p LEFT JOIN {name}_out o ON o.plot = p.plot AND o.pred = p.pred),
    {name}_preds AS (SELECT plot, pred, count(*) AS n FROM {name}_active WHERE pa GROUP BY 1, 2),
    {name}_refs AS (SELECT plot, ref, count(*) AS n FROM {name}_active WHERE ra GROUP BY 1, 2),
    {name}_shared AS (SELECT plot, pred, ref, count(*) AS shared FROM {name}_active WHERE pa AND ra GROUP BY 1, 2, 3),
    {name}_iou AS (SELECT s.plot, s.pred, s.ref, shared, a.n + b.n - shared AS whole, shared / (a.n + b.n - shared) AS iou
            FROM {name}_shared s JOIN {name}_preds a ON a.plot = s.plot AND a.pred = s.pred JOIN {name}_refs b ON b.plot = s.plot AND b.ref = s.ref)"""


def _scores_sql(shift: int = 3, name: str = "p") -> str:
    """At a threshold of one half, ties are pairs of two pieces of exactly one half; the smaller id gets the match."""
    return _points_sql(shift, name) + f""",
    {name}_ordered AS (
        SELECT plot, pred, ref, iou, row_number() OVER (PARTITION BY plot, pred ORDER BY iou DESC, ref) AS a, row_number() OVER (PARTITION BY plot, ref ORDER BY iou DESC, pred) AS b
        FROM {name}_iou WHERE 2 * shared >= whole),
    {name}_matches AS (SELECT plot, pred, ref, iou FROM {name}_ordered WHERE a = 1 AND b = 1),
    {name}_excluded AS (SELECT plot, count(*) AS excluded FROM {name}_out GROUP BY 1),
    {name}_found AS (SELECT plot, count(*) AS tp, avg(iou) AS mean_iou, median(iou) AS median_iou FROM {name}_matches GROUP BY 1),
    {name}_sizes AS (
        SELECT plot, count(*) AS points, CAST(sum(CASE WHEN pa OR ra THEN 1 ELSE 0 END) AS BIGINT) AS evaluated, count(DISTINCT CASE WHEN pa THEN pred END) AS predicted,
               count(DISTINCT CASE WHEN ra THEN ref END) AS referenced FROM {name}_active GROUP BY 1),
    {name}_counts AS (
        SELECT s.*, coalesce(excluded, 0) AS excluded, coalesce(tp, 0) AS tp, predicted - coalesce(tp, 0) AS fp, referenced - coalesce(tp, 0) AS fn,
               coalesce(mean_iou, 0) AS mean_iou, coalesce(median_iou, 0) AS median_iou
        FROM {name}_sizes s LEFT JOIN {name}_excluded e ON e.plot = s.plot LEFT JOIN {name}_found f ON f.plot = s.plot),
    {name}_scores AS (
        SELECT plot, points, evaluated, predicted, referenced, excluded, tp, fp, fn, {_PRF}, round(mean_iou, 6) AS mean_iou, round(median_iou, 6) AS median_iou,
               CAST(plot % 2 AS INTEGER) AS site FROM {name}_counts)"""


_PRF = (
    "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, "
    "round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"
)
_P = "WITH " + _points_sql()
_S = "WITH " + _scores_sql()

ORACLE_SQL = {
    "instance_matches": _S + " SELECT plot, pred, ref, round(iou, 6) AS iou FROM p_matches",
    "plot_scores": _S + " SELECT * FROM p_scores",
    "site_overall_aggregates": _S + f"""
        , sums AS (SELECT site, count(*) AS plots, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(f1), 6) AS mean_f1, round(median(f1), 6) AS median_f1
                   FROM p_scores GROUP BY GROUPING SETS ((site), ()))
        SELECT site, plots, tp, fp, fn, {_PRF}, mean_f1, median_f1 FROM sums""",
    "variant_pairs": _S + "," + _scores_sql(2, "q") + """
        SELECT a.plot, a.f1 AS a, b.f1 AS b, round(b.f1 - a.f1, 6) AS gain FROM p_scores a JOIN q_scores b ON a.plot = b.plot""",
    "aggregate_reconstruction": _S + f"""
        , made AS (SELECT site, count(*) AS plots, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(f1), 6) AS mean_f1, round(median(f1), 6) AS median_f1
                   FROM p_scores GROUP BY GROUPING SETS ((site), ())),
        stored AS (SELECT site, plots, CASE WHEN site = 1 THEN tp + 1 ELSE tp END AS tp, fp, fn, mean_f1, median_f1 FROM made)
        SELECT (SELECT count(*) FROM (SELECT * FROM stored EXCEPT ALL SELECT * FROM made)) AS only_stored,
               (SELECT count(*) FROM (SELECT * FROM made EXCEPT ALL SELECT * FROM stored)) AS only_made""",
    "boundary_excluded": _P + " SELECT * FROM p_out",
    "instance_iou": _P + " SELECT plot, pred, ref, shared, whole, round(iou, 6) AS iou FROM p_iou",
    "matched_counts": _P + """
        , excluded AS (SELECT plot, count(*) AS excluded FROM p_out GROUP BY 1)
        SELECT a.plot, count(*) AS points, CAST(sum(CASE WHEN pa OR ra THEN 1 ELSE 0 END) AS BIGINT) AS evaluated, count(DISTINCT CASE WHEN pa THEN pred END) AS predicted,
               count(DISTINCT CASE WHEN ra THEN ref END) AS referenced, coalesce(max(excluded), 0) AS excluded FROM p_active a LEFT JOIN excluded e ON e.plot = a.plot GROUP BY a.plot""",
    "dense_index": """
        WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
        SELECT count(*) AS n, min(i) = 0 AND max(i) = count(*) - 1 AND count(DISTINCT i) = count(*) AS dense FROM o""",
    "register_model": "SELECT DISTINCT p_brand, p_type, sha256(p_brand || chr(31) || p_type) AS model_id FROM part",
    "batch_replay_status": """
        SELECT c_custkey AS batch_id, sha256(c_name || chr(31) || CAST(c_nationkey AS VARCHAR)) AS idempotency_key,
               CASE WHEN c_custkey % 3 = 0 THEN 'insert' WHEN c_custkey % 5 = 0 THEN 'conflict' ELSE 'replay' END AS status FROM customer""",
    "latest_batch": """
        SELECT model, season, created_at, run_id, o_totalprice FROM (
            SELECT o_custkey AS model, o_orderpriority AS season, o_orderdate AS created_at, o_orderkey AS run_id, o_totalprice,
                   row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
    "table_digest": """
        WITH h AS (SELECT sha256(concat_ws(chr(31), coalesce(CAST(o_orderkey AS VARCHAR), ''), coalesce(CAST(o_custkey AS VARCHAR), ''), coalesce(o_orderstatus, ''), coalesce(o_orderpriority, ''))) AS h FROM orders),
        c AS (SELECT substr(h, 1, 3) AS c, sum(CAST(('0x' || substr(h, 4, 12)) AS UBIGINT)::HUGEINT) AS s, count(*) AS n FROM h GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(c || ':' || CAST(s AS VARCHAR) || ':' || CAST(n AS VARCHAR), ';' ORDER BY c)) AS digest FROM c""",
    "store_counts": "SELECT 'customer' AS \"table\", count(*) AS n_rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part",
    "epsilon_schedule": "SELECT o_orderkey, round(1.0::DOUBLE + least(greatest((o_orderkey % 700) / 850.0::DOUBLE, 0), 1) * (0.05::DOUBLE - 1.0), 6) AS epsilon FROM orders",
    "shaped_reward": """
        WITH c AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
        s AS (SELECT event_id, cents / 100 AS raw, (cents % 200 - 100) / 100 AS x, (cents % 70) / 100 AS y, (cents % 90 - 45) / 100 AS vx, (cents % 60 - 45) / 100 AS vy,
                     (cents % 50 - 25) / 100 AS angle, event_id % 2 = 0 AS l, event_id % 3 = 0 AS r, event_id % 11 = 0 AS t FROM c)
        SELECT event_id, round(raw - 0.3 * abs(x) - 0.2 * abs(vx) - CASE WHEN y < 0.18 THEN 2.5 * abs(x) ELSE 0 END - CASE WHEN y < 0.18 AND NOT (l OR r) THEN 0.05 ELSE 0 END
               + CASE WHEN y < 0.18 AND abs(x) < 0.08 AND abs(angle) < 0.15 AND vy > -0.40 AND vy < -0.03 THEN 0.03 ELSE 0 END + CASE WHEN t AND l AND r AND abs(x) < 0.08 THEN 8.0 ELSE 0 END, 6) AS reward FROM s""",
    "episode_summary": """
        WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(CAST(round(value * 100) AS BIGINT) / 100), 2) AS reward FROM events GROUP BY 1, 2)
        SELECT count(*) AS episodes, round(avg(reward), 6) AS mean, round(stddev_pop(reward), 6) AS deviation, round(min(reward), 6) AS least, round(max(reward), 6) AS most,
               round(avg(CASE WHEN reward >= 20 THEN 1.0 ELSE 0.0 END), 6) AS solved_share FROM e""",
    "replay_latest_n": "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20",
    "replay_sample": "SELECT event_id, user_id FROM events ORDER BY sha256('7|' || CAST(event_id AS VARCHAR)), event_id LIMIT 64",
}
