"""Panel and metric queries: users' events in periods of two days, and a rule that stands in for a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import metrics, panel
from millrace.session import staged, table


def events(spark: SparkSession, d: str, days: int = 2) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    stat = F.from_json("props", "k int", {"allowNonNumericNumbers": "false"})["k"]
    return table(spark, d, "events").select(
        F.col("user_id").alias("entity"), (F.floor(day / days) + 1).cast("int").alias("period"),
        F.round(F.col("value") * 100).cast("long").alias("points"), F.lit(1).cast("long").alias("minutes"),
        (F.col("event_type") == "purchase").cast("long").alias("starts"), F.coalesce(stat, F.lit(0)).cast("long").alias("extra"),
    )


def observed(spark: SparkSession, d: str) -> DataFrame:
    return panel.summed(events(spark, d))


def thinned(spark: SparkSession, d: str) -> DataFrame:
    return observed(spark, d).where("period NOT IN (4, 5, 11)")


def frame(spark: SparkSession, d: str) -> DataFrame:
    return panel.training_frame(observed(spark, d))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def oof(spark: SparkSession, d: str) -> DataFrame:
    made = frame(spark, d)
    return panel.baseline_oof(made, panel.rolling_folds(made))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """The mean of three as prediction, cut to hundredths, so that ties are ties everywhere."""
    return oof(spark, d).select("entity", "target_period", (F.col("actual") / 1000).alias("actual"), (F.floor(F.col("rolling3") / 10) / 100).alias("predicted"))


def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of three baselines and ridge over the same folds."""
    made = staged(frame(spark, d), "frame")
    folds = panel.rolling_folds(made)
    base, ridge = panel.baseline_oof(made, folds), panel.ridge_oof(made, folds)
    both = base.join(ridge.drop("actual"), ["fold", "entity", "target_period"])
    out = None
    for model in ("last_value", "rolling3", "train_mean", "ridge"):
        own = both.select("entity", "target_period", (F.col("actual") / 1000).alias("actual"), (F.col(model) / 1000).alias("predicted"))
        row = metrics.metric_bundle(own, ["target_period"]).withColumn("model", F.lit(model))
        out = row if out is None else out.unionByName(row)
    return _rounded(out)


def judged(spark: SparkSession, d: str) -> DataFrame:
    """(actual, predicted, probabilities, confidence, correct) from embeddings' labels by a rule."""
    vec, label = F.col("vec_id"), F.col("label")
    guess = F.when(vec % 4 == 0, (label + 3) % 10).otherwise(label).cast("int")
    extra = vec % 13 + 2
    probability = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (1 + F.when(k == guess, extra).otherwise(0)) / (10 + extra))
    return table(spark, d, "embeddings").select(
        F.col("label").cast("int").alias("actual"), guess.alias("predicted"), probability.alias("probabilities"),
        ((1 + extra) / (10 + extra)).alias("confidence"), (guess == label).alias("correct"),
    )


LABELS = list(range(10))

QUERIES = {
    "panel_sum": observed,
    "json_stats": lambda s, d: events(s, d).groupBy("period").agg(F.sum("extra").alias("extra"), F.count("*").alias("n")),
    "sequence_summary": lambda s, d: panel.sequence_summary(observed(s, d)),
    "adjacent_coverage": lambda s, d: panel.adjacent_coverage(observed(s, d)),
    "period_gaps": lambda s, d: panel.period_gaps(thinned(s, d)),
    "training_frame": lambda s, d: _rounded(frame(s, d)),
    "forecast_frame": lambda s, d: _rounded(panel.forecast_frame(observed(s, d))),
    "as_of_boundary": lambda s, d: panel.as_of_boundary(observed(s, d), 15),
    "leak_violations": lambda s, d: panel.leak_violations(frame(s, d).withColumn("future_points", F.col("target"))),
    "rolling_folds": lambda s, d: panel.rolling_folds(frame(s, d)),
    "baseline_oof": lambda s, d: _rounded(oof(s, d)),
    "ranked_predictions": lambda s, d: _rounded(panel.ranked(panel.forecast_frame(observed(s, d)), "mean3_points")),
    "rolling_evaluation": evaluation,
    "point_metrics": lambda s, d: _rounded(metrics.point_metrics(scored(s, d))),
    "spearman_by_group": lambda s, d: _rounded(metrics.spearman(scored(s, d), ["target_period"])),
    "ndcg_by_group": lambda s, d: _rounded(metrics.ndcg(scored(s, d), ["target_period"])),
    "topk_overlap": lambda s, d: _rounded(metrics.topk_overlap(scored(s, d), ["target_period"])),
    "metric_bundle": lambda s, d: _rounded(metrics.metric_bundle(scored(s, d), ["target_period"])),
    "confusion_matrix": lambda s, d: metrics.confusion_matrix(judged(s, d), LABELS),
    "class_prf": lambda s, d: _rounded(metrics.class_prf(judged(s, d), LABELS)),
    "classifier_summary": lambda s, d: _rounded(metrics.classifier_summary(judged(s, d), LABELS)),
    "brier_logloss": lambda s, d: _rounded(metrics.log_loss_brier(judged(s, d))),
    "ece_bins": lambda s, d: _rounded(metrics.ece_bins(judged(s, d))),
    "ece": lambda s, d: _rounded(metrics.ece(judged(s, d))),
    "class_weights": lambda s, d: _rounded(metrics.class_weights(table(s, d, "documents"), "lang")),
}

_EVENTS = """
    rows AS (
        SELECT user_id AS entity, CAST(floor(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 2) + 1 AS INTEGER) AS period,
               CAST(round(value * 100) AS BIGINT) AS points, event_type, CAST(coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 0) AS BIGINT) AS extra
        FROM events),
    panel AS (
        SELECT entity, period, CAST(sum(points) AS BIGINT) AS points, count(*) AS minutes,
               CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS starts, CAST(sum(extra) AS BIGINT) AS extra
        FROM rows GROUP BY 1, 2)"""
_FRAME = """,
    known AS (
        SELECT entity, period, points::DOUBLE AS latest_points, minutes::DOUBLE AS latest_minutes, starts::DOUBLE AS latest_starts, extra::DOUBLE AS latest_extra,
               avg(points) OVER three AS mean3_points, avg(minutes) OVER three AS mean3_minutes, avg(extra) OVER three AS mean3_extra,
               avg(CASE WHEN starts > 0 THEN 1.0 ELSE 0.0 END) OVER three AS started3, avg(points) OVER five AS mean5_points,
               (sum(points) OVER season)::DOUBLE AS season_points, (sum(minutes) OVER season)::DOUBLE AS season_minutes,
               (count(*) OVER season)::DOUBLE AS observed, (sum(points) OVER season)::DOUBLE / (count(*) OVER season) AS points_per_observed,
               (sum(points) OVER (PARTITION BY entity ORDER BY period RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING))::DOUBLE AS target
        FROM panel
        WINDOW three AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
               five AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
               season AS (PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    frame AS (SELECT *, period + 1 AS target_period FROM known WHERE target IS NOT NULL)"""
_FOLDS = """,
    periods AS (SELECT target_period, row_number() OVER (ORDER BY target_period) AS place, count(*) OVER () AS last FROM (SELECT DISTINCT target_period FROM frame)),
    folds AS (
        SELECT fold, CASE WHEN place <= 4 + fold THEN 'train' WHEN place <= 5 + fold THEN 'test' END AS role, target_period
        FROM periods JOIN (SELECT unnest(generate_series(0, (SELECT count(*) FROM periods) - 5)) AS fold) ON true
        WHERE place <= 5 + fold),
    means AS (SELECT fold, avg(target) AS train_mean FROM folds JOIN frame USING (target_period) WHERE role = 'train' GROUP BY fold),
    oof AS (
        SELECT fold, entity, target_period, target AS actual, latest_points AS last_value, mean3_points AS rolling3, train_mean
        FROM folds JOIN means USING (fold) JOIN frame USING (target_period) WHERE role = 'test'),
    scored AS (SELECT entity, target_period, actual / 1000 AS actual, floor(rolling3 / 10) / 100 AS predicted FROM oof)"""
_RANKS = """,
    ranks AS (
        SELECT target_period,
               rank() OVER (PARTITION BY target_period ORDER BY actual) + (count(*) OVER (PARTITION BY target_period, actual) - 1) / 2.0 AS ra,
               rank() OVER (PARTITION BY target_period ORDER BY predicted) + (count(*) OVER (PARTITION BY target_period, predicted) - 1) / 2.0 AS rp FROM scored),
    moments AS (
        SELECT target_period, sum(ra * rp) - sum(ra) * sum(rp) / count(*) AS c, sum(ra * ra) - sum(ra) * sum(ra) / count(*) AS va,
               sum(rp * rp) - sum(rp) * sum(rp) / count(*) AS vp FROM ranks GROUP BY 1),
    spearman AS (SELECT target_period, CASE WHEN va > 1e-9 AND vp > 1e-9 THEN c / sqrt(va * vp) ELSE 0 END AS spearman FROM moments),
    placed AS (
        SELECT target_period, least(greatest(actual, 0), 50) AS relevance,
               row_number() OVER (PARTITION BY target_period ORDER BY least(greatest(actual, 0), 50) DESC, entity) AS pr,
               row_number() OVER (PARTITION BY target_period ORDER BY actual DESC, entity) AS pa,
               row_number() OVER (PARTITION BY target_period ORDER BY predicted DESC, entity) AS pp,
               count(*) OVER (PARTITION BY target_period) AS n FROM scored),
    ndcg AS (
        SELECT target_period, coalesce(sum(CASE WHEN pp <= 10 THEN (2 ** relevance - 1) / log2(pp + 1) ELSE 0 END)
               / nullif(sum(CASE WHEN pr <= 10 THEN (2 ** relevance - 1) / log2(pr + 1) ELSE 0 END), 0), 0) AS ndcg FROM placed GROUP BY 1),
    shared_top AS (
        SELECT target_period, sum(CASE WHEN pa <= least(10, n) AND pp <= least(10, n) THEN 1 ELSE 0 END) / max(least(10, n)) AS overlap FROM placed GROUP BY 1),
    points AS (
        SELECT count(*) AS n, round(avg(abs(actual - predicted)), 6) AS mae, round(sqrt(avg((actual - predicted) ** 2)), 6) AS rmse,
               round(1 - sum((actual - predicted) ** 2) / (sum(actual * actual) - sum(actual) * sum(actual) / count(*)), 6) AS r2 FROM scored)"""
_JUDGED = """
    judged AS (
        SELECT CAST(label AS INTEGER) AS actual, CAST(CASE WHEN vec_id % 4 = 0 THEN (label + 3) % 10 ELSE label END AS INTEGER) AS predicted, vec_id % 13 + 2 AS extra FROM embeddings),
    labels_ AS (SELECT CAST(unnest(generate_series(0, 9)) AS INTEGER) AS label),
    counts AS (
        SELECT label, (SELECT count(*) FROM judged WHERE actual = label AND predicted = label) AS tp,
               (SELECT count(*) FROM judged WHERE predicted = label) AS predicted, (SELECT count(*) FROM judged WHERE actual = label) AS support FROM labels_),
    prf AS (SELECT label, support, predicted, tp, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
            coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1 FROM counts),
    bins AS (
        SELECT len(list_filter([k / 15 for k in generate_series(1, 14)], lambda e: e < (1 + extra) / (10 + extra))) AS bin, count(*) AS n,
               avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) AS accuracy, avg((1 + extra) / (10 + extra)) AS confidence FROM judged GROUP BY 1)"""
_P, _F = "WITH " + _EVENTS, "WITH " + _EVENTS + _FRAME
_O = _F + _FOLDS
_R = _O + _RANKS
_J = "WITH " + _JUDGED
_NAMES = panel.FEATURES
_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in _NAMES)

ORACLE_SQL = {
    "panel_sum": _P + " SELECT * FROM panel",
    "json_stats": _P + " SELECT period, CAST(sum(extra) AS BIGINT) AS extra, count(*) AS n FROM rows GROUP BY period",
    "sequence_summary": _P + """
        , sizes AS (SELECT period, count(DISTINCT entity) AS n FROM panel GROUP BY 1)
        SELECT count(*) AS periods, min(period) AS first_period, max(period) AS last_period, min(n) AS fewest, max(n) AS most, CAST(sum(n) AS BIGINT) AS n_rows FROM sizes""",
    "adjacent_coverage": _P + """
        , sizes AS (SELECT period, count(*) AS n FROM panel GROUP BY 1),
        shared AS (SELECT a.period, count(*) AS overlap FROM panel a JOIN panel b ON a.entity = b.entity AND a.period = b.period + 1 GROUP BY 1)
        SELECT a.period, coalesce(overlap, 0) AS overlap, round(coalesce(overlap, 0) / greatest(a.n, b.n), 9) AS coverage
        FROM sizes a JOIN sizes b ON a.period = b.period + 1 LEFT JOIN shared s ON s.period = a.period""",
    "period_gaps": _P + """
        , p AS (SELECT DISTINCT period FROM panel WHERE period NOT IN (4, 5, 11))
        SELECT period, previous FROM (SELECT period, lag(period) OVER (ORDER BY period) AS previous FROM p) WHERE period - previous <> 1""",
    "training_frame": _F + f" SELECT entity, period, target_period, {_ROUND}, round(target, 6) AS target FROM frame",
    "forecast_frame": _F + f" SELECT entity, period, {_ROUND} FROM known WHERE period = (SELECT max(period) FROM panel)",
    "as_of_boundary": _P + " SELECT max(period) AS latest, max(period) = 15 AS agrees FROM panel",
    "leak_violations": _F + """
        SELECT count(*) AS n_rows, CAST(sum(CASE WHEN target_period <> period + 1 THEN 1 ELSE 0 END) AS BIGINT) AS wrong_target_period, 0::BIGINT AS not_finite,
               (SELECT count(*) FROM (SELECT 1 FROM frame GROUP BY entity, target_period HAVING count(*) > 1)) AS repeated_keys,
               1::BIGINT AS forbidden_columns, 0::BIGINT AS missing_columns FROM frame""",
    "rolling_folds": _O + " SELECT fold, role, target_period FROM folds",
    "baseline_oof": _O + " SELECT fold, entity, target_period, actual, last_value, round(rolling3, 6) AS rolling3, round(train_mean, 6) AS train_mean FROM oof",
    "ranked_predictions": _F + """
        SELECT entity, period, round(mean3_points, 6) AS score, row_number() OVER (ORDER BY mean3_points DESC, entity) AS rank
        FROM known WHERE period = (SELECT max(period) FROM panel)""",
    "point_metrics": _R + " SELECT * FROM points",
    "spearman_by_group": _R + " SELECT target_period, round(spearman, 6) AS spearman FROM spearman",
    "ndcg_by_group": _R + " SELECT target_period, round(ndcg, 6) AS ndcg FROM ndcg",
    "topk_overlap": _R + " SELECT target_period, round(overlap, 6) AS overlap FROM shared_top",
    "metric_bundle": _R + """
        SELECT points.*, round((SELECT avg(spearman) FROM spearman), 6) AS spearman, round((SELECT avg(ndcg) FROM ndcg), 6) AS ndcg,
               round((SELECT avg(overlap) FROM shared_top), 6) AS overlap FROM points""",
    "confusion_matrix": _J + " SELECT actual, " + ", ".join(f"count(*) FILTER (WHERE predicted = {k}) AS predicted_{k}" for k in LABELS) + " FROM judged GROUP BY actual",
    "class_prf": _J + " SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf",
    "classifier_summary": _J + """
        SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(CASE WHEN support > 0 THEN recall END), 6) AS balanced_accuracy,
               round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
               round((sum(tp)::DOUBLE * sum(support) - sum(predicted * support)) / sqrt((sum(support)::DOUBLE ** 2 - sum(predicted * predicted)) * (sum(support)::DOUBLE ** 2 - sum(support * support))), 6) AS mcc
        FROM prf""",
    "brier_logloss": _J + """
        SELECT count(*) AS n, round(-avg(ln((1 + CASE WHEN actual = predicted THEN extra ELSE 0 END) / (10 + extra))), 6) AS log_loss,
               round(avg(CASE WHEN actual = predicted THEN ((1 + extra) / (10 + extra) - 1) ** 2 + 9 * (1 / (10 + extra)) ** 2
                         ELSE ((1 + extra) / (10 + extra)) ** 2 + (1 / (10 + extra) - 1) ** 2 + 8 * (1 / (10 + extra)) ** 2 END), 6) AS brier FROM judged""",
    "ece_bins": _J + " SELECT CAST(bin AS INTEGER) AS bin, n, round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence FROM bins",
    "ece": _J + " SELECT round(sum(n / (SELECT count(*) FROM judged) * abs(accuracy - confidence)), 6) AS ece FROM bins",
    "class_weights": "SELECT lang, count(*) AS n, round((SELECT count(*) FROM documents) / ((SELECT count(DISTINCT lang) FROM documents) * count(*)), 6) AS weight FROM documents GROUP BY lang",
}
