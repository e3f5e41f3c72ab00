"""Panels of entities over periods: what was known at a period, and evaluation that never looks ahead.

Rows are (entity, period, points, minutes, starts, extra), one each entity and period
with an observation. Frames count observed rows; periods without one are not filled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.scalar import finite, flag, ratio
from millrace.operators.ranking import numbered

MEASURES = ["points", "minutes", "starts", "extra"]
FEATURES = [
    "latest_points", "latest_minutes", "latest_starts", "latest_extra",
    "mean3_points", "mean3_minutes", "mean3_extra", "started3", "mean5_points",
    "season_points", "season_minutes", "observed", "points_per_observed",
]


def _history() -> Window:
    return Window.partitionBy("entity").orderBy("period")


def summed(rows: DataFrame) -> DataFrame:
    """One row an entity and period: rows of one period are added up."""
    return rows.groupBy("entity", "period").agg(*[F.sum(m).alias(m) for m in MEASURES])


def as_of(panel: DataFrame) -> DataFrame:
    """Features of each row from itself and earlier rows of its entity."""
    last = lambda n: _history().rowsBetween(1 - n, 0)
    so_far = _history().rowsBetween(Window.unboundedPreceding, 0)
    made = {f"latest_{m}": F.col(m).cast("double") for m in MEASURES}
    made |= {f"mean3_{m}": F.avg(m).over(last(3)) for m in ("points", "minutes", "extra")}
    made |= {
        "started3": F.avg((F.col("starts") > 0).cast("double")).over(last(3)),
        "mean5_points": F.avg("points").over(last(5)),
        "season_points": F.sum("points").over(so_far).cast("double"),
        "season_minutes": F.sum("minutes").over(so_far).cast("double"),
        "observed": F.count("*").over(so_far).cast("double"),
        "points_per_observed": F.sum("points").over(so_far) / F.greatest(F.count("*").over(so_far), F.lit(1)),
    }
    return panel.withColumns(made)


def training_frame(panel: DataFrame) -> DataFrame:
    """Features at a period and, as target, the points of exactly the next one; rows without it are left out.

    The frame is a range of periods, not the next row, which may be a later period.
    """
    target = F.sum("points").over(_history().rangeBetween(1, 1))
    made = as_of(panel).withColumn("target", target.cast("double"))
    return made.where(F.col("target").isNotNull()).select(
        "entity", "period", (F.col("period") + 1).alias("target_period"), *FEATURES, "target"
    )


def forecast_frame(panel: DataFrame) -> DataFrame:
    """Features at the latest period, without a target."""
    latest = panel.agg(F.max("period").alias("_latest"))
    return as_of(panel).join(F.broadcast(latest), F.col("period") == F.col("_latest")).select("entity", "period", *FEATURES)


def as_of_boundary(panel: DataFrame, declared: int) -> DataFrame:
    """Whether the latest period is the declared one."""
    return panel.agg(F.max("period").alias("latest")).withColumn("agrees", F.col("latest") == declared)


def sequence_summary(panel: DataFrame) -> DataFrame:
    sizes = panel.groupBy("period").agg(F.countDistinct("entity").alias("n"))
    return sizes.agg(
        F.count("*").alias("periods"), F.min("period").alias("first_period"), F.max("period").alias("last_period"),
        F.min("n").alias("fewest"), F.max("n").alias("most"), F.sum("n").alias("n_rows"),
    )


def adjacent_coverage(panel: DataFrame) -> DataFrame:
    """Entities in both of two neighbouring periods over the larger number in either."""
    own = panel.select("entity", "period").distinct()
    before = own.select("entity", (F.col("period") + 1).alias("period"), F.lit(1).alias("_was"))
    sizes = own.groupBy("period").agg(F.count("*").alias("n"))
    shared = own.join(before, ["entity", "period"], "left_semi").groupBy("period").agg(F.count("*").alias("overlap"))
    earlier = sizes.select((F.col("period") + 1).alias("period"), F.col("n").alias("_earlier"))
    return sizes.join(earlier, "period").join(shared, "period", "left").select(
        "period", F.coalesce("overlap", F.lit(0)).alias("overlap"),
        ratio(F.coalesce("overlap", F.lit(0)), F.greatest("n", "_earlier"), 9).alias("coverage"),
    )


def period_gaps(panel: DataFrame) -> DataFrame:
    """Periods that do not follow the one before (there are few periods: one window)."""
    periods = panel.select("period").distinct()
    before = F.lag("period").over(Window.orderBy("period"))
    return periods.select("period", before.alias("previous")).where(F.col("period") - F.col("previous") != 1)


def leak_violations(frame: DataFrame, allowed: list[str] = FEATURES) -> DataFrame:
    """One row: what a feature frame may not have."""
    keys = ["entity", "period", "target_period", "target"]
    strange = [c for c in frame.columns if c not in allowed and c not in keys]
    missing = [c for c in allowed if c not in frame.columns]
    numbers = [c for c in allowed if c in frame.columns]
    bad = F.lit(False)
    for c in numbers:
        bad = bad | ~finite(F.col(c).cast("double"))
    repeated = frame.groupBy("entity", "target_period").count().where("count > 1").agg(F.count("*").alias("repeated_keys"))
    counts = frame.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(flag(F.col("target_period") != F.col("period") + 1)), F.lit(0)).alias("wrong_target_period"),
        F.coalesce(F.sum(flag(bad)), F.lit(0)).alias("not_finite"),
    )
    return counts.crossJoin(repeated).withColumns(
        {"forbidden_columns": F.lit(len(strange)).cast("long"), "missing_columns": F.lit(len(missing)).cast("long")}
    )


def rolling_folds(frame: DataFrame, least: int = 4, step: int = 1, test: int = 1) -> DataFrame:
    """(fold, role, target_period): training on all periods before an origin that moves by `step`, testing on the next ones."""
    if least < 2 or step < test or test < 1:
        raise ValueError("folds need at least 2 training periods and a step of at least the test length")
    periods = frame.select("target_period").distinct()
    ordered = Window.orderBy("target_period")  # over one row a period
    placed = periods.select("target_period", F.row_number().over(ordered).alias("place"))
    placed = placed.crossJoin(F.broadcast(placed.agg(F.max("place").alias("last"))))
    count = F.floor((F.col("last") - least - test) / step) + 1
    fold = F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))).alias("fold")
    role = F.when(F.col("place") <= least + F.col("fold") * step, "train").when(
        F.col("place") <= least + F.col("fold") * step + test, "test"
    )
    return placed.select("target_period", "place", fold).select("fold", role.alias("role"), "target_period").where(F.col("role").isNotNull())


def baseline_oof(frame: DataFrame, folds: DataFrame) -> DataFrame:
    """Out-of-fold rows with three baselines: the last value, the mean of the last three, the mean of all training targets.

    Training sums are kept a period, so a fold never reads its training rows again.
    """
    by_period = frame.groupBy("target_period").agg(F.sum("target").alias("_s"), F.count("*").alias("_n"))
    train = folds.where(F.col("role") == "train").join(F.broadcast(by_period), "target_period").groupBy("fold")
    means = train.agg((F.sum("_s") / F.sum("_n")).alias("train_mean"))
    tests = folds.where(F.col("role") == "test").select("fold", "target_period").join(means, "fold")
    return frame.join(F.broadcast(tests), "target_period").select(
        "fold", "entity", "target_period", F.col("target").alias("actual"),
        F.col("latest_points").alias("last_value"), F.col("mean3_points").alias("rolling3"), "train_mean",
    )


def ridge_oof(frame: DataFrame, folds: DataFrame, alpha: float = 4.0, columns: list[str] = FEATURES) -> DataFrame:
    """Out-of-fold predictions (fold, entity, target_period, actual, ridge).

    One pass sums the Gram matrix of each period; a fold's is the sum of its periods'.
    """
    terms = [F.lit(1.0), *[F.col(c) for c in columns]]
    p = len(terms)
    sums = [F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(terms[i] * F.col("target")).alias(f"b{i}") for i in range(p)]
    parts = {}
    for row in frame.groupBy("target_period").agg(*sums).collect():  # a row a period
        a = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                a[i, j] = a[j, i] = row[f"a{i}_{j}"]
        parts[row["target_period"]] = (a, np.array([row[f"b{i}"] for i in range(p)]))
    fitted = []
    plan = folds.collect()
    for fold in sorted({r["fold"] for r in plan}):
        periods = [r["target_period"] for r in plan if r["fold"] == fold and r["role"] == "train"]
        a, b = sum(parts[t][0] for t in periods), sum(parts[t][1] for t in periods)
        n, means = a[0, 0], a[0, 1:] / a[0, 0]
        centred = a[1:, 1:] - n * np.outer(means, means)
        scales = np.sqrt(np.maximum(np.diag(centred), 0) / n)
        scales[scales == 0] = 1.0
        w = np.linalg.solve(centred / np.outer(scales, scales) + alpha * np.eye(p - 1), (b[1:] - means * b[0]) / scales) / scales
        fitted += [(fold, r["target_period"], float(b[0] / n - w @ means), w.tolist()) for r in plan if r["fold"] == fold and r["role"] == "test"]
    model = frame.sparkSession.createDataFrame(fitted, "fold long, target_period int, _intercept double, _weights array<double>")
    x = F.array(*[F.col(c).cast("double") for c in columns])
    dot = F.aggregate(F.zip_with(x, "_weights", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    return frame.join(F.broadcast(model), "target_period").select(
        "fold", "entity", "target_period", F.col("target").alias("actual"), (F.col("_intercept") + dot).alias("ridge")
    )


def ranked(forecast: DataFrame, score: str) -> DataFrame:
    """Entities by falling score, ties by id, ranks from 1."""
    return numbered(forecast.select("entity", "period", (-F.col(score)).alias("_minus"), F.col(score).alias("score")), ["_minus", "entity"], "rank", 1).drop("_minus")


