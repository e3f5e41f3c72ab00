"""Episodes of an agent: schedules, shaped rewards, summaries, and a bounded memory of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.scalar import hash_order


def epsilon(episode: Column, start: float = 1.0, end: float = 0.05, decay: float = 850.0) -> Column:
    """From start to end in a straight line over `decay` episodes."""
    return F.lit(start) + F.least(F.greatest(episode / decay, F.lit(0.0)), F.lit(1.0)) * (end - start)


#: Weights and conditions of the shaped reward.
SHAPING = {
    "centre": 0.3, "speed": 0.2, "low_centre": 2.5, "hover": 0.05, "landing": 0.03, "touchdown": 8.0,
    "low": 0.18, "near": 0.08, "upright": 0.15, "fastest": -0.40, "slowest": -0.03,
}


def shaped_reward(raw: Column, x: Column, y: Column, vx: Column, vy: Column, angle: Column, left: Column, right: Column, terminal: Column, w: dict[str, float] | None = SHAPING) -> Column:
    """Raw reward less penalties for being off centre and drifting (more when low, and for hovering there), with
    bonuses for a centred, upright, slow descent and for touching down with both legs. The raw one where `w` is None."""
    if w is None:
        return raw
    low, contact = y < w["low"], left | right
    nothing = F.lit(0.0)
    out = raw - w["centre"] * F.abs(x) - w["speed"] * F.abs(vx)
    out = out - F.when(low, w["low_centre"] * F.abs(x)).otherwise(nothing) - F.when(low & ~contact, F.lit(w["hover"])).otherwise(nothing)
    good = low & (F.abs(x) < w["near"]) & (F.abs(angle) < w["upright"]) & (vy > w["fastest"]) & (vy < w["slowest"])
    down = terminal & left & right & (F.abs(x) < w["near"])
    return out + F.when(good, F.lit(w["landing"])).otherwise(nothing) + F.when(down, F.lit(w["touchdown"])).otherwise(nothing)


def summary(episodes: DataFrame, reward: str = "reward", solved: float = 200.0) -> DataFrame:
    """Mean, population deviation, extremes, and the share at or over a mark."""
    return episodes.agg(
        F.count("*").alias("episodes"), F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("deviation"), F.min(reward).alias("least"),
        F.max(reward).alias("most"), F.avg((F.col(reward) >= solved).cast("double")).alias("solved_share"),
    )


def latest_n(steps: DataFrame, capacity: int, by: list[str], order: str) -> DataFrame:
    """The newest `capacity` steps of each memory: what a ring of that size holds."""
    newest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return steps.withColumn("_n", newest).where(F.col("_n") <= capacity).drop("_n")


def sample(steps: DataFrame, k: int, key: str, seed: int = 7) -> DataFrame:
    """k steps without replacement, the first ones in the order of a seeded hash."""
    return steps.withColumn("_h", hash_order(F.lit(seed), F.col(key))).orderBy("_h", key).limit(k).drop("_h")
