"""Ranks and top-k of groups that many tasks share, against plain versions."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics, ranking


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables in as many ranges as large ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain_ranks(rows):
    """{(group, value): average rank} by definition."""
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    return {(g, v): sum(x < v for x in vs) + (vs.count(v) + 1) / 2 for g, vs in groups.items() for v in set(vs)}


@pytest.mark.parametrize("groups,values", [(1, 1), (1, 3), (1, 10**6), (2, 40), (40, 5), (None, 7)])
def test_average_ranks_equal_brute_force(spark, groups, values):
    draw = random.Random(7)
    rows = [(draw.randrange(groups) if groups else draw.choice((None, 0)), draw.choice((None, 0.0)) if draw.random() < 0.3 else float(draw.randrange(values))) for _ in range(900)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(6)
    got = ranking.average_ranked(df, ["g"], "v", "r").collect()
    want = plain_ranks(rows)
    assert len(got) == len(rows)
    assert all(r["r"] == want.get((r["g"], r["v"])) for r in got)


def test_one_group_is_ranked_by_many_tasks(spark):
    df = spark.range(20000).select(F.lit(1).alias("g"), (F.col("id") % 3).cast("double").alias("v"))
    placed = ranking.ranges(df, ["g"], "v").groupBy("_range").count().collect()
    assert len(placed) >= 4 and max(r["count"] for r in placed) < 10000
    got = {(r["v"], r["r"]) for r in ranking.average_ranked(df, ["g"], "v", "r").select("v", "r").distinct().collect()}
    assert got == {(0.0, 3334.0), (1.0, 10001.0), (2.0, 16667.5)}


def test_a_limit_by_group_stands_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    plan = ranking.top_of(df, ["g"], [F.desc("v")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # in each task, and after the shuffle


def test_ranking_metrics_equal_plain_versions(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(3), i, float(draw.randint(-3, 60)), float(draw.randint(0, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, entity int, actual double, predicted double").repartition(5)
    for k in (1, 10, 500):
        ndcg, overlap = ({r["g"]: r[1] for r in f(df, ["g"], k).collect()} for f in (metrics.ndcg, metrics.topk_overlap))
        for g in range(3):
            own = [(e, a, p) for h, e, a, p in rows if h == g]
            cut = [(e, min(max(a, 0.0), 50.0), p) for e, a, p in own]
            gain = lambda s: sum((2.0**a - 1) / math.log2(i + 2) for i, (_, a, _) in enumerate(s[:k]))
            best, said = sorted(cut, key=lambda r: (-r[1], r[0])), sorted(cut, key=lambda r: (-r[2], r[0]))
            assert ndcg[g] == pytest.approx(gain(said) / gain(best), rel=1e-12)
            top = min(k, len(own))
            ids = lambda j: {r[0] for r in sorted(own, key=lambda r: (-r[j], r[0]))[:top]}  # noqa: B023, E731
            assert overlap[g] == pytest.approx(len(ids(1) & ids(2)) / top, rel=1e-12)


@pytest.mark.parametrize("groups,values", [(1, 1), (1, 10**6), (3, 4), (200, 50)])
def test_medians_equal_brute_force(spark, groups, values):
    import statistics

    from millrace.operators import stats

    draw = random.Random(groups)
    rows = [(draw.choice((None, *range(groups))), draw.choice((None, 1.0)) if draw.random() < 0.1 else draw.randrange(values) / 4) for _ in range(1501)]
    got = {r["g"]: (r["n"], r["median"]) for r in stats.medians(spark.createDataFrame(rows, "g int, v double").repartition(5), ["g"], "v").collect()}
    kept = defaultdict(list)
    for g, v in rows:
        if v is not None:
            kept[g].append(v)
    assert got == {g: (len(vs), statistics.median(vs)) for g, vs in kept.items()}
    assert stats.medians(spark.createDataFrame([], "g int, v double"), ["g"], "v").count() == 0


def test_ranges_have_about_the_same_size_whatever_the_table(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 500)
    placed = ranking.ranges(spark.range(20000).selectExpr("id % 2 AS k", "id % 7 AS v"), ["k"], "v")
    sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
    assert sum(sizes) == 20000 and len(sizes) >= 35 and max(sizes) < 1500
