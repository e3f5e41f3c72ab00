"""Models, matching and splits against plain versions that take the long way."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup, graphs, instances, stats


def rises(theta, y):
    """digamma(theta + y) - digamma(theta) for a whole y: a finite sum."""
    return math.fsum(1 / (theta + k) for k in range(y))


def test_digamma_and_trigamma_rises(spark):
    cases = [(x, y) for x in (1e-3, 0.5, 3.0, 77.7, 1e6) for y in (0, 1, 2, 9, 250)]
    df = spark.createDataFrame([(x, float(y)) for x, y in cases], "x double, y double")
    got = df.select("x", "y", stats.digamma_rise(F.col("x"), F.col("y")).alias("d"), stats.trigamma_rise(F.col("x"), F.col("y")).alias("t")).collect()
    for r in got:
        assert r["d"] == pytest.approx(rises(r["x"], int(r["y"])), rel=1e-13, abs=1e-300)
        assert r["t"] == pytest.approx(-math.fsum(1 / (r["x"] + k) ** 2 for k in range(int(r["y"]))), rel=1e-10, abs=1e-300)


def counts(seed, n=300, alpha=0.4):
    rng = np.random.default_rng(seed)
    x, e = rng.standard_normal((n, 2)), rng.integers(50, 900, n)
    mu = e * np.exp(-2 + 0.3 * x[:, 0] - 0.2 * x[:, 1])
    return x, e, rng.poisson(mu * (rng.gamma(1 / alpha, alpha, n) if alpha else 1))


def plain_nb2(x, e, y):
    """The optimum by nested root finding: the weights by Newton at a fixed alpha, then alpha by halving its slope, all by finite sums."""
    d = np.column_stack((np.ones(len(y)), x))
    beta = np.zeros(3)
    beta[0] = math.log(y.sum() / e.sum())

    def weights(alpha, beta):
        for _ in range(200):
            mu = e * np.exp(d @ beta)
            step = np.linalg.solve(d.T @ (d * (mu * (1 + alpha * y) / (1 + alpha * mu) ** 2)[:, None]), d.T @ ((y - mu) / (1 + alpha * mu)))
            beta = beta + step
            if np.abs(step).max() < 1e-13:
                return beta
        raise AssertionError

    def slope(alpha, beta):
        t, mu = 1 / alpha, e * np.exp(d @ beta)
        return -t * t * math.fsum(rises(t, int(c)) - math.log1p(alpha * m) + (m - c) / (t + m) for c, m in zip(y, mu, strict=True))

    low, high = 1e-3, 10.0
    while high - low > 1e-13 * high:
        middle = (low + high) / 2
        beta = weights(middle, beta)
        low, high = (middle, high) if slope(middle, beta) > 0 else (low, middle)
    alpha, mu = (low + high) / 2, None
    beta = weights(alpha, beta)
    # Observed information and scores in (beta, alpha), the latter's curvature by a difference of slopes.
    mu, h = e * np.exp(d @ beta), 1e-5 * alpha
    info = np.zeros((4, 4))
    info[:3, :3] = d.T @ (d * (mu * (1 + alpha * y) / (1 + alpha * mu) ** 2)[:, None])
    info[3, :3] = info[:3, 3] = d.T @ ((y - mu) * mu / (1 + alpha * mu) ** 2)
    info[3, 3] = -(slope(alpha + h, beta) - slope(alpha - h, beta)) / (2 * h)
    t = 1 / alpha
    own = np.array([-t * t * (rises(t, int(c)) - math.log1p(alpha * m) + (m - c) / (t + m)) for c, m in zip(y, mu, strict=True)])
    scores = np.column_stack((d * ((y - mu) / (1 + alpha * mu))[:, None], own))
    bread = np.linalg.inv(info)
    return beta, alpha, np.sqrt(np.diag(bread @ scores.T @ scores @ bread))


def counted(spark, x, e, y):
    return spark.createDataFrame([(float(a), float(b), int(n), int(c)) for (a, b), n, c in zip(x, e, y, strict=True)], "a double, b double, e long, y long")


@pytest.mark.parametrize("seed,alpha", [(1, 0.4), (2, 0.02), (3, 3.0)])
def test_nb2_reaches_the_optimum(spark, seed, alpha):
    x, e, y = counts(seed, alpha=alpha)
    beta, best, errors = plain_nb2(x, e, y)
    got = {r["term"]: r for r in stats.nb2_glm(counted(spark, x, e, y), "y", "e", ["a", "b"]).collect()}
    assert got["alpha"]["estimate"] == pytest.approx(best, rel=1e-8)
    assert [got[k]["estimate"] for k in ("intercept", "a", "b")] == pytest.approx(beta.tolist(), abs=1e-9)
    assert [got[k]["robust_error"] for k in ("intercept", "a", "b", "alpha")] == pytest.approx(errors.tolist(), rel=1e-5)
    a = got["a"]
    assert a["confidence_low"] < a["estimate"] < a["confidence_high"] and a["p_value"] == pytest.approx(math.erfc(abs(a["estimate"] / a["robust_error"]) / 2**0.5))
    assert got["observations"]["estimate"] == 300 and 0 < got["predicted_rate_min"]["estimate"] < got["predicted_rate_max"]["estimate"]


def test_nb2_reaches_the_optimum_of_counts_of_millions(spark):
    """The likelihood's usual terms leave only rounding of such counts, by which no step was ever good enough."""
    rng = np.random.default_rng(9)
    x, e = rng.standard_normal((25, 2)), rng.integers(550_000, 650_000, 25)
    rate = np.exp(-1.1 + 0.001 * x[:, 0] + 0.009 * rng.standard_normal(25))
    found = []
    for k in (30, 3000):
        fit = stats.nb2_glm(counted(spark, x, e * k, np.rint(e * k * rate)), "y", "e", ["a", "b"], steps=20)
        found.append({r["term"]: r["estimate"] for r in fit.collect()})
    # Nothing but the share of Poisson's variance differs, which is 1 / mu.
    assert found[0]["alpha"] == pytest.approx(found[1]["alpha"] - 1 / (600_000 * 30 / 3), rel=1e-3)
    assert found[0]["intercept"] == pytest.approx(found[1]["intercept"], abs=1e-6)


@pytest.mark.parametrize("theta", [4.0, 12.0, 300.0])
def test_nb2_terms(spark, theta):
    rows = [(float(y), m) for y in (0, 4, 10, 90) for m in (0.5, y + 0.25, 1.1 * y + 3)]
    got = spark.createDataFrame(rows, "y double, m double").select(*stats._nb2_terms(theta, F.col("y"), F.col("m"))).collect()
    for (y, m), g in zip(rows, got, strict=True):
        up = [1 / (theta + i) for i in range(int(y))]
        value = math.lgamma(y + theta) - math.lgamma(theta) - math.lgamma(y + 1) - theta * math.log1p(m / theta) - y * math.log1p(theta / m)
        first = math.fsum(up) - math.log1p(m / theta) + (m - y) / (theta + m)
        second = -math.fsum(u * u for u in up) + m / (theta * (theta + m)) - (m - y) / (theta + m) ** 2
        assert tuple(g) == pytest.approx((value, first, second), rel=1e-9, abs=1e-12)


def test_fits_that_have_no_optimum_are_refused(spark):
    x, e, _ = counts(5)
    even = counted(spark, x, e, np.rint(e * np.exp(-2 + 0.3 * x[:, 0])).astype(int))
    with pytest.raises(stats.NotConverged, match="dispersion"):
        stats.nb2_glm(even, "y", "e", ["a", "b"])
    with pytest.raises(stats.NotConverged, match="independent"):
        stats.poisson_glm(even.withColumn("c", F.col("a") * 2), "y", "e", ["a", "c"])
    with pytest.raises(stats.NotConverged):
        stats.poisson_glm(even, "y", "e", ["a", "b"], steps=1)
    with pytest.raises(stats.NotConverged):
        stats.poisson_glm(even.withColumn("y", F.lit(0)), "y", "e", ["a"])
    certain = spark.createDataFrame([(float(i), 10, 10 if i > 5 else 0) for i in range(12)], "a double, n long, k long")
    with pytest.raises(Exception):
        stats.binomial_glm(certain, "k", "n", ["a"])


def plain_components(edges):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {v: find(v) for v in root}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(i, 99) for i in range(40)], [(5, 5)], [],
    [(random.Random(i).randrange(80), random.Random(i + 500).randrange(80)) for i in range(60)],
])
def test_components(spark, edges):
    got = graphs.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == plain_components(edges)


def most_pairs(pairs):
    """The size of a largest one-to-one matching, by trying out."""
    best = 0
    for n in range(len(pairs), 0, -1):
        if n <= best:
            break
        for some in itertools.combinations(pairs, n):
            if len({p for p, _ in some}) == len({r for _, r in some}) == n:
                best = n
                break
    return best


def test_matching_by_component_is_largest(spark):
    draw = random.Random(8)
    rows = [(plot, p, r, draw.choice((0.3, 0.35, 0.4, 0.45))) for plot in range(40) for p, r in {(draw.randint(1, 6), draw.randint(1, 6)) for _ in range(draw.randint(0, 9))}]
    df = spark.createDataFrame(rows, "plot long, pred long, ref long, iou double").repartition(5)
    got = instances._matched_by_component(df).collect()
    assert {(r["plot"], r["pred"], r["ref"], r["iou"]) for r in got} <= set(rows)
    for plot in range(40):
        own = [(r["pred"], r["ref"]) for r in got if r["plot"] == plot]
        assert len({p for p, _ in own}) == len({r for _, r in own}) == len(own) == most_pairs([(p, r) for q, p, r, _ in rows if q == plot])
        scores = {}
        for q, p, r, iou in rows:
            if q == plot:
                scores.setdefault(p, []).append((r, iou))
        assert sorted(own) == instances.maximum_matching(scores)  # the same pairs as of the whole plot


def test_a_component_and_not_a_plot_is_a_task(spark):
    rows = [(1, 2 * i + j, 2 * i + k, 0.4) for i in range(200) for j, k in ((0, 0), (0, 1), (1, 1))]
    df = spark.createDataFrame(rows, "plot long, pred long, ref long, iou double")
    plan = instances._matched_by_component(df)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "[root#" in plan
    assert instances._matched_by_component(df).count() == 400


@pytest.mark.parametrize("shares", [{"train": 0.7, "validation": 0.15, "test": 0.15}, {"a": 0.5, "b": 0.5}, {"a": 0.1, "b": 0.2, "c": 0.3, "d": 0.4}])
def test_parts_equal_one_group_after_the_other(shares):
    draw = random.Random(len(shares))
    for n in (1, 20, 700, 20_000):
        size, total = draw.choice((1, 2, 7)), n * draw.choice((7, 9, 20))
        have = [float(draw.randrange(1 + int(total * s))) for s in shares.values()]
        whole = [h + draw.randrange(1 + int(total * s)) for h, s in zip(have, shares.values(), strict=True)]
        parts = dedup.Parts(float(size), have, [total * s for s in shares.values()], whole, [2 * total * s for s in shares.values()])
        taken, order = [0] * len(shares), []
        costs = [parts._cost(p, 0) for p in range(len(shares))]
        for _ in range(n):
            p = min(range(len(shares)), key=lambda p: (costs[p], p))
            order.append(p)
            taken[p] += 1
            costs[p] = parts._cost(p, taken[p])
        assert parts.taken(n) == taken
        first = draw.randrange(n)
        assert parts.stretch(first, min(50, n - first)).tolist() == order[first : first + 50]


def test_a_part_costs_what_the_rule_says():
    """The closed form against the difference of squared misses, below, across and above the target."""
    targets, wholes = [10.0, 20.0], [30.0, 40.0]
    parts = dedup.Parts(4.0, [0.0, 1.0], targets, [5.0, 6.0], wholes)
    miss = lambda c, t: (c - t) ** 2 / max(t, 1.0) * (3.0 if c > t else 1.0)
    for p, (h, w) in enumerate(((0.0, 5.0), (1.0, 6.0))):
        for k in range(12):
            a, b = h + 4 * k, w + 4 * k
            want = miss(a + 4, targets[p]) - miss(a, targets[p]) + 0.25 * ((b + 4 - wholes[p]) ** 2 - (b - wholes[p]) ** 2) / wholes[p]
            assert parts._cost(p, k) == pytest.approx(want, abs=1e-9)


def test_split_of_many_groups_equals_one_after_the_other(spark):
    """10 ** 5 groups of one kind and some of others, through the tables."""
    shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
    groups = spark.range(100_000).select(F.concat(F.lit("g"), "id").alias("group_id"), F.lit("x").alias("label"), F.lit(1).alias("size"))
    more = spark.createDataFrame([(f"h{i}", "y", 1 + i % 3) for i in range(60)], "group_id string, label string, size int")
    got = dedup.greedy_group_split(groups.union(more), shares)
    counts = {r["split"]: r["n"] for r in got.groupBy("split").agg(F.sum("size").alias("n")).collect()}
    assert got.count() == 100_060 and abs(counts["train"] / 100_120 - 0.7) < 1e-3 and abs(counts["validation"] - counts["test"]) <= 3


@pytest.mark.parametrize("rows,said", [
    ([("a", "x", 1), ("a", "y", 1), ("b", "x", 1), ("c", "x", 1)], "conflicting"),
    ([("a", "x", 1), ("a", "x", 1), ("b", "x", 1), ("c", "x", 1)], "more than one row"),
    ([("a", "x", 1), ("b", "x", 1)], "fewer groups"),
    ([("a", "x", 1), ("b", "x", 1), ("c", "x", 1)], "empty"),
])
def test_splits_that_are_refused(spark, rows, said):
    shares = {"train": 0.98, "validation": 0.01, "test": 0.01} if said == "empty" else {"train": 0.7, "validation": 0.15, "test": 0.15}
    with pytest.raises(ValueError, match=said):
        dedup.greedy_group_split(spark.createDataFrame(rows, "group_id string, label string, size int"), shares)
    with pytest.raises(ValueError, match="shares"):
        dedup.greedy_group_split(spark.createDataFrame(rows, "group_id string, label string, size int"), {"a": 0.5, "b": 0.6})


def test_a_group_matches_many_parts_each_by_itself():
    import pandas as pd

    rows = [(0, 0, p, p + d, p, 0.5 - d / 10) for p in range(0, 40, 2) for d in (0, 1)] + [(0, 1, 3, 90, 91, 0.4), (1, 1, 3, 90, 91, 0.3)]
    random.Random(1).shuffle(rows)
    frame = pd.DataFrame(rows, columns=["plot", "kind", "id", "pred", "ref", "iou"])
    got = sorted(instances._match_parts(frame).itertuples(index=False, name=None))
    assert got == sorted([(0, p, p, 0.5) for p in range(0, 40, 2)] + [(0, 90, 91, 0.4), (1, 90, 91, 0.3)])
    assert len(instances._match_parts(frame[:0])) == 0


def test_components_settle_without_a_round_more(spark, monkeypatch):
    monkeypatch.setattr(graphs, "MAX_ROUNDS", 1)  # a star is one after a round
    got = {r["node"]: r["root"] for r in graphs.components(spark.createDataFrame([(5, 1), (7, 1), (9, 8)], "a long, b long")).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 8: 8, 9: 8}
