"""Operators by hand-made tables with answers worked out by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import scalar
from millrace.operators import contracts, dedup, episodes, flows, instances, metrics, panel, sequence, spatial, stats, store
from millrace.operators.ranking import hash_ranked, numbered
from millrace.sources.readers import ContractError
from tests.conftest import rows


def test_scalars(spark):
    df = spark.createDataFrame([("2024-25",), ("1999-00",), ("2024-26",), ("1991-92",), ("x",), (None,), ("2024-25\n",)], "s string")
    assert [r[0] for r in df.select(scalar.matches_season(F.col("s"))).collect()] == [True, True, False, False, False, False, False]
    d = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in d.select(scalar.ratio(F.col("a"), F.col("b"))).collect()] == [0.0, 0.25, 0.0]
    x = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (None,)], "x double")
    assert [r[0] for r in x.select(scalar.finite(F.col("x"))).collect()] == [True, False, False, False]


FLOWS = [
    ("A", "Ay", "A", 1, 5), ("A", "Ay", "A", 2, 3), ("A", "Ay", "A", 3, 10), ("A", "Ay", "B", 3, 7), ("A", "Ay", "Z", 3, 4),
    ("B", "Be", "A", 3, 2), ("B", "Be", "B", 1, 1), ("B", "Be", "B", 2, 1), ("Z", "Ze", "A", 3, 100), ("B", "Be", "A", 9, 50),
]


def test_flows(spark):
    f = spark.createDataFrame(FLOWS, "origin string, origin_label string, destination string, indicator int, people long")
    codes = spark.createDataFrame([("A",), ("B",), ("C",)], "code string")
    agg = flows.origin_aggregates(f, codes)
    assert rows(agg, "origin") == [("A", "Ay", 29, 5, 3, 21, 17, 10), ("B", "Be", 4, 1, 1, 2, 2, 0)]
    assert rows(flows.destination_mass(f, codes), "code") == [("A", 112), ("B", 7), ("C", 0)]
    assert rows(flows.local_pairs(f, codes)) == [("A", "A", 10), ("A", "B", 7), ("B", "A", 2)]
    assert rows(flows.retention(agg), "origin")[0] == ("A", 4, round(17 / 21, 9), round(5 / 29, 9))
    assert rows(flows.totals(agg)) == [(2, 33, 23, 19, round(19 / 23, 9))]
    assert rows(flows.contract_violations(agg, codes)) == [(3, 1, 0, 0, 0, 0, 0)]


def test_flow_audits(spark):
    raw = [("A", "x", "A", "1", "5"), (None, "x", "A", "1", "5"), ("A", "x", None, "q", "5"), ("A", "y", "A", "2", "-1"), ("B", "x", "A", "3", "12\n"), ("A", "x", "A", "1", None)]
    df = spark.createDataFrame(raw, "origin string, origin_label string, destination string, indicator string, people string")
    assert rows(flows.invalid_rows(df)) == [(6, 1, 1, 1, 3, 5)]
    assert rows(flows.duplicate_keys(df)) == [("A", "A", "1", 2)]
    codes = spark.createDataFrame([("A",), ("B",)], "code string")
    assert rows(flows.inconsistent_origins(df, codes), "origin") == [("A", 2, 2), ("B", 1, 1)]


def test_moran_of_a_chain(spark):
    v = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0)], "code string, value double")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    z = np.array([-1.5, -0.5, 0.5, 1.5])
    w = np.array([[0, 1, 0, 0], [0.5, 0, 0.5, 0], [0, 0.5, 0, 0.5], [0, 0, 1, 0]])
    assert rows(spatial.morans_i(v, e)) == [(4, pytest.approx((z @ w @ z) / (z @ z)))]
    p = spatial.moran_permutation(v, e, 99).first()
    assert p["permutations"] == 99 and 0 < p["p_value"] <= 1
    assert rows(spatial.islands(v, e.limit(1)), "code") == [("c",), ("d",)]


def test_contiguity_and_gravity(spark):
    cells = spark.createDataFrame([(f"{x}{y}", x, y) for x in range(3) for y in range(3)], "code string, cx int, cy int")
    edges = rows(spatial.touching(spatial.cell_vertices(cells)))
    assert len(edges) == 20 and ("00", "11") in edges and ("00", "22") not in edges
    areas = spark.createDataFrame([("a", 0.0, 0.0), ("b", 3000.0, 4000.0)], "code string, x double, y double")
    mass = spark.createDataFrame([("a", 2), ("b", 3)], "code string, mass long")
    got = rows(spatial.gravity_access(areas, mass, (5,)), "origin")
    assert got == [("a", pytest.approx(2 + 3 * math.exp(-1), abs=1e-6)), ("b", pytest.approx(3 + 2 * math.exp(-1), abs=1e-6))]
    flow = spark.createDataFrame([("a", "b", 1), ("a", "a", 3)], "origin string, destination string, people long")
    assert rows(spatial.mean_local_distance(areas, flow), "origin") == [("a", 1250.0), ("b", 0.0)]


def frame_of(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [2.0, 5.0] + [1.0, -3.0]
    exposure = rng.integers(50, 200, n)
    mu = exposure * np.exp(-1 + 0.3 * x[:, 0] - 0.1 * x[:, 1])
    counts = rng.poisson(mu * rng.gamma(5, 0.2, n))
    return x, exposure, counts


def test_ridge_equals_numpy(spark):
    x, _, y = frame_of()
    df = spark.createDataFrame([(float(a), float(b), 4.0, float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, k double, y double")
    fit = stats.fit_ridge(df, ["a", "b", "k"], "y", 4.0)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 4 * np.eye(2), z.T @ (y - y.mean()))
    assert np.allclose(fit.weights, [*want, 0.0]) and fit.intercept == pytest.approx(y.mean())
    scored = df.select("a", "b", fit.score().alias("s")).limit(3).collect()
    assert all(r["s"] == pytest.approx(y.mean() + (([r["a"], r["b"]] - x.mean(0)) / x.std(0)) @ want) for r in scored)


def test_poisson_and_negative_binomial(spark):
    x, exposure, y = frame_of()
    df = spark.createDataFrame([(float(a), float(b), int(e), int(c)) for (a, b), e, c in zip(x, exposure, y, strict=True)], "a double, b double, e long, y long")
    d = np.column_stack((np.ones(len(y)), x))
    beta = np.array([np.log(y.sum() / exposure.sum()), 0, 0])
    for _ in range(50):
        mu = exposure * np.exp(d @ beta)
        beta = beta + np.linalg.solve(d.T @ (d * mu[:, None]), d.T @ (y - mu))
    got = {r["term"]: r for r in stats.poisson_glm(df, "y", "e", ["a", "b"]).collect()}
    assert [got[k]["estimate"] for k in ("intercept", "a", "b")] == pytest.approx(beta.tolist(), abs=1e-8)
    bread = np.linalg.inv(d.T @ (d * mu[:, None]))
    robust = np.sqrt(np.diag(bread @ (d.T @ (d * ((y - mu) ** 2)[:, None])) @ bread))
    assert [got[k]["robust_error"] for k in ("intercept", "a", "b")] == pytest.approx(robust.tolist())
    assert got["pearson_dispersion"]["estimate"] == pytest.approx(((y - mu) ** 2 / mu).sum() / (len(y) - 3))
    ll = sum(c * math.log(m) - m - math.lgamma(c + 1) for c, m in zip(y, mu, strict=True))
    assert got["aic"]["estimate"] == pytest.approx(6 - 2 * ll)
    nb = {r["term"]: r["estimate"] for r in stats.nb2_glm(df, "y", "e", ["a", "b"]).collect()}

    def likelihood(b, alpha):
        m = exposure * np.exp(d @ b)
        r = 1 / alpha
        return sum(math.lgamma(c + r) - math.lgamma(r) - math.lgamma(c + 1) + c * math.log(alpha * k / (1 + alpha * k)) - r * math.log(1 + alpha * k) for c, k in zip(y, m, strict=True))

    best = np.array([nb["intercept"], nb["a"], nb["b"]])
    assert nb["log_likelihood"] == pytest.approx(likelihood(best, nb["alpha"]))
    for i in range(3):
        for h in (-1e-3, 1e-3):
            assert likelihood(best + h * np.eye(3)[i], nb["alpha"]) < nb["log_likelihood"]
    assert max(likelihood(best, nb["alpha"] * f) for f in (0.98, 1.02)) < nb["log_likelihood"]


def test_binomial(spark):
    x, n, _ = frame_of()
    p = 1 / (1 + np.exp(-(0.5 - 0.4 * x[:, 0])))
    k = np.random.default_rng(1).binomial(n, p)
    df = spark.createDataFrame([(float(a), int(b), int(c)) for a, b, c in zip(x[:, 0], n, k, strict=True)], "a double, n long, k long")
    d = np.column_stack((np.ones(len(n)), x[:, 0]))
    beta = np.zeros(2)
    for _ in range(50):
        m = 1 / (1 + np.exp(-d @ beta))
        beta = beta + np.linalg.solve(d.T @ (d * (n * m * (1 - m))[:, None]), d.T @ (k - n * m))
    got = [r["estimate"] for r in stats.binomial_glm(df, "k", "n", ["a"]).collect()[:2]]
    assert got == pytest.approx(beta.tolist(), abs=1e-8)


PANEL = [("p", 1, 4), ("p", 2, 6), ("p", 4, 1), ("p", 5, 3), ("q", 1, 2), ("q", 2, 0), ("q", 3, 8), ("q", 4, 9), ("q", 5, 5)]


def make_panel(spark, values=PANEL):
    return spark.createDataFrame([(e, p, v, 90, int(v > 3), v * 2) for e, p, v in values], "entity string, period int, points long, minutes long, starts long, extra long")


def test_training_rows_never_skip_a_gap(spark):
    got = {(r["entity"], r["period"]): r for r in panel.training_frame(make_panel(spark)).collect()}
    assert ("p", 2) not in got and got["p", 4]["target"] == 3.0 and got["p", 1]["target"] == 6.0
    r = got["p", 4]
    assert (r["mean3_points"], r["started3"], r["season_points"], r["observed"]) == (pytest.approx(11 / 3), pytest.approx(2 / 3), 11.0, 3.0)
    assert max(p for _, p in got) == 4


def test_the_future_does_not_change_the_past(spark):
    changed = [(e, p, v + 1000 if p == 5 else v) for e, p, v in PANEL]
    before = panel.as_of(make_panel(spark)).where("period < 5").select("entity", "period", *panel.FEATURES)
    after = panel.as_of(make_panel(spark, changed)).where("period < 5").select("entity", "period", *panel.FEATURES)
    assert rows(before, "entity", "period") == rows(after, "entity", "period")


def test_sequences_of_periods(spark):
    p = make_panel(spark, [x for x in PANEL if x[1] != 3])
    assert rows(panel.period_gaps(p)) == [(4, 2)]
    assert rows(panel.sequence_summary(p)) == [(4, 1, 5, 2, 2, 8)]
    assert rows(panel.adjacent_coverage(make_panel(spark)), "period") == [(2, 2, 1.0), (3, 1, 0.5), (4, 1, 0.5), (5, 2, 1.0)]
    assert rows(panel.as_of_boundary(p, 5)) == [(5, True)]


def test_folds(spark):
    f = spark.createDataFrame([(t,) for t in (2, 3, 5, 6, 7, 9)] * 2, "target_period int")
    got = rows(panel.rolling_folds(f, 3, 2, 1), "fold", "target_period")
    assert got == [(0, "train", 2), (0, "train", 3), (0, "train", 5), (0, "test", 6), *[(1, "train", t) for t in (2, 3, 5, 6, 7)], (1, "test", 9)]
    assert panel.rolling_folds(f.limit(2), 3).count() == 0
    with pytest.raises(ValueError):
        panel.rolling_folds(f, 1)
    with pytest.raises(ValueError):
        panel.rolling_folds(f, 3, 1, 2)


def test_ridge_folds_equal_separate_fits(spark):
    rng = np.random.default_rng(2)
    made = panel.training_frame(make_panel(spark, [(f"e{i}", p, int(rng.integers(0, 20))) for i in range(25) for p in range(1, 9)]))
    folds = panel.rolling_folds(made)
    got = {(r["entity"], r["target_period"]): r["ridge"] for r in panel.ridge_oof(made, folds).collect()}
    train = made.where("target_period < 7")
    fit = stats.fit_ridge(train, panel.FEATURES, "target", 4.0)
    for r in made.where("target_period = 7").select("entity", fit.score().alias("s")).collect():
        assert got[r["entity"], 7] == pytest.approx(r["s"])


def test_ranking_metrics(spark):
    values = [("g", 1, 3.0, 3.0), ("g", 2, 2.0, 2.0), ("g", 3, 1.0, 1.0), ("h", 1, 1.0, 3.0), ("h", 2, 2.0, 2.0), ("h", 3, 3.0, 1.0), ("k", 1, 5.0, 1.0), ("k", 2, 5.0, 2.0), ("n", 1, -1.0, 1.0), ("n", 2, -2.0, 0.0)]
    df = spark.createDataFrame(values, "g string, entity int, actual double, predicted double")
    assert rows(metrics.spearman(df, ["g"]), "g") == [("g", pytest.approx(1)), ("h", pytest.approx(-1)), ("k", 0.0), ("n", pytest.approx(1))]
    n = {g: v for g, v in rows(metrics.ndcg(df, ["g"], 2), "g")}
    ideal = 7 + 3 / math.log2(3)
    assert n["g"] == pytest.approx(1) and n["h"] == pytest.approx((1 + 3 / math.log2(3)) / ideal) and n["n"] == 0.0
    assert rows(metrics.topk_overlap(df, ["g"], 2), "g") == [("g", 1.0), ("h", 0.5), ("k", 1.0), ("n", 1.0)]
    assert rows(metrics.point_metrics(df.where("g = 'k'")))[0][3] == 0.0


def test_classifier_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "actual int, predicted int")
    got = rows(metrics.class_prf(df, [0, 1, 2, 3]), "label")
    assert got == [(0, 2, 0.5, 0.5, 0.5), (1, 2, pytest.approx(2 / 3), 1.0, pytest.approx(0.8)), (2, 1, 0.0, 0.0, 0.0), (3, 0, 0.0, 0.0, 0.0)]
    s = metrics.classifier_summary(df, [0, 1, 2]).first()
    assert s["accuracy"] == pytest.approx(0.6) and s["balanced_accuracy"] == pytest.approx(0.5)
    assert s["mcc"] == pytest.approx((3 * 5 - (2 * 2 + 3 * 2)) / math.sqrt((25 - 13) * (25 - 9)))
    assert metrics.classifier_summary(df.where("actual = 0 and predicted = 0"), [0, 1]).first()["mcc"] == 0.0
    assert rows(metrics.confusion_matrix(df, [0, 1, 2]), "actual") == [(0, 1, 1, 0), (1, 0, 2, 0), (2, 1, 0, 0)]


def test_calibration_edges(spark):
    edge = 3 / 15
    df = spark.createDataFrame([(edge, True), (math.nextafter(edge, 1), False), (0.0, True), (1.0, True)], "confidence double, correct boolean")
    assert [r[:2] for r in rows(metrics.ece_bins(df), "bin")] == [(2, 1), (3, 1), (14, 1)]
    p = spark.createDataFrame([([1.0, 2.0, 2.0],)], "s array<double>")
    assert p.select(metrics.argmax("s")).first()[0] == 1
    soft = p.select(metrics.softmax("s").alias("p")).first()["p"]
    assert sum(soft) == pytest.approx(1) and soft[1] == pytest.approx(math.e / (1 + 2 * math.e))
    q = spark.createDataFrame([(0, [0.0, 1.0])], "actual int, probabilities array<double>")
    assert metrics.log_loss_brier(q).first()["log_loss"] == pytest.approx(-math.log(metrics.EPSILON))


def test_near_pairs_are_not_transitive(spark):
    h = [(1, 0b0000), (2, 0b0001), (3, 0b0111), (4, 0b0000)]
    df = spark.createDataFrame([(k, "x", v, f"c{min(k, 1) if k == 4 else k}") for k, v in h], "key int, block string, hash long, content string")
    assert rows(dedup.near_pairs(df, "key", "block", 4, 2), "a", "b") == [(1, 2, 1), (2, 3, 2), (2, 4, 1)]
    random.seed(3)
    many = [(k, "x", random.getrandbits(20), f"c{k}") for k in range(300)]
    got = rows(dedup.near_pairs(spark.createDataFrame(many, "key int, block string, hash long, content string"), "key", "block", 20, 4), "a", "b")
    assert [g[:2] for g in got] == [(a, b) for a, _, x, _ in many for b, _, y, _ in many if a < b and (x ^ y).bit_count() <= 4]


def test_hash_split_is_by_content(spark):
    df = spark.createDataFrame([(i, ["Word", str(i // 2)]) for i in range(2000)], "i int, tokens array<string>")
    got = {r["i"]: r["split"] for r in dedup.hash_split(df, F.col("tokens")).collect()}
    assert all(got[i] == got[i + 1] for i in range(0, 2000, 2))
    share = sum(v == "train" for v in got.values()) / 2000
    assert 0.65 < share < 0.75


def test_greedy_split_keeps_groups_and_shares(spark):
    values = [(f"g{i}", "ab"[i % 2], 1 + i % 5) for i in range(600)] + [("big", "a", 300)]
    df = spark.createDataFrame(values, "group_id string, label string, size int")
    split = dedup.greedy_group_split(df, {"train": 0.7, "validation": 0.15, "test": 0.15})
    assert split.count() == 601 and rows(split) == rows(dedup.greedy_group_split(df.repartition(9), {"train": 0.7, "validation": 0.15, "test": 0.15}))
    for label in "ab":
        total = sum(s for _, x, s in values if x == label)
        part = {r["split"]: r["s"] for r in split.where(F.col("label") == label).groupBy("split").agg(F.sum("size").alias("s")).collect()}
        assert part["train"] / total == pytest.approx(0.7, abs=0.03)


def test_spans(spark):
    tags = ["O", "I-A", "I-A", "B-A", "I-B", "O", "B-B", "B-B", "I-B"]
    df = spark.createDataFrame([(1, i, f"w{i}", t) for i, t in enumerate(tags)] + [(2, 0, "x", "I-B")], "s int, position int, token string, tag string")
    assert rows(sequence.spans(df, ["s"]), "s", "start") == [(1, "A", 1, 3), (1, "A", 3, 4), (1, "B", 4, 5), (1, "B", 6, 7), (1, "B", 7, 9), (2, "B", 0, 1)]
    other = sequence.spans(df, ["s"]).where("start <> 3")
    got = rows(sequence.span_metrics(sequence.spans(df, ["s"]), other, ["s"]), "label")
    assert got[0][:4] == ("A", 1, 0, 1) and got[1][:4] == ("B", 4, 0, 0)
    assert sequence.malformed(spark.createDataFrame([("B-",), ("O",), ("I-x",), ("X",), ("O\n",)], "tag string")).count() == 3


def test_vocabulary_and_padding(spark):
    df = spark.createDataFrame([(1, 0, "The"), (1, 1, "cat"), (1, 2, "the")], "s int, position int, token string")
    vocab = sequence.vocabulary(df)
    assert rows(vocab, "index") == [("<pad>", 0), ("<unk>", 1), ("cat", 2), ("the", 3)]
    new = spark.createDataFrame([(1, 0, "THE"), (1, 1, "dog")], "s int, position int, token string")
    coded = sequence.encoded(new, vocab)
    assert [r[3] for r in rows(coded, "position")] == [3, 1]
    assert rows(sequence.padded(coded, ["s"], 4)) == [(1, [3, 1, 0, 0], [1, 1, 0, 0])]
    assert rows(sequence.length_guard(df, ["s"], 2)) == [(1, 3)]
    h = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "epoch int, score double")
    assert rows(sequence.first_best(h, "score")) == [(2, 0.7, True)]


def points(spark, values):
    return spark.createDataFrame([(1, *v) for v in values], "plot long, pred long, ref long, cls int")


def test_boundary_is_strict(spark):
    half = points(spark, [(7, 1, 3), (7, 1, 4), (8, 2, 3), (8, 2, 3), (8, 2, 4)])
    assert rows(instances.boundary_excluded(half)) == [(1, 8, 3, 2)]


def test_instance_scores(spark):
    p = points(spark, [(7, 1, 4), (7, 1, 4), (0, 1, 4), (-1, 2, 5), (-5, 2, 5), (9, 3, 1), (9, -3, 4)])
    s = instances.plot_scores(p).first()
    assert (s["predicted"], s["referenced"], s["tp"], s["fp"], s["fn"], s["evaluated"]) == (3, 2, 2, 1, 0, 7)
    assert s["mean_iou"] == pytest.approx((2 / 3 + 1 / 2) / 2, abs=1e-6)


def test_ties_at_one_half(spark):
    p = points(spark, [(7, 1, 4), (7, 2, 4), (8, 3, 4), (9, 3, 4)])
    assert rows(instances.matches(p), "pred") == [(1, 7, 1, 0.5), (1, 8, 3, 0.5)]


def test_matching_below_one_half(spark):
    """Three predictions in a row over three references; at 0.25 only an augmenting path matches all."""
    values = [(1, 1, 4)] * 3 + [(1, 2, 4)] * 3 + [(2, 1, 4)] * 3 + [(2, 3, 4)] * 1 + [(3, 2, 4)] * 3
    assert instances.matches(points(spark, values), 0.3).count() == 2
    assert [r[1:3] for r in rows(instances.matches(points(spark, values), 0.25), "pred")] == [(1, 1), (2, 3), (3, 2)]


def test_matching_augments():
    assert instances.maximum_matching({1: [(1, 0.9), (2, 0.6)], 2: [(1, 0.8)]}) == [(1, 2), (2, 1)]
    random.seed(1)
    for _ in range(300):
        scores = {p: [(r, random.choice([0.5, 0.6, 0.7])) for r in range(6) if random.random() < 0.35] for p in range(6)}
        scores = {p: c for p, c in scores.items() if c}

        def best(left, used=frozenset(), scores=scores):
            if not left:
                return 0
            return max([best(left[1:], used), *[1 + best(left[1:], used | {r}) for r, _ in scores[left[0]] if r not in used]])

        got = instances.maximum_matching(scores)
        assert len(got) == best(sorted(scores)) == len({p for p, _ in got}) == len({r for _, r in got})
        assert all(r in {x for x, _ in scores[p]} for p, r in got)


def test_aggregates_and_reconstruction(spark):
    s = spark.createDataFrame([(1, "m", "x", 1, 1, 0, 0.5), (2, "m", "x", 3, 0, 0, 1.0), (3, "m", "y", 0, 0, 2, 0.0)], "plot int, method string, site string, tp long, fp long, fn long, f1 double")
    got = instances.aggregated(s, [["method"], ["method", "site"]])
    assert ("m", None, 3, 4, 1, 2, 0.8, pytest.approx(0.666667), pytest.approx(0.727273), 0.5, 0.5) in rows(got)
    assert rows(instances.differing(got, got)) == [(0, 0)]
    assert rows(instances.differing(got, got.withColumn("tp", F.col("tp") + 1))) == [(3, 3)]
    assert rows(instances.dense_index(spark.createDataFrame([(0,), (1,), (1,)], "i int"), "i")) == [(3, False)]


def test_store(spark, tmp_path):
    models = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "name string, seed int")
    first = store.register(spark.createDataFrame([], "name string, seed int, model_id string"), models, ["name", "seed"])
    assert first.count() == 2 and rows(store.register(first, models, ["name", "seed"])) == rows(first)
    offered = spark.createDataFrame([(1, "k", "v"), (2, "k2", "v"), (3, "k3", "new")], "batch_id int, k string, v string")
    stored = spark.createDataFrame([("k", "v"), ("k2", "w")], "k string, v string")
    assert [r[2] for r in rows(store.replay_status(stored, offered, ["k"], ["k", "v"]), "batch_id")] == ["replay", "conflict", "insert"]
    df = spark.range(5)
    assert store.write_batch(spark, str(tmp_path), "r1", df) and not store.write_batch(spark, str(tmp_path), "r1", spark.range(9))
    assert spark.read.parquet(f"{tmp_path}/run=r1").count() == 5
    assert store.schema_version(spark, str(tmp_path), 2) == 0 and store.schema_version(spark, str(tmp_path), 2) == 2
    with pytest.raises(ValueError):
        store.schema_version(spark, str(tmp_path), 1)
    one, other = (store.table_digest(d, ["id"]).first() for d in (spark.range(100), spark.range(100).repartition(7)))
    assert one == other and one != store.table_digest(spark.range(101), ["id"]).first()
    p = spark.createDataFrame([("r", 2, 5), ("r", 1, 9), ("s", 1, 9)], "run_id string, rank int, entity int")
    assert [r["rank"] for r in store.page(p, "r", 1).collect()] == [1]
    found, missing = store.lookup(p, spark.createDataFrame([(9,), (77,)], "entity int"))
    assert found.count() == 2 and missing == 1
    with pytest.raises(ValueError):
        store.page(p, "r", 501)


def test_episodes(spark):
    e = spark.createDataFrame([(0,), (250,), (900,)], "e int")
    assert [r[0] for r in e.select(F.round(episodes.epsilon(F.col("e"), 1.0, 0.1, 500), 6)).collect()] == [1.0, 0.55, 0.1]
    s = spark.createDataFrame([(1, u, t) for u in (1, 2) for t in range(10)], "x int, user int, t int")
    assert sorted((r["user"], r["t"]) for r in episodes.latest_n(s, 2, ["user"], "t").collect()) == [(1, 8), (1, 9), (2, 8), (2, 9)]
    assert episodes.sample(spark.range(100), 10, "id").collect() == episodes.sample(spark.range(100).repartition(5), 10, "id").collect()
    c = F.lit
    flat = e.limit(1).select(episodes.shaped_reward(c(1.0), c(0.1), c(0.1), c(0.0), c(-0.1), c(0.0), c(True), c(True), c(True)).alias("r")).first()["r"]
    assert flat == pytest.approx(1 - 0.03 - 0.25)
    near = e.limit(1).select(episodes.shaped_reward(c(1.0), c(0.05), c(0.1), c(0.0), c(-0.1), c(0.1), c(True), c(True), c(True)).alias("r")).first()["r"]
    assert near == pytest.approx(1 - 0.015 - 0.125 + 0.03 + 8)


def test_numbering_and_hash_ranks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(6)
    assert [r["index"] for r in numbered(df, ["v"]).orderBy("v").collect()] == list(range(1000))
    ranked = hash_ranked(df.withColumn("g", F.col("v") % 3), ["g"], F.sha2(F.col("v").cast("string"), 256))
    by = {}
    for r in ranked.collect():
        by.setdefault(r["g"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert rows(contracts.one_to_one(a, a.withColumnRenamed("v", "w"), ["k"])) == [(1, "x", "x"), (2, "y", "y")]
    with pytest.raises(ContractError):
        contracts.one_to_one(a, a.union(a).withColumnRenamed("v", "w"), ["k"])
    with pytest.raises(ContractError):
        contracts.aligned(spark.createDataFrame([(1,), (3,)], "k int"), a, "k")
    gap = make_panel(spark, [x for x in PANEL if x[1] != 3])
    with pytest.raises(ContractError):
        contracts.sequence_contract(gap)
    with pytest.raises(ContractError):
        contracts.sequence_contract(make_panel(spark), 0.6)
    assert contracts.sequence_contract(make_panel(spark), 0.5).count() == len(PANEL)
    d = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, v double")
    e = spark.createDataFrame([(1, 1.0 + 1e-12), (2, 2.5), (4, 4.0)], "k int, v double")
    assert rows(contracts.apart(d, e, ["k"], ["v"]), "k") == [(2, 0.5), (3, None), (4, None)]
    assert contracts.contained("/data", "a/../b.png") == "/data/b.png"
    for bad in ("../x", "/etc/passwd", "a/../../x"):
        with pytest.raises(ContractError):
            contracts.contained("/data", bad)
    contracts.agrees({"season": "a", "x": 1}, {"season": "a"})
    with pytest.raises(ContractError):
        contracts.agrees({"season": "a"}, {"season": "b"})
    contracts.fixed_protocol("mine", {"threshold": 0.4}, "standard", {"threshold": 0.5})
    with pytest.raises(ContractError):
        contracts.fixed_protocol("standard", {"threshold": 0.4}, "standard", {"threshold": 0.5})


def test_padding_is_to_the_longest_sentence(spark):
    tokens = [("a", i, i + 2) for i in range(40)] + [("b", 0, 9)]
    got = {r["s"]: (r["ids"], r["mask"]) for r in sequence.padded(spark.createDataFrame(tokens, "s string, position int, token_id long"), ["s"]).collect()}
    assert got == {"a": (list(range(2, 42)), [1] * 40), "b": ([9] + [0] * 39, [1] + [0] * 39)}


def test_early_stop_waits_for_patience_and_keeps_the_first_best(spark):
    scores = {"a": [1.0, 3.0, 3.0, 2.0, 9.0], "b": [1.0, 2.0, 1.0], "c": [5.0]}
    history = spark.createDataFrame([(k, i + 1, s) for k, v in scores.items() for i, s in enumerate(v)], "run string, epoch int, score double")
    assert rows(sequence.early_stop(history, ["run"], "score", 2)) == [("a", 4, 2), ("b", 3, 2), ("c", 1, 1)]
