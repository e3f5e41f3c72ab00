"""Periodic runs, centroid clustering and one-bit-code search against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, kmeans, periodic
from tests.conftest import rows


def plain_runs(words, least, exponent):
    """By definition: for each period, all longest stretches whose words agree at that distance."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, exponent * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def numbered(texts):
    """Numbers for words, different in different texts."""
    made, base = [], 0
    for words in texts:
        number = {}
        made.append(np.array([number.setdefault(w, base + len(number)) for w in words], np.int64))
        base += len(number)
    return made


@pytest.mark.parametrize("exponent,least", [(2, 1), (2, 6), (3, 6), (4, 6), (5, 2)])
def test_runs_equal_brute_force(exponent, least):
    draw = random.Random(exponent * 10 + least)
    for _ in range(400):
        texts = []
        for _ in range(draw.randint(1, 4)):
            words = draw.choices("abcd"[: draw.randint(1, 4)], k=draw.randint(0, 40))
            if words and draw.random() < 0.5:
                a = draw.randrange(len(words))
                p = draw.randint(1, max(1, (len(words) - a) // 2))
                words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(len(words))]
            texts.append(words * draw.choice((1, 1, 3)))
        assert periodic.find(numbered(texts), least, exponent) == [plain_runs(t, least, exponent) for t in texts]


def test_previous_factors_by_brute_force():
    draw = random.Random(2)
    for _ in range(60):
        words = draw.choices("abc", k=draw.randint(1, 30))
        (codes,) = numbered([words])
        length, source = periodic.previous_factors(periodic.Names(codes, np.full(len(codes), len(codes))))
        for i in range(len(words)):
            shared = [next((k for k in range(len(words) - i) if words[j + k] != words[i + k]), len(words) - i) for j in range(i)]
            assert length[i] == max(shared, default=0)
            assert not length[i] or shared[source[i]] == length[i]


def plain_op11(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words, 6, 4)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()), sha(kept))


def test_op11_equals_a_plain_version(spark):
    draw = random.Random(4)
    docs = [(i, " ".join(draw.choices(["a", "b", "ç", "dd e", "　"], k=draw.randint(0, 60)))) for i in range(300)]
    docs += [(1000 + i, draw.choice(["  ", "\t", "x\x0by\x0c "]) + "la " * draw.randint(0, 40)) for i in range(40)]
    docs += [(None, "go " * 9), (7, None), (7, None), (8, "﻿x " * 20), (8, "﻿x " * 20)]
    table = spark.createDataFrame([(*d, "mine", 3) for d in docs], "doc_id long, text string, runs string, n_words int")
    for parts in (1, 5):
        got = periodic.digests(periodic.detect(periodic.repeating(table.repartition(parts))))
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(plain_op11(*d)) for d in docs)


def test_runs_odd_rows(spark, odd, empty):
    got = rows(periodic.detect(odd), "doc_id")
    assert len(got) == odd.count()
    long = next(r for r in got if r[0] == 7)
    assert long[1] == 30000 and [tuple(r) for r in long[2]] == [(0, 30000, 1)] and long[3] == "word"
    assert [r[1:] for r in got if r[0] in (2, 3, 4)] == [(0, [], "")] * 3
    assert periodic.digests(periodic.detect(periodic.repeating(empty))).count() == 0
    by_name = spark.createDataFrame([("k", "a b " * 5)], "doc_id string, text string")
    assert [tuple(r) for r in periodic.detect(by_name).first()["runs"]] == [(0, 10, 2)]
    with pytest.raises(ValueError):
        periodic.detect(odd, min_exponent=1)


def test_a_long_text_of_runs_takes_little(spark):
    words = np.tile(np.arange(7), 40_000)
    assert periodic.find([words]) == [[(0, 280_000, 7)]]


def plain_lloyd(vectors, k, rounds):
    """(vec_id, whole-number vector) rows to {row: (cluster, distance)} and centroids, in Python's numbers."""
    order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0] is None, vectors[i][0] is not None and hashlib.sha256(f"2:{vectors[i][0]}".encode()).hexdigest(), vectors[i][1]))
    centroids = [list(vectors[i][1]) for i in order[:k]]
    for r in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in vectors]
        if r < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, n) in zip(vectors, near, strict=True) if n == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, j, d) for (i, _), (d, j) in zip(vectors, near, strict=True)], centroids


def clustered(spark, values, **how):
    dims = how.pop("dims", 4)
    made = spark.createDataFrame([(i, v, "c", 1) for i, v in values], "vec_id long, embedding array<double>, cluster string, distance int")
    return kmeans.clustered(made.where(kmeans.usable(dimensions=dims)).select("vec_id", kmeans.quantised().alias("vec")), **how)


@pytest.mark.parametrize("scale", [1.0, 3e5, 2e14])
def test_lloyd_equals_a_plain_version(spark, scale):
    draw = random.Random(9)
    values = [(i, [draw.randint(-9, 9) * scale / 16 for _ in range(4)]) for i in range(150)]
    values += [(200 + i % 3, [0.5, 0.5, -0.25, 0.0]) for i in range(80)] + [(None, [1.0, 1.0, 1.0, 1.0])]
    left_out = [(300, None), (301, [1.0, None, 2.0, 3.0]), (302, [float("nan")] * 4), (303, [float("-inf")] * 4), (304, [1.0]), (305, [1.0] * 5), (306, [])]
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in values]
    want, centroids = plain_lloyd(whole, 12, 3)
    got = clustered(spark, values + left_out, k=12, rounds=3).collect()
    assert sorted(map(repr, ((r["vec_id"], r["cluster"], r["distance"]) for r in got))) == sorted(map(repr, ((i, j, min(d, 2**63 - 1)) for i, j, d in want)))
    for r in got:
        own = min(2**63 - 1, sum(d for _, j, d in want if j == r["cluster"]))
        assert (r["cluster_inertia"], r["inertia"]) == (own, min(2**63 - 1, sum(d for _, _, d in want)))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_lloyd_cases(spark):
    two = [(0, [1.0, 2.0, 3.0, 4.0]), (1, [9.0, 9.0, 9.0, 9.0])]
    got = clustered(spark, two)
    assert sorted(r["distance"] for r in got.collect()) == [0, 0] and got.select("cluster").distinct().count() == 2
    assert clustered(spark, []).count() == 0 and clustered(spark, []).columns == got.columns
    same = clustered(spark, [(i, [0.0, 0.0, 0.0, 0.0]) for i in range(50)], k=4).collect()  # all ties: the first centroid, the others stay empty
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in same} == {(0, 0, 0)}


def test_lloyd_does_not_depend_on_partitions(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").where(kmeans.usable()).select("vec_id", kmeans.quantised().alias("vec"))
    assert rows(kmeans.clustered(vectors.repartition(1))) == rows(kmeans.clustered(vectors.repartition(7)))


def searched(spark, values, **how):
    made = spark.createDataFrame([(i, v, 2, "s") for i, v in values], "vec_id long, vec array<float>, rank int, score string")
    made = made.where(ann.usable("vec") & F.col("vec_id").isNotNull())
    return ann.search(made.where("vec_id % 50 = 0"), ann.index(made), **how)


def plain_cosines(values, k=5):
    """{query: [(score, id)]} of all candidates, best first."""
    unit = [(i, np.array(v, np.float32).astype(float)) for i, v in values]
    out = {}
    for q, a in unit:
        if q % 50 == 0:
            scores = {(float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), j) for j, b in unit if j != q and len(a) == len(b)}
            out[q] = sorted(scores, key=lambda x: (-x[0], x[1]))
    return out


def test_rotation_is_orthogonal_and_estimates_are_near():
    for d in (1, 2, 64, 100):
        assert np.allclose(ann.rotation(d) @ ann.rotation(d).T, np.eye(d))
    rng = np.random.default_rng(3)
    m = rng.standard_normal((4000, 64))
    m /= np.sqrt((m * m).sum(1))[:, None]
    packed, corrections = ann.signs(m)
    assert packed.shape == (4000, 8)
    bits = (np.unpackbits(packed, axis=1) * 2.0 - 1) / 8
    bound = ann.EPSILON * np.sqrt((1 - corrections**2) / (corrections**2 * 63))
    q = m[:20]
    error = (q @ ann.rotation(64)) @ bits.T / corrections - q @ m.T
    assert (np.abs(error) <= bound).mean() > 0.95 and abs(error[:, 20:].mean()) < 0.01


def test_neighbours_are_found_with_exact_scores(spark):
    rng = np.random.default_rng(5)
    values = [(i, [float(x) for x in rng.standard_normal(48)]) for i in range(1500)]
    values += [(2000 + i, [x + float(e) for x, e in zip(values[i * 50][1], rng.standard_normal(48) * 0.2, strict=True)]) for i in range(30)]
    values += [(3000 + i, values[50][1]) for i in range(300)]  # many copies of a query: ties by id
    want = plain_cosines(values)
    got = rows(searched(spark, values), "query_id", "rank")
    found, total = 0, 0
    for q, best in want.items():
        own = [r for r in got if r[0] == q]
        assert [r[1] for r in own] == [1, 2, 3, 4, 5]
        assert [(-r[3], r[2]) for r in own] == sorted((-r[3], r[2]) for r in own)
        exact = {j: s for s, j in best}
        assert all(abs(exact[r[2]] - r[3]) < 1e-14 for r in own)
        found += len({r[2] for r in own} & {j for _, j in best[:5]})
        total += 5
    assert found / total >= 0.95
    assert [r[2] for r in got if r[0] == 50] == [3000, 3001, 3002, 3003, 3004]
    assert [r[2] for r in got if r[0] == 3000] == [50, 3001, 3002, 3003, 3004]


def test_without_bounds_the_search_is_exact(spark):
    rng = np.random.default_rng(6)
    values = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(400)]
    values = [(i, v) for i, v in values if any(v)]
    got = rows(searched(spark, values, epsilon=1e9), "query_id", "rank")
    for q, best in plain_cosines(values).items():
        assert np.allclose([r[3] for r in got if r[0] == q], [s for s, _ in best[:5]], atol=1e-12)


def test_search_odd_rows(spark):
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 9.0]), (1, [0.5, 0.5]), (50, [3.0]), (100, [0.0, 0.0]), (150, None), (200, [None, 1.0]), (250, [float("nan"), 1.0]), (None, [1.0, 1.0]), (300, [])]
    got = rows(searched(spark, few), "query_id", "rank")
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2)] and abs(got[0][3] - 0.5**0.5) < 1e-15
    assert searched(spark, []).count() == 0
    huge = [(0, [3e38, 1e-38]), (1, [2e38, 1e38]), (2, [1e-38, 1e-38])]  # squares that a float does not hold
    assert [r[2] for r in rows(searched(spark, huge), "query_id", "rank")] == [1, 2]
