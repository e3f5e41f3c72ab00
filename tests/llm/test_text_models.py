"""Language ID, toxicity and personal data."""

import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import langid, pii, toxicity
from millrace.session import table
from tests.conftest import rows

BIG = "/root/testdata/sf0.1"


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def test_ngrams_by_hand():
    grams = langid.ngrams("Ab, a")
    one = [ord("a"), ord("b"), ord("a")]
    pairs = [" a", "ab", "b ", " a", "a "]
    threes = [" ab", "ab ", " a "]
    key = lambda s: sum(ord(c) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
    assert sorted(grams.tolist()) == sorted(one + [key(p) for p in pairs + threes])


def test_listed_is_by_frequency_then_value():
    assert langid.listed("b a a")[:1].tolist() == [ord(" ") << 21 | ord("a")] or langid.listed("b a a")[0] == ord("a")
    assert len(langid.listed("abcdefghijklmnopqrstuvwxyz" * 50, 10)) == 10


def test_distance_by_brute_force():
    profiles = langid.Profiles({"x": [3, 1, 2], "y": [9, 3]})
    text = "some words here"
    own = langid.listed(text).tolist()
    for row, ranked in zip(profiles.distances(text), ([3, 1, 2], [9, 3]), strict=True):
        want = sum(min(3, abs(ranked.index(g) - i)) if g in ranked else 3 for i, g in enumerate(own))
        assert row == pytest.approx(want / (3 * len(own)))


def test_languages_are_found(spark):
    documents = table(spark, BIG, "documents")
    got = langid.identify(documents, langid.fit(documents)).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == documents.count()
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in got)
    out = [r for r in got if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97


def test_language_cases(odd, empty):
    profiles = langid.fit(odd)
    got = rows(langid.identify(odd, profiles), "doc_id")
    by = [(r[0], r[2]) for r in got]
    assert len(got) == 11 and {d for d, p in by if p == "und"} == {2, 3, 4, 5}
    assert all(0 <= r[3] <= 1 for r in got)
    kept = langid.keep_identified(odd, profiles)
    assert kept.columns == odd.columns and kept.count() == 7
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert {r[2] for r in rows(langid.identify(odd, langid.fit(empty)))} == {"und"}


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable")
    p = labels.sum()
    return (order[labels == 1].sum() - p * (p - 1) / 2) / (p * (len(labels) - p))


def test_toxicity_is_found(spark):
    documents, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    got = toxicity.score(documents, toxicity.fit(documents, labels)).join(labels, "doc_id").where("held_out").collect()
    s, y = np.array([r["score"] for r in got]), np.array([r["toxic"] for r in got])
    assert auc(s, y) > 0.93 and np.mean((s >= 0.5)[y == 0]) < 0.02 and np.mean((s >= 0.5)[y == 1]) > 0.85
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_risk_is_not_negative_and_labels_of_negatives_are_not_used():
    toxic = [f"bad{i % 7} thing number {i}" for i in range(60)]
    clean = [f"good{i % 9} thing number {i}" for i in range(500)]
    weights, bias = toxicity.train(toxic, clean + toxic[:50], 0.1)
    s = toxicity.Scorer(weights, bias)
    assert min(s.score(t) for t in toxic) > 0.5 > max(s.score(t) for t in clean)
    assert s.score(None) == s.score("") < 0.5


def test_toxicity_cases(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 1), (7, 1, None), (None, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    scorer = toxicity.fit(odd, labels)
    got = rows(toxicity.score(odd, scorer), "doc_id")
    assert len(got) == 11 and all(0 <= r[2] <= 1 for r in got)
    nothing = toxicity.fit(odd, labels.limit(0))
    assert {r[2] for r in rows(toxicity.score(odd, nothing))} == {0.0}
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert toxicity.keep_clean(odd, nothing).count() == 11


PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            found.append((*m.span(), kind))
    return sorted(found, key=lambda s: (s[0], s[2]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123459.@+- ()ab%_\né٣", max_size=60))
def test_patterns_match_the_plain_ones(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_patterns_on_pieces():
    random.seed(5)
    parts = ["4111 1111 1111 1111", "1.2.3.4", "255.255.255.256", "001.002.003.0004", "+1 (988) 555-2485", "a.b@c.d", "@x.y", "a@b@c.de.f", "4111-1111-1111-1112", "9" * 30]
    for _ in range(500):
        text = random.choice(["", " ", ", "]).join(random.choices(parts, k=5))
        assert pii.base_spans(text) == plain_spans(text)


def test_patterns_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "@a-" * 100_000):
        pii.base_spans(text)


def test_field_carries_labels_to_similar_tokens(spark):
    field = pii.fit(table(spark, BIG, "documents"))
    text = "call +1 (988) 555-2485 today, and later 988-555-2485; host 42.144.35.254 or 42-144-35-254. version 3. 16 items"
    ((base, every),) = pii.find([text], field)
    assert pii.joined(base) == "phone:5:22,ip:59:72"
    assert set(base) <= set(every)
    assert {text[a:b] for a, b, _ in set(every) - set(base)} == {"988-555-2485", "42-144-35-254"}
    ((_, alone),) = pii.find(["order 988-555-2485 and 42-144-35-254 of version 3."], field)
    assert alone == []
    assert pii.redacted(text, every).startswith("call [PHONE] today, and later [PHONE]; host [IP] or [IP]. version")


def test_belief_propagation_is_exact_on_a_tree():
    rng = np.random.default_rng(0)
    n, k = 5, len(pii.KINDS) + 1
    field = pii.Field(rng.normal(size=(pii.BUCKETS, k)), np.zeros(k), rng.normal(size=(k, k)), np.eye(k) * 1.5)
    graph = pii.Graph()
    graph.at = [(0, i, i + 1) for i in range(n)]  # as the flat arrays have them
    graph.label, graph.features = [-1] * n, [[i] for i in range(n)]
    graph.chain, graph.skip = [(0, 1), (1, 2), (3, 4)], [(1, 3)]
    marginal = np.zeros((n, k))
    for labels in np.ndindex(*[k] * n):
        z = sum(field.unary[i, labels[i]] for i in range(n))
        z += sum(field.chain[labels[a], labels[b]] for a, b in graph.chain) + sum(field.skip[labels[a], labels[b]] for a, b in graph.skip)
        for i in range(n):
            marginal[i, labels[i]] += np.exp(z)
    assert field.decode(graph).tolist() == marginal.argmax(1).tolist()


def test_fields_do_not_depend_on_other_documents(spark):
    field = pii.fit(table(spark, BIG, "documents"))
    texts = [r["text"] for r in table(spark, BIG, "documents").orderBy("doc_id").limit(300).collect()]
    texts += ["call +1 (988) 555-2485 now " + "then 988-555-2485 again " * 200, None, "", "1.2.3.4 1-2-3-4 x@y.z"]
    assert pii.find(texts, field) == [pii.find([t], field)[0] for t in texts]


def test_skip_potentials_are_trained():
    graph, texts = pii.Graph(), []
    for i in range(300):
        texts.append(f"mail a{i}@b.de or see a{i}@b.de and +1 (988) 555-{1000 + i} or +1 (988) 555-{1000 + i} of {i} items")
        graph.add(i, texts[-1], pii.base_spans(texts[-1]), gold=True)
    field = pii.Field.train(graph)
    reward = field.skip[0, 0]
    assert (field.skip == np.eye(5) * reward).all() and 1 < reward <= pii.BOUND
    labels = np.array(graph.label)
    skip = np.array(graph.skip).reshape(-1, 2)
    assert (labels[skip[:, 0]] == labels[skip[:, 1]]).all()
    graph.label = [-1] * len(labels)
    assert (field.decode(graph) == labels).mean() > 0.95


def test_a_text_of_numbers_takes_bounded_memory():
    rng = np.random.default_rng(0)
    text = " ".join(map(str, rng.integers(10**6, 10**8, 20_000)))
    k = len(pii.KINDS) + 1
    field = pii.Field(np.zeros((pii.BUCKETS, k)), np.array([1.5, 0, 0, 0, 0]), np.zeros((k, k)), np.eye(k) * 3)
    tracemalloc.start()
    pii.find([text], field)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150 * len(text)


def test_pii_cases(spark, odd, empty):
    field = pii.fit(odd)
    got = rows(pii.spans(odd, field), "doc_id")
    assert len(got) == 11 and {r[6] for r in got} == {""}
    assert pii.spans(empty, pii.fit(empty)).count() == 0
    assert sorted(repr(r) for r in rows(pii.redact(odd, field).drop("n_chars"))) == sorted(repr(r) for r in rows(odd.drop("n_chars")))
    one = spark.createDataFrame([(1, "mail a.b@c.de now", 99)], "doc_id long, text string, n_chars long")
    assert rows(pii.redact(one, None)) == [(1, "mail [EMAIL] now", 16)]


def test_redaction_merges_overlaps():
    assert pii.redacted("0123456789", [(1, 4, 3), (2, 6, 2), (5, 6, 1), (8, 9, 0)]) == "0[PHONE]67[EMAIL]9"


def test_pieces_of_a_long_text_count_the_same(monkeypatch):
    random.seed(4)
    text = " ".join("".join(random.choices("abcdé", k=random.randrange(1, 9))) for _ in range(3000)) + " " + "z" * 500
    whole = langid.listed(text)
    monkeypatch.setattr(langid, "PIECE", 37)
    assert langid.listed(text).tolist() == whole.tolist()


def test_toxicity_learns_from_a_bounded_sample(spark, monkeypatch):
    """A toxic id with a third of the rows, and texts beyond the bound: each text is drawn once, and no more characters than allowed."""
    from millrace.llm import toxicity

    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 1L, id) AS doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) AS text")
    rows = rows.selectExpr("*", "xxhash64(doc_id, text) AS key")
    drawn = [r["text"] for r in toxicity._drawn(rows, 500).collect()]
    assert len(drawn) == len(set(drawn)) == 500
    monkeypatch.setattr(toxicity, "CHARACTERS", 200)
    assert 100 < sum(len(r["text"]) for r in toxicity._drawn(rows, 500).collect()) <= 200
    monkeypatch.setattr(toxicity, "LONGEST", 7)
    assert {len(r["text"]) for r in toxicity._drawn(rows, 500).collect()} <= {6, 7}
    assert toxicity._drawn(rows.limit(0), 5).count() == 0
