"""Models and digests against plain versions of what they compute."""

import base64
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import digest, langid, pii, toxicity
from millrace.session import table


def test_profiles_and_predictions_equal_plain_counts(spark, data):
    documents = table(spark, data, "documents")
    every = documents.select("doc_id", "text", "lang").collect()
    counts: dict[str, Counter] = {}
    for r in every:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            counts.setdefault(r["lang"], Counter()).update(langid.ngrams(r["text"] or "").tolist())
    ranked = {k: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))][: langid.PROFILE] for k, c in counts.items()}
    profiles = langid.fit(documents)
    assert profiles.languages == sorted(ranked)
    for language, ranks in zip(profiles.languages, profiles.ranks, strict=True):
        assert [g for _, g in sorted((r, g) for r, g in zip(ranks.tolist(), profiles.grams.tolist(), strict=True) if r >= 0)] == ranked[language]
    got = {r["doc_id"]: r for r in langid.identify(documents, profiles).collect()}
    most = max(map(len, ranked.values()))
    places = {k: {g: i for i, g in enumerate(v)} for k, v in ranked.items()}
    for r in every[:25]:
        own = [g for g, _ in sorted(Counter(langid.ngrams(r["text"] or "").tolist()).items(), key=lambda x: (-x[1], x[0]))][: langid.LISTED]
        apart = {k: sum(min(most, abs(p[g] - i)) if g in p else most for i, g in enumerate(own)) for k, p in places.items()}
        assert got[r["doc_id"]]["lang_pred"] == min(sorted(apart), key=apart.get)


def plain_train(positive, unlabelled, prior):
    """Adam on the corrected risk, with dense rows and slopes by differences; which way each step went."""
    chosen = toxicity.choose_features(positive, unlabelled)
    dense = lambda texts: np.array([[toxicity.features(t).get(f, 0.0) for f in chosen] + [1.0] for t in texts])
    xp, xu = dense(positive), dense(unlabelled)
    loss = lambda z: np.log1p(np.exp(z)).mean()
    negative = lambda w: loss(xu @ w) - prior * loss(xp @ w)
    w = np.zeros(len(chosen) + 1)
    w[-1] = math.log(prior / (1 - prior))
    m, v, ways = np.zeros_like(w), np.zeros_like(w), []
    for step in range(1, toxicity.ROUNDS + 1):
        ways.append(negative(w) >= 0)

        def risk(w, forward=ways[-1]):
            return (prior * loss(-(xp @ w)) + negative(w) if forward else -negative(w)) + toxicity.PENALTY / 2 * (w[:-1] ** 2).sum()

        g = np.array([(risk(w + e) - risk(w - e)) / 2e-5 for e in np.eye(len(w)) * 1e-5])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return chosen, w, ways


@pytest.mark.parametrize("prior", [0.1, 0.6])
def test_training_equals_steps_by_differences(prior, monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", 40)
    toxic = [f"bad{i % 3} thing number {i}" for i in range(40)]
    clean = [f"good{i % 5} thing number {i}" for i in range(200)]
    chosen, want, ways = plain_train(toxic, clean + toxic[:10], prior)
    weights, bias = toxicity.train(toxic, clean + toxic[:10], prior)
    assert chosen and list(weights) == chosen
    assert [*weights.values(), bias] == pytest.approx(want.tolist(), abs=1e-4)
    assert ways[0] and (prior < 0.5 or not all(ways))


def plain_filters(hashes):
    out = []
    for at in range(0, len(hashes), digest.PER_FILTER):
        out.append({(h >> (11 * k)) % digest.FILTER_BITS for h in hashes[at : at + digest.PER_FILTER] for k in range(digest.HASHES)})
    return out


def plain_likeness(a, b):
    best = []
    for x in a:
        each = []
        for y in b:
            chance, most = len(x) * len(y) / digest.FILTER_BITS, min(len(x), len(y))
            each.append(min(1.0, max(0.0, (len(x & y) - chance) / max(most - chance, 1e-9))))
        best.append(max(each))
    return sum(best) / len(best)


def test_filters_and_likeness_equal_plain_sets():
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for n, m, shared in ((1, 1, 1), (30, 45, 20), (digest.PER_FILTER, digest.PER_FILTER + 1, 50), (150, 600, 120), (3 * digest.PER_FILTER, 2, 1)):
        a = np.concatenate((common[:shared], rng.integers(0, 1 << 63, n - shared, dtype=np.uint64)))
        b = np.concatenate((common[:shared], rng.integers(0, 1 << 63, m - shared, dtype=np.uint64)))
        filters = [plain_filters([int(h) for h in x]) for x in (a, b)]
        made = [digest.Digest(x) for x in (a, b)]
        for text, size, want in ((made[0].text(), n, filters[0]), (made[1].text(), m, filters[1])):
            said, _, data = text.partition(":")
            raw = base64.b64decode(data)
            width = digest.FILTER_BITS // 8
            got = [{8 * i + k for i in range(width) for k in range(8) if raw[f * width + i] >> (7 - k) & 1} for f in range(len(raw) // width)]
            assert int(said) == size and got == want
        short, long = sorted(((len(f), s, f) for f, s in zip(filters, (n, m), strict=True)), key=lambda x: x[:2])
        assert made[0].likeness(made[1]) == pytest.approx(plain_likeness(short[2], long[2]), abs=1e-9)
        assert made[1].likeness(made[0]) == made[0].likeness(made[1])


NAMES = ["ana.bell", "bo_lund", "cy.marsh", "di.roe", "ed.stone", "flo.wu"]


def mentions(draw, n):
    """Texts with personal data of each kind among words and numbers that are none."""
    texts = []
    for _ in range(n):
        parts = [draw.choice(["word", "more", "text", "12", "3.5", "2024", "7,000", "x9"]) for _ in range(draw.randint(20, 60))]
        for _ in range(draw.randint(0, 3)):
            digits = [draw.randrange(10) for _ in range(15)]
            check = next(d for d in range(10) if pii.luhn("".join(map(str, digits)) + str(d)))
            made = draw.choice([
                f"{draw.choice(NAMES)}@mail{draw.randrange(9)}.org", ".".join(str(draw.randrange(256)) for _ in range(4)), "".join(map(str, digits)) + str(check),
                f"+1 ({draw.randrange(200, 999)}) 555-{draw.randrange(1000, 9999)}",
            ])
            parts.insert(draw.randrange(len(parts)), made + " and")
        texts.append(" ".join(parts))
    return texts


def test_field_finds_what_the_patterns_run_over():
    """Two whole numbers side by side, of which the pattern makes a too long one: both are found, each by itself."""
    draw = random.Random(6)
    graph = pii.Graph()
    for i, text in enumerate(mentions(draw, 400)):
        graph.add(i, text, pii.base_spans(text), gold=True)
    field = pii.Field.load(pii.Field.train(graph).dump())
    text = "call +1 (826) 555-4081 190.137.223.204 or pay 4539578763621486 4716258050958645 or 4539578763621487 4716258050958646 now"
    assert pii.luhn("4539578763621486") and pii.luhn("4716258050958645")
    ((base, every),) = pii.find([text], field)
    said = lambda spans: [(pii.KINDS[k], text[a:b]) for a, b, k in spans]
    assert said(base) == [("ip", "190.137.223.204")]
    assert said(every) == [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204"), ("card", "4539578763621486"), ("card", "4716258050958645")]


def test_hidden_mentions_are_brought_back():
    """Of held-out texts a third of the pattern spans is hidden; precision and recall of what the field adds."""
    draw = random.Random(7)
    graph = pii.Graph()
    for i, text in enumerate(mentions(draw, 500)):
        graph.add(i, text, pii.base_spans(text), gold=True)
    field = pii.Field.load(pii.Field.train(graph).dump())
    hidden = right = added = 0
    for text in mentions(draw, 500):
        base = pii.base_spans(text)
        kept = [s for s in base if draw.random() > 1 / 3]
        other = pii.Graph()
        other.add(0, text, kept)
        got = field.added({0: text}, other).get(0, [])
        gone = [s for s in base if s not in kept]
        hidden, added = hidden + len(gone), added + len(got)
        right += sum(any(s[2] == q[2] and abs(s[0] - q[0]) <= 1 and abs(s[1] - q[1]) <= 1 for q in got) for s in gone)
    assert hidden > 150 and right / hidden > 0.95 and right / added > 0.95


def test_tables_of_numbers_are_left_alone():
    draw = random.Random(9)
    graph = pii.Graph()
    for i, text in enumerate(mentions(draw, 400)):
        graph.add(i, text, pii.base_spans(text), gold=True)
    field = pii.Field.load(pii.Field.train(graph).dump())
    for low, high in ((0, 50), (10**6, 10**7), (10**7, 10**8), (10**11, 10**12)):
        assert pii.find([" ".join(str(draw.randrange(low, high)) for _ in range(3000))], field)[0] == ([], [])


def test_messages_that_turn_in_circles_settle():
    """Strong potentials that disagree round a loop: steps shrink until nothing moves."""
    n = len(pii.KINDS) + 1
    swap = np.roll(np.eye(n), 1, 0) * 8
    field = pii.Field(np.zeros((pii.BUCKETS, n)), np.linspace(0, 0.5, n), swap, swap)
    graph = pii.Graph()
    graph.add(0, "1 2 1 2 1 3 3 2 1 " * 20, [])
    assert len(field.decode(graph)) == 180
