"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents are used as labelled examples; the other class is
never taken as labelled. With the class prior p, the risk of a classifier is
p * R(positive as 1) + max(0, R(unlabelled as 0) - p * R(positive as 0)): the
second part estimates the risk on the negatives and is kept from going below 0,
where a flexible model would overfit. Several numpy classifiers, each trained in
its own task on all positive examples and another part of the unlabelled ones,
vote by their mean logit.

Features are words and their beginnings (3 to 6 letters). A feature's value in a
text is the number of distinct words that have it over the square root of the
number of distinct words, so that chance finds in long texts weigh little. A
classifier keeps the features that more positive texts have than chance explains.

Cases: a null or empty text has no features and gets the score of the bias.
Without any positive example, or without documents to learn from, every score is
0. Labels that are null count as not given; a document labelled twice counts
twice. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import held_out, map_text, place_of
from millrace.session import ship

#: Bounds of the sample that the classifiers are trained on; scoring reads everything.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 12000
#: Characters of a text, and of all texts of a kind together, beyond which no text is drawn.
LONGEST, CHARACTERS = 200_000, 60_000_000
CLASSIFIERS = 3
PREFIXES = (3, 4, 5, 6)
MAX_FEATURES = 4096
#: What a feature needs to be kept; see choose_features().
LIFT, CHANCE, MIN_SHARE = 2.0, 1e-5, 0.005
ROUNDS, RATE, PENALTY = 400, 0.1, 2e-5
#: Only puts the values near 1, where the first steps of training are.
SCALE = 5.0
#: Counters of the sieve for frequent features.
SIEVE = 1 << 22
#: Words whose features a task remembers before it forgets them all.
REMEMBERED = 300_000

_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    """A word and its beginnings; a mark keeps a beginning apart from a short word."""
    return [word, *[word[:n] + "~" for n in PREFIXES if len(word) > n]]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(text: str | None) -> dict[str, float]:
    """The values of a text's features, in a set order, so that sums over them are the same in every process."""
    found = sorted(words(text))
    counts = Counter(f for w in found for f in word_features(w))
    scale = SCALE / math.sqrt(max(1, len(found)))
    return {f: n * scale for f, n in counts.items()}


def _log_tail(n: int, mean: float) -> float:
    """The logarithm of an upper bound of the chance that a Poisson count reaches n (Chernoff's bound)."""
    return 0.0 if n <= mean else n - mean - n * math.log(n / mean)


def frequent(texts: list[str], least: float) -> Counter:
    """In how many texts each feature is, for those that are in at least `least`.

    A sieve of counts by hash goes first, so that the many rare features are never held.
    """
    sieve = np.zeros(SIEVE, np.int32)
    for t in texts:
        found = np.fromiter({hash(f) % SIEVE for f in features(t)}, np.int64)
        sieve[found] += 1
    passed = set(np.flatnonzero(sieve >= least).tolist())
    counts = Counter(f for t in texts for f in features(t) if hash(f) % SIEVE in passed)
    return Counter({f: n for f, n in counts.items() if n >= least})


def choose_features(positive: list[str], unlabelled: list[str]) -> list[str]:
    """The features that more positives have than their rate among the unlabelled explains, the surest first.

    A feature needs LIFT times that rate, a count that this rate would reach with a
    chance under CHANCE, and MIN_SHARE of the positives (3 at least).
    """
    own = frequent(positive, max(3, MIN_SHARE * len(positive)))
    all_ = Counter(f for t in unlabelled for f in features(t) if f in own)
    scored = []
    for f, n in own.items():
        expected = len(positive) * (all_[f] + 1) / (len(unlabelled) + 1)
        if n > LIFT * expected and (tail := _log_tail(n, expected)) < math.log(CHANCE):
            scored.append((tail, f))
    return [f for _, f in sorted(scored)[:MAX_FEATURES]]


def _matrix(texts: list[str], place: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cells = [(row, place[f], x) for row, t in enumerate(texts) for f, x in features(t).items() if f in place]
    rows, columns, values = zip(*cells, strict=True) if cells else ((), (), ())
    return np.array(rows, np.int64), np.array(columns, np.int64), np.array(values, np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(positive: Iterable[str | None], unlabelled: Iterable[str | None], prior: float) -> tuple[dict[str, float], float]:
    """Weights and bias of one logistic classifier that minimises the non-negative risk, by Adam; copies count once."""
    p, u = ([t or "" for t in dict.fromkeys(x)] for x in (positive, unlabelled))
    chosen = choose_features(p, u)
    place = {f: i for i, f in enumerate(chosen)}
    parts = [(*_matrix(x, place), len(x)) for x in (p, u)]
    w, b = np.zeros(len(chosen) + 1), math.log(prior / (1 - prior))
    w[-1] = b
    first, second = np.zeros_like(w), np.zeros_like(w)

    def forward(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, w[columns] * values, n) + w[-1]

    def backward(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int, slope: np.ndarray) -> np.ndarray:
        g = np.zeros_like(w)
        g[:-1] = np.bincount(columns, slope[rows] * values, len(chosen))
        g[-1] = slope.sum()
        return g

    for step in range(1, ROUNDS + 1):
        (zp, zu) = (forward(*x) for x in parts)
        as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        positive_part = backward(*parts[0], -prior * _sigmoid(-zp) / max(1, len(zp)))
        negative_part = backward(*parts[1], _sigmoid(zu) / max(1, len(zu))) - backward(*parts[0], prior * _sigmoid(zp) / max(1, len(zp)))
        # Where the estimated risk on negatives falls below 0, its step is taken backwards.
        g = positive_part + negative_part if as_negative >= 0 else -negative_part
        g[:-1] += PENALTY * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return dict(zip(chosen, w[:-1].tolist(), strict=True)), float(w[-1])


class Scorer:
    """The mean of some classifiers' logits, as a probability."""

    def __init__(self, weights: dict[str, float], bias: float | None):
        self.weights, self.bias = weights, bias
        self._of: dict[str, float] = {}

    def _weight(self, word: str) -> float:
        if len(self._of) >= REMEMBERED:
            self._of.clear()
        found = self._of[word] = math.fsum(self.weights.get(f, 0.0) for f in word_features(word))
        return found

    def score(self, text: str | None) -> float:
        if self.bias is None:
            return 0.0
        of, found = self._of, words(text)
        each = [of[w] if w in of else self._weight(w) for w in found]
        z = self.bias + SCALE / math.sqrt(max(1, len(found))) * math.fsum(each)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _drawn(rows: DataFrame, most: int) -> DataFrame:
    """Up to `most` different texts of rows (doc_id, text, key), in the order of a hash of their keys, each once, within the bounds in characters.

    Keys and lengths are chosen first, so of a row that is there very often no task gets more than one text from another.
    """
    length = F.length(F.coalesce("text", F.lit("")))
    keys = rows.where(length <= LONGEST).groupBy("key").agg(F.min(length).alias("n")).orderBy(F.xxhash64("key", F.lit("draw")), "key").limit(most).collect()
    chosen, left = [], CHARACTERS
    for r in keys:
        left -= r["n"]
        if left < 0:
            break
        chosen.append((r["key"],))
    picked = rows.sparkSession.createDataFrame(chosen, "key long")
    return rows.join(F.broadcast(picked), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))


def fit(documents: DataFrame, labels: DataFrame, positives: int = MAX_POSITIVE, unlabelled: int = MAX_UNLABELLED) -> Scorer:
    """Learns from the documents (doc_id, text) and labels (doc_id, toxic) whose ids are not held out.

    The prior is the share of toxic rows among the labelled ones. Up to `positives`
    toxic ids are drawn by a hash, and up to as many of their different texts; up to
    `unlabelled` texts are drawn from all documents, whatever their labels. Texts of more
    than LONGEST characters are not drawn, nor more than CHARACTERS characters of either kind.
    """
    known = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    seen = known.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("double")).alias("t")).first()
    learn = documents.where(~held_out()).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    total = learn.count()
    if not seen["n"] or not seen["t"] or not total:
        return Scorer({}, None)
    prior = min(0.99, max(1e-4, seen["t"] / seen["n"]))
    ids = known.where(F.col("toxic") == 1).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
    every = F.explode(F.array(*[F.lit(k) for k in range(CLASSIFIERS)])).alias("part")
    positive = _drawn(learn.join(F.broadcast(ids), "doc_id", "left_semi"), positives).select("text", F.lit(1).alias("positive"), every)
    some = F.pmod(F.col("key"), F.lit(1 << 30)) < int(min(1.0, 2 * unlabelled / total) * (1 << 30))  # about twice as many, so that few are ordered
    others = _drawn(learn.where(some), unlabelled).select(
        "text", F.lit(0).alias("positive"), F.pmod(F.xxhash64("key", F.lit("part")), F.lit(CLASSIFIERS)).cast("int").alias("part")
    )
    ship(documents.sparkSession)

    def classify(frame: pd.DataFrame) -> pd.DataFrame:
        # In a set order, so that a task that is run again learns the same.
        frame = frame.assign(text=frame["text"].fillna("")).sort_values(["positive", "text"])
        toxic = frame["positive"] == 1
        weights, bias = train(frame["text"][toxic], frame["text"][~toxic], prior)
        return pd.DataFrame({"feature": [*weights, None], "weight": [*weights.values(), bias]})

    learned = positive.unionByName(others).groupBy("part").applyInPandas(classify, "feature string, weight double")
    each: dict[str | None, list[float]] = {}
    for r in learned.collect():  # at most CLASSIFIERS * (MAX_FEATURES + 1) rows
        each.setdefault(r["feature"], []).append(r["weight"])
    mean = {f: math.fsum(w) / CLASSIFIERS for f, w in each.items()}
    bias = mean.pop(None, None)
    return Scorer(mean, bias)


def score(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score and predicted of every document (doc_id, text), without a shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias))

    def make():
        known = Scorer(*shared.value)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [known.score(t) for t in b.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(found, pa.float64()), pa.array([int(x >= 0.5) for x in found], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

        return batch

    read = documents.select("doc_id", held_out().alias("held_out"), "text")
    kind = read.schema["doc_id"].dataType.simpleString()
    return map_text(read, f"doc_id {kind}, held_out boolean, score double, predicted int", make)


def keep_clean(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """The documents, with all their columns, that score under 0.5."""
    shared = documents.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias))
    place = place_of(documents, "text")

    def make():
        known = Scorer(*shared.value)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(place).to_pylist()
            return b.filter(pa.array([known.score(t) < 0.5 for t in texts], pa.bool_()))

        return batch

    return map_text(documents, documents.schema, make)
