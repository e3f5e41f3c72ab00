"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams in rank
order. A document's own list is compared with each profile by the out-of-place
distance: the sum, over the document's n-grams, of how far each stands from its
place in the profile, with the profile's length for those that it lacks.

Cases: a text that is null, empty or without any letter is `und` with score 0.
Every other text gets the nearest profile, ties to the language that sorts first;
without any profile (nothing to learn from) it is `und` with score 0. Repeated
rows each get their own result. Texts are read whole, however long.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import held_out, map_text, place_of

#: n-grams of 1 to 3 letters, with a space for the edge of a word.
ORDERS = (1, 2, 3)
#: Length of a language's profile and of a document's list.
PROFILE, LISTED = 400, 300
#: About so many labelled documents of each language are read to make its profile.
SAMPLE_PER_LANGUAGE = 3000
#: More languages than this are refused: profiles are held by every task.
MAX_LANGUAGES = 1000
#: How sharply the score falls with distance (distances are divided by their maximum).
SHARPNESS = 25.0
#: Characters of a text whose n-grams are held at once.
PIECE = 1 << 19
#: n-grams that a task holds before it counts them.
COUNTED_AT_ONCE = 2_000_000
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> np.ndarray:
    """All n-grams of a text as integers, repeats included; empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.uint64)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    padded = np.concatenate(([32], codes, [32])).astype(np.uint64)
    space = padded == 32
    kept = np.ones(len(padded), bool)
    kept[1:] = ~(space[1:] & space[:-1])
    padded, space = padded[kept], space[kept]
    two = padded[:-1] << np.uint64(21) | padded[1:]
    three = (two[:-1] << np.uint64(21) | padded[2:])[~space[1:-1]]
    return np.concatenate((padded[~space], two, three))


def pieces(text: str | None) -> Iterator[str]:
    """A text in pieces of about PIECE characters, cut at characters that are no letters: no n-gram is cut."""
    text, at = text or "", 0
    while at < len(text):
        to = min(len(text), at + PIECE)
        while to < len(text) and text[to].isalpha():
            to += 1
        yield text[at:to]
        at = to


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in ascending order, and how often each occurs."""
    grams = np.sort(grams)
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[first], np.diff(np.append(first, len(grams)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of parts, added up."""
    if len(parts) == 1:
        return parts[0]
    distinct, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate([n for _, n in parts]), len(distinct)).astype(np.int64)


def listed(text: str | None, length: int = LISTED) -> np.ndarray:
    """The most frequent n-grams of a text, the most frequent first; equally frequent ones by value."""
    parts = [counted(grams) for piece in pieces(text) if len(grams := ngrams(piece))]
    if not parts:
        return np.empty(0, np.uint64)
    distinct, counts = merged(parts)
    if len(distinct) > length:
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        distinct, counts = distinct[counts >= least], counts[counts >= least]
    return distinct[np.argsort(-counts, kind="stable")][:length]


class Profiles:
    """Rank-order profiles of some languages."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.languages = sorted(ranked)
        self.grams = np.unique(np.array([g for r in ranked.values() for g in r], np.uint64))
        self.absent = max((len(r) for r in ranked.values()), default=0)
        self.ranks = np.full((len(self.languages), len(self.grams)), -1, np.int64)
        for row, language in enumerate(self.languages):
            at = np.searchsorted(self.grams, np.array(ranked[language], np.uint64))
            self.ranks[row, at] = np.arange(len(ranked[language]))

    def distances(self, text: str | None) -> np.ndarray | None:
        """The out-of-place distance to each language over its maximum; None without letters or profiles."""
        own = listed(text)
        if not len(own) or not self.languages:
            return None
        place = np.arange(len(own))
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = np.where(self.grams[at] == own, self.ranks[:, at], -1)
        out = np.where(ranks < 0, self.absent, np.minimum(np.abs(ranks - place), self.absent))
        return out.sum(1) / (self.absent * len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and, as score, its share of the weights exp(-SHARPNESS * distance)."""
        distances = self.distances(text)
        if distances is None:
            return UNKNOWN, 0.0
        weights = np.exp(SHARPNESS * (distances.min() - distances))
        return self.languages[int(distances.argmin())], float(1 / weights.sum())


def fit(documents: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, profile: int = PROFILE) -> Profiles:
    """Learns the profiles from the documents (doc_id, text, lang) that are not held out.

    Of each language about `sample` documents are read, drawn by a hash of their
    ids (all, where there are no more). Their n-grams are counted in the tasks and
    summed by language and n-gram, so that neither texts nor counts of documents
    meet in one place; the driver gets `profile` n-grams a language.
    """
    known = documents.where(~held_out() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Profiles({})
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(drawn < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            languages, grams, counts = [], [], []
            waiting: dict[str, list[np.ndarray]] = {}

            def flush() -> None:
                for language, parts in waiting.items():
                    if len(together := np.concatenate(parts)):
                        distinct, n = counted(together)
                        languages.extend([language] * len(n))
                        grams.append(distinct.astype(np.int64))
                        counts.append(n.astype(np.int64))
                waiting.clear()

            held = 0
            for language, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for piece in pieces(text):
                    waiting.setdefault(language, []).append(found := ngrams(piece))
                    held += len(found)
                    if held > COUNTED_AT_ONCE:
                        flush()
                        held = 0
            flush()
            none = np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(languages, pa.string()), pa.array(np.concatenate([none, *grams])), pa.array(np.concatenate([none, *counts]))],
                names=["lang", "gram", "n"],
            )

        return batch

    summed = map_text(chosen, "lang string, gram long, n long", count).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Two steps, so that no task gets all n-grams of a language.
    some = Window.partitionBy("lang", F.pmod(F.hash("gram"), F.lit(64))).orderBy(F.desc("n"), "gram")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (
        summed.withColumn("r", F.row_number().over(some)).where(F.col("r") <= profile)
        .withColumn("r", F.row_number().over(whole)).where(F.col("r") <= profile)
    )
    ranked: dict[str, list[tuple[int, int]]] = {k: [] for k in sizes}
    for row in top.select("lang", "gram", "r").collect():
        ranked[row["lang"]].append((row["r"], row["gram"]))
    return Profiles({k: [g for _, g in sorted(v)] for k, v in ranked.items() if v})


def identify(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document (doc_id, text), without a shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(profiles)

    def predict():
        known = shared.value

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [known.predict(t) for t in b.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

        return batch

    read = documents.select("doc_id", held_out().alias("held_out"), "text")
    kind = read.schema["doc_id"].dataType.simpleString()
    return map_text(read, f"doc_id {kind}, held_out boolean, lang_pred string, score double", predict)


def keep_identified(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """The documents, with all their columns, that have a language: those of `und` are rejected."""
    shared = documents.sparkSession.sparkContext.broadcast(profiles)
    place = place_of(documents, "text")

    def choose():
        known = shared.value

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(place).to_pylist()
            return b.filter(pa.array([known.predict(t)[0] != UNKNOWN for t in texts], pa.bool_()))

        return batch

    return map_text(documents, documents.schema, choose)
