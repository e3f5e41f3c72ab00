"""Improbable-feature digests of whole texts.

Each byte of a text begins a window of WINDOW bytes. A window's rank is the rarity
of its entropy: how common that entropy is among the windows at every byte of the
whole corpus. Within every run of RUN neighbouring windows the rarest one scores a
point; windows with at least POINTS points are the text's improbable features.
They are hashed into a chain of Bloom filters of FILTER_BITS bits with at most
PER_FILTER features each. The likeness of two digests is the mean, over the
filters of the shorter, of the best overlap of bits with a filter of the other,
put so that the overlap expected by chance is 0 and the most possible is 1.

Cases: a null text is an empty one. An empty text has no filter; two empty
digests are alike (1), an empty and another one are not (0). A text shorter than
a window is one feature. Equal texts have equal digests, wherever they stand.
Ids may be of any type that has an order. Rows with a null id come last in the
order of ids; rows that repeat an id stay beside each other, in the order of a hash
of their texts, so that an id with very many rows is read by many tasks. Ties of
that hash are in the order of the texts; rows that are equal in id and text are all
in one range. An empty table gives no rows. Further columns may have any name; they
are not read.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_text
from millrace.session import ship

# Short windows, so that texts of a line or two have some features that an edit leaves as they are.
WINDOW, RUN, POINTS = 16, 16, 6
FILTER_BITS, PER_FILTER, HASHES = 2048, 160, 5
#: Classes of entropy, from 0 bits to those of a window of different bytes.
CLASSES = 512
#: Bytes whose windows are worked on at once.
STRETCH = 1 << 20
#: Filters of the shorter of two digests that are compared with the other's at once.
FILTERS_AT_ONCE = 256
#: Rows of a range of ids, about. A range is read in order by one task, a text at a time. The first id of each range goes to
#: the driver and to all tasks; beyond so many ranges they have more rows instead (at 10 ** 10 texts 100,000 each).
RANGE_ROWS, MAX_RANGES = 1000, 100_000

_SUMMANDS = np.concatenate(([0.0], np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))))
_STEPS = np.diff(_SUMMANDS)


def _classes(sums: np.ndarray) -> np.ndarray:
    """Entropy classes from the sums of c * log2(c) over the bytes of a window, c being a byte's count."""
    entropy = np.log2(WINDOW) - sums / WINDOW
    return np.clip((entropy * (CLASSES / np.log2(WINDOW)) + 1e-6).astype(np.int64), 0, CLASSES - 1)


def tile_classes(data: bytes) -> np.ndarray:
    """The entropy classes of the windows that begin at each WINDOW-th byte and lie wholly in the text."""
    n = len(data) // WINDOW
    if n > STRETCH // WINDOW:
        return np.concatenate([tile_classes(data[i : i + STRETCH]) for i in range(0, n * WINDOW, STRETCH)])
    if not n:
        return np.empty(0, np.int64)
    rows = np.sort(np.frombuffer(data, np.uint8, n * WINDOW).reshape(n, WINDOW), axis=1)
    starts = np.flatnonzero(np.column_stack((np.ones(n, bool), rows[:, 1:] != rows[:, :-1])).ravel())
    lengths = np.diff(np.append(starts, n * WINDOW))
    return _classes(np.bincount(starts // WINDOW, _SUMMANDS[lengths], n))


def window_classes(data: bytes) -> np.ndarray:
    """The entropy class of the window at each byte, stretch by stretch."""
    n = len(data) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.int16)
    return np.concatenate([_stretch_classes(data[i : i + STRETCH + WINDOW - 1]) for i in range(0, n, STRETCH)])


def _stretch_classes(data: bytes) -> np.ndarray:
    """Bytes come into the window and go with the counts that they then have in it."""
    n = len(data)
    x = np.frombuffer(data, np.uint8)
    order = np.argsort(x, kind="stable")
    key = x[order].astype(np.int64) << 40 | order
    place = np.arange(n)
    before, after = np.empty(n, np.int64), np.empty(n, np.int64)
    # Equal bytes among the WINDOW - 1 before and after each byte.
    before[order] = place - np.searchsorted(key, key - (WINDOW - 1))
    after[order] = np.searchsorted(key, key + (WINDOW - 1), "right") - place - 1
    total = np.cumsum(_STEPS[before])
    sums = total[WINDOW - 1 :].copy()
    # Whole sums at the end of each window, less what the bytes that have left took with them.
    sums[1:] -= np.cumsum(_STEPS[after[: n - WINDOW]])
    return _classes(sums).astype(np.int16)


def popular(ranks: np.ndarray) -> np.ndarray:
    """Which windows are the first of the lowest rank in at least POINTS runs of RUN neighbours."""
    n = len(ranks)
    if n <= RUN:
        chosen = np.zeros(n, bool)
        if n:
            chosen[int(ranks.argmin())] = True
        return chosen
    points = np.zeros(n, np.int32)
    for i in range(0, n - RUN + 1, STRETCH):
        some = ranks[i : i + STRETCH + RUN - 1]
        lowest = some.astype(np.int64) << 40 | np.arange(len(some))
        span = 1
        while span < RUN:
            lowest = np.minimum(lowest[:-span], lowest[span:])
            span *= 2
        points[i : i + len(some)] += np.bincount(lowest & ((1 << 40) - 1), minlength=len(some))
    chosen = points >= POINTS
    if not chosen.any():
        chosen[int(ranks.argmin())] = True
    return chosen


_hash = functools.partial(xxhash.xxh64_intdigest, seed=0)


def features(data: bytes, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's improbable features, in order."""
    if len(data) < WINDOW:
        return (np.zeros(1, np.int64), np.array([_hash(data)], np.uint64)) if data else (np.empty(0, np.int64), np.empty(0, np.uint64))
    places = np.flatnonzero(popular(rarity[window_classes(data)]))
    return places, np.fromiter((_hash(data[p : p + WINDOW]) for p in places.tolist()), np.uint64, len(places))


class Digest:
    """A chain of Bloom filters: one row of bits a filter."""

    def __init__(self, hashes: np.ndarray):
        n = -(-len(hashes) // PER_FILTER)
        bits = np.zeros((n, FILTER_BITS), bool)
        each = np.arange(len(hashes)) // PER_FILTER
        for k in range(HASHES):
            bits[each, (hashes >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = True
        self.bits = bits
        self.size = len(hashes)

    def text(self) -> str:
        """features:filters in base 64."""
        return f"{self.size}:{base64.b64encode(np.packbits(self.bits).tobytes()).decode()}"

    @classmethod
    def parse(cls, text: str) -> Digest:
        size, _, data = text.partition(":")
        own = cls(np.empty(0, np.uint64))
        own.size = int(size)
        own.bits = np.unpackbits(np.frombuffer(base64.b64decode(data), np.uint8)).astype(bool).reshape(-1, FILTER_BITS)
        return own

    def likeness(self, other: Digest) -> float:
        if not self.size or not other.size:
            return float(self.size == other.size)
        short, long = (self, other) if (len(self.bits), self.size) <= (len(other.bits), other.size) else (other, self)
        b = long.bits.astype(np.float32)
        nb, best = b.sum(1)[None, :].astype(np.float64), []
        for at in range(0, len(short.bits), FILTERS_AT_ONCE):
            a = short.bits[at : at + FILTERS_AT_ONCE].astype(np.float32)
            na = a.sum(1)[:, None].astype(np.float64)
            most = np.minimum(na, nb)
            chance = na * nb / FILTER_BITS
            normal = ((a @ b.T).astype(np.float64) - chance) / np.maximum(most - chance, 1e-9)
            best.append(np.clip(normal, 0, 1).max(1))
        return float(np.concatenate(best).mean())


def rarity_of(documents: DataFrame) -> np.ndarray:
    """The rank of each entropy class: how often it occurs among the windows at every byte of all texts."""

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            counts = np.zeros(CLASSES, np.int64)
            for t in b.column(0).to_pylist():
                counts += np.bincount(window_classes((t or "").encode("utf-8", "surrogatepass")), minlength=CLASSES)
            return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts)), pa.array(counts[counts > 0])], names=["class", "n"])

        return batch

    rows = map_text(documents.select("text"), "class long, n long", make).groupBy("class").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES, np.int64)
    for r in rows:  # at most CLASSES rows
        counts[r["class"]] = r["n"]
    return np.argsort(np.argsort(counts, kind="stable"), kind="stable")


class _Text:
    def __init__(self, text: str | None, rarity: np.ndarray):
        self.text = text or ""
        self.data = self.text.encode("utf-8", "surrogatepass")
        self.places, self.hashes = features(self.data, rarity)
        self.digest = Digest(self.hashes)


def edited(text: str, following: str) -> str:
    """The text with its last quarter (in code points) replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _orderly(value: object) -> tuple:
    """A value as Spark orders it: a number that is none is greater than all others."""
    return (1,) if isinstance(value, float) and value != value else (0, value)


def _ranged(documents: DataFrame) -> DataFrame:
    """Rows (r, tail, doc_id, text, _h): each in its range r of ids, the first of a range also as the tail of the one before.

    The very first row is the tail of the last range. Where ranges begin comes from range
    partitions of the ids, with a hash of the text, alone.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    parts = max(1, min(MAX_RANGES, -(-documents.count() // RANGE_ROWS)))
    ids = rows.select("doc_id", "_h").repartitionByRange(parts, F.col("doc_id").asc_nulls_last(), F.col("_h"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")).alias("first")
    found = ids.groupBy(F.spark_partition_id().alias("p")).agg(first).orderBy("p").select("first.*").collect()
    shared = spark.sparkContext.broadcast([(r["none"], _orderly(r["doc_id"]), r["_h"]) for r in found])

    @F.arrow_udf("struct<r: int, to: int>")
    def place(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        firsts = shared.value
        keys = [(i is None, _orderly(i), h) for i, h in zip(ids.to_pylist(), hashes.to_pylist(), strict=True)]
        at = [bisect.bisect_right(firsts, k) - 1 for k in keys]
        to = [(r - 1) % len(firsts) if firsts[r] == k else None for r, k in zip(at, keys, strict=True)]
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(to, pa.int32())], names=["r", "to"])

    placed = rows.withColumn("_p", place("doc_id", "_h"))
    own = F.struct(F.col("_p.r").alias("r"), F.lit(False).alias("tail"))
    also = F.struct(F.col("_p.to").alias("r"), F.lit(True).alias("tail"))
    to = F.explode(F.when(F.col("_p.to").isNotNull(), F.array(own, also)).otherwise(F.array(own)))
    sent = placed.withColumn("_to", to).select(F.col("_to.r").alias("r"), F.col("_to.tail").alias("tail"), "doc_id", "text", "_h")
    return sent.repartition(max(1, len(found)), "r").sortWithinPartitions(
        "r", "tail", F.col("doc_id").asc_nulls_last(), "_h", F.col("text").asc_nulls_first()
    )


def fingerprints(documents: DataFrame) -> DataFrame:
    """Digests of every document (doc_id, text), of its edited text, and their likenesses.

    Ids are cut into ranges; each range is read in order by one task, with the first
    document of the next range at its end, so each text is shuffled once.
    """
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(rarity_of(documents))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        waiting: tuple[int, object, _Text] | None = None
        done = None  # the range whose tail has come
        rows: list[tuple] = []

        def emit(ids: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [ids, *kinds], strict=True)], names=names)

        for b in batches:
            for r, tail, doc_id, text in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True):
                if tail and done == r:
                    continue
                here = _Text(text, rarity)
                if waiting is not None and waiting[0] == r:
                    rows.append(_row(waiting[1], waiting[2], here, rarity))
                waiting = None if tail else (r, doc_id, here)
                done = r if tail else None
            yield emit(b.column(2).type)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_features"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    return _ranged(documents).mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, n_features long",
    )


def _row(doc_id: object, own: _Text, following: _Text, rarity: np.ndarray) -> tuple:
    changed = _Text(edited(own.text, following.text), rarity)
    return (
        doc_id, len(own.text), hashlib.sha256(changed.data).hexdigest(), own.digest.text(), changed.digest.text(),
        own.digest.likeness(changed.digest), own.digest.likeness(following.digest), own.digest.size,
    )
