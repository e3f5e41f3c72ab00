"""Periodic runs of words: stretches that repeat themselves, found by longest previous factors.

Each text is a sequence of words (maximal stretches of bytes other than the blanks
0x20 and 0x09 to 0x0D). Within a task, a few texts at a time:

1. Names by doubling: at level k, two places have the same name if the 2**k words from
   there are equal. The last level is the suffix array; the levels together tell how far
   two places agree, forwards or backwards, in as many steps as there are levels.
2. The suffix array and the lengths that neighbours in it share give, for each place, the
   longest stretch that also begins earlier, and where. Cutting at those gives LZ blocks.
3. Main's extensions: a run that touches the start of a block (or the end of the text)
   has a period of at most the lengths of the two blocks there; for each such period, how
   far the words agree to both sides gives the run. With an exponent of at least e wanted,
   periods up to 1 / (e - 1) of that are enough.
4. A run strictly inside a block is a copy of one inside the block's earlier occurrence.
   Runs lie in buckets by their start, and blocks are gone through in order, so all
   sources are known when a block copies them.

Texts of one batch share the arrays, never a name. Time and memory follow the number of
words times its logarithm; a text is never cut.

Cases: a null or empty text, or one of blanks, has 0 words, no runs, and collapses to the
empty text. Rows that repeat an id, or have none, are separate rows. Runs are in order of
start, then period, and depend on the text alone. Of the input only the id and the text
are read, so further columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_text

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Texts are taken together until they have so many words.
WORDS_AT_ONCE = 1 << 16

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Names:
    """Names of the stretches of 2**k words from each place, for texts side by side.

    `codes` are numbers from 0 for words, different in different texts and rising from
    text to text; `ends` has the end of its text for each place.
    """

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        n = len(codes)
        counts = np.bincount(codes)
        rank = (np.cumsum(counts) - counts)[codes]  # a name is the place of its first suffix in the order of all
        self.levels = [np.append(rank, -1)]
        open_ = np.flatnonzero(counts[codes] > 1)
        step = 1
        while len(open_):
            then = open_ + step
            second = np.where(then < ends[open_], rank[np.minimum(then, n - 1)] + 1, 0)
            key = rank[open_] * (n + 1) + second
            order = np.argsort(key)
            open_, key = open_[order], key[order]
            old = rank[open_]
            at = np.arange(len(open_))
            firsts = lambda new: np.maximum.accumulate(np.where(np.append(True, new), at, 0))
            own = firsts(key[1:] != key[:-1])
            rank = rank.copy()
            rank[open_] = old + own - firsts(old[1:] != old[:-1])
            self.levels.append(np.append(rank, -1))
            alone = np.bincount(own, minlength=len(own))[own] == 1
            open_ = open_[~alone]
            step *= 2
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from places i and from later places j of the same texts are equal."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            same += (level[i + same] == level[j + same]).astype(np.int64) << k
        return same

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words that end at places i (from -1) and at later places j of the same texts are equal."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, from_i, from_j = self.levels[k], i - same - (1 << k) + 1, j - same - (1 << k) + 1
            same += ((from_i >= 0) & (level[np.maximum(from_i, 0)] == level[np.maximum(from_j, 0)])).astype(np.int64) << k
        return same


def previous_factors(names: Names) -> tuple[list[int], list[int]]:
    """For each place, the length of the longest stretch that also begins at an earlier one, and such a place.

    From the last place to the first: of the suffixes that are left, all begin earlier, and the
    neighbours in the suffix array share most. Then the suffix is taken out of the array.
    """
    order, n = names.order, len(names.order)
    shared = np.zeros(n + 1, np.int64)  # by each suffix with the one before it in the array
    alike = np.flatnonzero(names.levels[0][order[1:]] == names.levels[0][order[:-1]]) + 1
    a, b = order[alike - 1], order[alike]
    shared[alike] = names.forwards(np.minimum(a, b), np.maximum(a, b))
    place = names.levels[-1][:-1]
    some = (shared[:-1] > 0) | (shared[1:] > 0)
    todo = place[np.flatnonzero(some[place])][::-1].tolist()
    shared, at = shared.tolist(), order.tolist()
    before, after = list(range(-1, n)), list(range(1, n + 2))
    length, source = [0] * n, [0] * n
    for r in todo:
        b, a = before[r], after[r]
        left, right = shared[r], shared[a]
        if left >= right:
            length[at[r]], source[at[r]] = left, at[b]
            shared[a] = right
        else:
            length[at[r]], source[at[r]] = right, at[a]
            shared[a] = left
        after[b] = a
        before[a] = b
    return length, source


def _ranges(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of an entry of `most`, number from 1 to that entry), for all."""
    most = np.maximum(most, 0)
    which = np.repeat(np.arange(len(most)), most)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(most) - most, most) + 1


def find(texts: list[np.ndarray], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, in order of start, then period.

    A text is an array of numbers for words; numbers of different texts are different and
    rise from text to text without gaps. Runs have at least `min_length` words and
    `min_exponent` (2 or more) times their smallest period.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return found
    text_ends = np.cumsum(sizes)
    codes = np.concatenate(texts)
    names = Names(codes, np.repeat(text_ends, sizes))
    if len(names.levels) == 1:  # no word comes twice
        return found
    length, source = previous_factors(names)

    # Blocks: where each starts, and as a last one of length 0 the end of its text.
    cuts, first_of = [], []
    for start, end in zip((text_ends - sizes).tolist(), text_ends.tolist(), strict=True):
        first_of.append(len(cuts))
        i = start
        while i < end:
            cuts.append(i)
            i += length[i] or 1
        cuts.append(end)
    first_of.append(len(cuts))
    b = np.array(cuts, np.int64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(first_of))
    starts = (text_ends - sizes)[text_of]
    own = np.append(b[1:] - b[:-1], 0)
    own[np.array(first_of[1:]) - 1] = 0
    last = np.append(0, own[:-1])
    last[np.array(first_of[:-1])] = 0

    # Main's extensions, with periods to the left and to the right of each cut.
    e = min_exponent - 1
    level = 1 if e >= 3 else 0  # so many words, 2**level, must be equal on one side at least
    name, back = names.levels[level], 1 << level
    hits = []
    for most, left in ((np.minimum((last + own - (own > 0)) // e, b - starts), True), (own // e, False)):
        which, p = _ranges(most)
        here = b[which]
        low, high = (here - p, here) if left else (here, here + p)
        near = (name[low] == name[high]) | ((low >= back) & (name[np.maximum(low - back, 0)] == name[np.maximum(high - back, 0)]))
        which, p, low, high = which[near], p[near], low[near], high[near]
        ahead, behind = names.forwards(low, high), names.backwards(low - 1, high - 1)
        size = p + ahead + behind
        keep = size >= np.maximum(min_exponent * p, min_length)
        hits.append(np.stack([text_of[which], low - behind - starts[which], size, p], 1)[keep])
    hit = np.concatenate(hits)
    if not len(hit):
        return found
    hit = hit[np.lexsort(hit.T[::-1])]
    hit = hit[np.append(True, (hit[1:, :3] != hit[:-1, :3]).any(1))]  # of one stretch, the smallest period
    touching: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for t, start, size, p in hit.tolist():
        touching[t].append((start, size, p))
    for t, runs in touching.items():
        found[t] = _with_copies(runs, cuts[first_of[t] : first_of[t + 1]], length, source, min_length)
    return found


def _with_copies(runs: list[tuple[int, int, int]], cuts: list[int], length: list[int], source: list[int], least: int) -> list[tuple[int, int, int]]:
    """Adds the runs strictly inside of a block, copied from its earlier occurrence, in the order of blocks."""
    zero = cuts[0]
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for start, size, p in runs:
        buckets[start].append((size, p))
    starts = sorted(buckets)
    for cut in cuts[:-1]:
        if length[cut] < least + 2:
            continue
        at, shift = source[cut] - zero, cut - source[cut]
        end = at + length[cut]
        i = bisect_left(starts, at + 1)
        while i < len(starts) and starts[i] < end:  # the list grows while it is read where a block overlaps its source
            start = starts[i]
            copies = [(size, p) for size, p in buckets[start] if start + size < end]
            if copies:
                if start + shift not in buckets:
                    insort(starts, start + shift)
                bucket = buckets[start + shift]
                bucket += [c for c in copies if c not in bucket]
            i += 1
    return sorted((start, size, p) for start, bucket in buckets.items() for size, p in bucket)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if each run keeps only its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, size, p in runs:
        edges[start + p] += 1
        edges[start + size] -= 1
    return np.cumsum(edges[:-1]) == 0


def detect(documents: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Of documents (doc_id, text): doc_id, n_words, runs (start, length, period by words), and the collapsed text.

    In the collapsed text each run keeps its first period; the words that stay are joined by one space.
    """
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            n_words, runs, collapsed = [], [], []
            words: list[list[bytes]] = []
            texts: list[np.ndarray] = []
            fresh = count()

            def settle() -> None:
                nonlocal words, texts, fresh
                for own, got in zip(words, find(texts, min_length, min_exponent), strict=True):
                    n_words.append(len(own))
                    runs.append(got)
                    stay = own if not got else [own[i] for i in np.flatnonzero(kept_words(len(own), got)).tolist()]
                    collapsed.append(b" ".join(stay))
                words, texts, fresh = [], [], count()

            held = 0
            for text in b.column(1).cast(pa.binary()):
                own = (text.as_py() or b"").split()
                number = defaultdict(fresh.__next__)
                words.append(own)
                texts.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
                held += len(own)
                if held >= WORDS_AT_ONCE:
                    settle()
                    held = 0
            settle()
            flat = [r for got in runs for r in got]
            offsets = np.cumsum([0, *map(len, runs)])
            columns = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_RUN)))
            return pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), made, pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

        return batch

    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_text(documents.select("doc_id", "text"), schema, make)


def repeating(documents: DataFrame) -> DataFrame:
    """doc_id and text of documents, with a repetition put into the texts of about every tenth id.

    With h the crc32 of the id in decimal and g = h div 10: where h leaves 0 by 10 and the text
    has n > 0 words, each word i from a = g % n on becomes word a + (i - a) % p, with
    p = 1 + (n - a) div (3 + g % 8). Texts of rows without an id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.col("text"), "[\\x20\\x09-\\x0D]+"), "")
    chosen = documents.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_words"))
    n, g = F.size("_words"), F.expr("_h div 10")
    a = (g % n).cast("int")
    copies = (F.lit(3) + g % 8).cast("int")
    p = (F.lit(1) + F.floor((n - a) / copies)).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_words", a + 1, p), copies)), F.lit(1), n - a)
    return chosen.select(
        "doc_id", F.when((F.col("_h") % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice("_words", F.lit(1), a), tail), " ")).otherwise(F.col("text")).alias("text")
    )


def longest(runs: Column) -> Column:
    """The run with the greatest length, of those with the smallest start, then period: a struct, or null without any."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def digests(found: DataFrame) -> DataFrame:
    """Of what detect() gives: the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = found.withColumn("_best", longest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
