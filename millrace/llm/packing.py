"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A bin is filled greedily with the longest pieces that still fit. Then its smallest
piece is taken out again if two unpacked pieces together fill the room that this
leaves more tightly. Since pieces of one length are alike to the packer, it works on
the number of pieces of each length, of which there are at most `capacity`: it
makes a list of patterns (how many pieces of which lengths share a bin) with the
number of bins of each, on the driver and in bounded memory. Every piece has a rank
among those of its length, and the pattern list says which bin and place a rank has,
so no text or token is shuffled and no bin is built in one place.

Cases: a null or empty text is a document of the closing token alone. A document
longer than a sequence is cut; all its pieces but the first have full length. Rows
that repeat an id are separate documents. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import itertools
import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from millrace.llm.common import byte_symbols, map_text
from millrace.session import staged

CAPACITY = 1024
CLOSING = 2
#: Fixed value: the pattern by which byte-level vocabularies of this family split a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Ids:
    """Token ids of a tokenizer file, without special tokens added.

    Where the vocabulary is numbered in the order of its merges, texts in the first
    256 code points are encoded by a faster library with the same vocabulary and split;
    all other texts, on whose character classes the libraries might differ, by the first.
    """

    def __init__(self, definition: str):
        self.first = Tokenizer.from_str(definition)
        self.first.no_truncation()
        self.first.no_padding()
        self.fast = self._fast(json.loads(definition))

    @staticmethod
    def _fast(parsed: dict) -> tiktoken.Encoding | None:
        model, split, symbols = parsed["model"], parsed["pre_tokenizer"], byte_symbols()
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        alike = (
            parsed["normalizer"] is None and split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            and all(model["vocab"][m] == 256 + i for i, m in enumerate(merges)) and len(model["vocab"]) == 256 + len(merges)
        )
        if not alike:
            return None
        ranks = {bytes(symbols[c] for c in token): i for token, i in model["vocab"].items()}
        special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        return tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), "<u4")
        return np.array(self.first.encode(text, add_special_tokens=False).ids, "<u4")


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing: int = CLOSING) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of documents (doc_id, text)."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        ids_of = Ids(shared.value)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            row, number, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(ids_of(text or ""), np.uint32(closing)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (at, to) in enumerate(itertools.pairwise(cuts)):
                    row.append(i)
                    number.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[at:to].tobytes()))
            return pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

        return batch

    return map_text(documents.select("doc_id", "text"), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", make)


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Best-two-fit over counts of lengths: (how many pieces of each length a bin has, how many such bins)."""
    left = {n: c for n, c in counts.items() if c > 0}
    found = []
    while left:
        lengths = sorted(left)
        bin_: Counter[int] = Counter()
        room = capacity
        at = len(lengths)
        # Greedily, the longest first.
        while (at := bisect.bisect_right(lengths, room, 0, at) - 1) >= 0:
            n = lengths[at]
            take = min(room // n, left[n])
            bin_[n] += take
            room -= take * n
        # The smallest piece out, two unpacked ones in, if they leave less room.
        if room:
            smallest = min(bin_)
            if pair := _best_pair(lengths, {n: left[n] - bin_[n] for n in lengths}, room + smallest, smallest):
                bin_[smallest] -= 1
                bin_.update(pair)
                bin_ = +bin_
        times = min(left[n] // c for n, c in bin_.items())
        for n, c in bin_.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        found.append((dict(sorted(bin_.items(), reverse=True)), times))
    return found


def _best_pair(lengths: list[int], free: dict[int, int], room: int, over: int) -> tuple[int, int] | None:
    """The two free pieces with the largest sum that is at most `room` and more than `over`."""
    open_ = [n for n in lengths if free[n] > 0 and n < room]
    best, pair = over, None
    for i in range(len(open_) - 1, -1, -1):
        a = open_[i]
        if 2 * a <= best:
            break
        j = bisect.bisect_right(open_, min(room - a, a)) - 1
        if j >= 0 and open_[j] == a and free[a] < 2:
            j -= 1
        if j >= 0 and a + open_[j] > best:
            best, pair = a + open_[j], (a, open_[j])
            if best == room:
                break
    return pair


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ids_crc32 and others)."""
    columns = cut.columns
    # Written once with the part in which each row stands; ranks count through the parts.
    placed = staged(cut.withColumn("_part", F.spark_partition_id()), "pieces")
    counts = placed.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity`
    rows, used, sequence = [], Counter(), 0
    for bin_, times in patterns(lengths, capacity):
        offset = 0
        for length, each in bin_.items():
            rows.append((length, used[length], used[length] + each * times, each, sequence, offset))
            used[length] += each * times
            offset += length * each
        sequence += times
    plan = cut.sparkSession.createDataFrame(rows, "_length long, _from long, _to long, _each long, _sequence long, _offset long")
    here = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = placed.withColumn("_row", F.row_number().over(here)).join(starts, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    # The plan has a row for each length of each pattern, whatever the number of documents.
    met = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    within = F.col("_rank") - F.col("_from")
    return met.select(
        *columns,
        (F.col("_sequence") + F.floor(within / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (within % F.col("_each")) * F.col("length")).alias("offset"),
    )
