"""Near-duplicates by SimHash and multi-index hashing.

A fingerprint has a bit for each bit of a 64-bit hash: 1 where more than half of
the text's shingles have it set. Texts are linked whose fingerprints differ in at
most 3 bits, and the connected components of those links are the groups.

Two fingerprints that differ in at most 3 bits differ in at most 1 bit of one of
their halves. So there is a table for each half; the fingerprints are looked up in
it with every value of a small ball (the half itself and each value that differs
in one bit), and what is found is verified by the complete distance. The balls
are dealt out: a row goes to the groups of the upper bits of its half, and of each
value that differs from them in one bit; what differs in the lower bits is
enumerated there. The number of upper bits follows that of fingerprints, so that
groups have about GROUP of their own at every size. Only distinct fingerprints take
part, so copies cost nothing, and a task gives the edges of a spanning forest of
what it links, never all pairs.

keep_first() links texts whose sets of five-word shingles have 0.8 or more of their
union in common. Their fingerprints are wider: as many segments as it takes for such a
pair to be within one bit of each other in one of them (Layout). Balls of radius 1 are
looked up segment by segment, among sets of about the same size; what is found is
verified by the complete distance and then by the sets themselves. In a first
round each text comes with the nearest and the smallest of what it looks at; a second
one finds all pairs that are left between different components, and verifies them where
the sets of both are at hand: blocks of similar sets meet two by two, and only edges that
connect components come out.

Cases: null and empty texts, and those of white space only, have the fingerprint
zero, which is linked like any other. A null id cannot be a component's smallest;
a component of null ids only has a null component_id. Repeated rows get the same
result each. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import MAX_HOT_KEYS, join_unique, map_text
from millrace.session import drop_staged, ship, staged

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Fingerprints with the same upper bits of a half, about; at least so many upper bits.
GROUP, LEAST_PREFIX = 4096, 8
#: Pairs that a task verifies at once.
PAIRS_AT_ONCE = 200_000
#: Entries of one value beyond which they are looked up by two parts of five of their other half too (all masks of such two),
#: and rows of a group beyond which it is dealt out by them.
BUCKET, HOT_GROUP = 256, 1 << 19
_PARTS = (0x7F, 0x7F << 7, 0x3F << 14, 0x3F << 20, 0x3F << 26)
_MASKS = [a | b for a, b in combinations(_PARTS, 2)]

#: Edges that a task reduces to a forest.
EDGES_A_TASK = 1_000_000

#: Words of a shingle, and what part of their union similar sets have in common, in keep_first().
NEAR_SHINGLE, SIMILAR_OF = 5, (4, 5)
#: What part of the bits differs between the fingerprints of sets that are just similar (acos(8 / 9) / pi is 0.152;
#: it is more for small sets), what part of such pairs no segment may find, and beyond what part no pair is similar.
BIT_APART, MISSED, FAR = 0.17, 0.01, 0.25
#: Sizes of sets that are looked up together, as a ratio over 1.25; about how many of them there are; more than there can be.
SIZE_STEP, SIZES_APART, MAX_SIZES = 1.26, 8, 256
#: Rows of a table of keep_first(), about; rows beyond which a table is dealt out in parts; what a row looks at to each side at first.
NEAR_GROUP, TABLE_ROWS, WINDOW = 1 << 16, 1 << 18, 32
#: Bits of the parities of a set's hashes by which pairs are ruled out that cannot be similar.
PARITY_BITS = 512
PARITIES = [f"odd{k}" for k in range(PARITY_BITS // 64)]
#: Sets that may be similar are verified in blocks of about so many.
BLOCK = 500
#: Tables of ids of up to so many rows are broadcast.
BROADCAST_ROWS = 2_000_000
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
#: Constants of the mixing of 64-bit numbers that is known as SplitMix64.
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))

_LOW_BITS = np.uint64(0x0101010101010101)

_hash, _check = (partial(xxhash.xxh64_intdigest, seed=seed) for seed in (SEED, SEED + 1))


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes themselves for the first word of a fingerprint, else a mix of them that is its own hash."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * int(_MIX[0]) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    hashes = np.fromiter(map(_hash, shingles), "<u8")
    return int(np.packbits(_ones(hashes, 1) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _ones(hashes: np.ndarray, size: int) -> np.ndarray:
    """How many of the hashes have each bit of `size` words set: the bytes of a number count eight bits at once."""
    counts = np.zeros((size, 8, 8), np.int64)
    for at in range(0, len(hashes), 255 << 6):
        part = np.stack([_mixed(hashes[at : at + (255 << 6)], k) for k in range(size)])
        starts = np.arange(0, part.shape[1], 255)
        for bit in range(8):
            lanes = np.add.reduceat(part >> np.uint64(bit) & _LOW_BITS, starts, axis=1)
            counts[:, bit] += lanes.astype("<u8").view(np.uint8).reshape(size, -1, 8).sum(1, dtype=np.int64)
    return counts.transpose(0, 2, 1).reshape(-1)


def fingerprinted(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of documents (doc_id, text)."""

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["doc_id", "fp"])

        return batch

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_text(documents.select("doc_id", "text"), f"doc_id {kind}, fp long", make)


class _Forest:
    """Connected components of numbered things; links are added in bulk."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(deeper := root[root], root):
                root[:] = deeper


def link_group(nodes: np.ndarray, fps: np.ndarray, own: np.ndarray, low: np.ndarray, bits: int, half: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows that share the upper bits of a half.

    own: whether a row has these upper bits itself, and not only a neighbour of them.
    low: the lower bits of its half. Where more than BUCKET entries have a value, they
    are looked up by their other half too: of five parts of it at most three differ, so
    there is a table for each two of them.
    """
    entries = np.flatnonzero(own)
    if not len(entries) or len(fps) < 2:
        return []
    other = fps >> np.uint64(32 * (1 - half)) & np.uint64(0xFFFFFFFF)
    key = low.astype(np.uint64) << np.uint64(32)
    every, number = np.unique(nodes, return_inverse=True)
    forest = _Forest(len(every))
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def looked_up(mask: int, rows: np.ndarray, flip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The table of a mask of the other half, and where in it each row finds its entries."""
        if mask not in tables:
            full = key[entries] | other[entries] & np.uint64(mask)
            order = np.argsort(full, kind="stable")
            tables[mask] = entries[order], full[order]
        order, full = tables[mask]
        wanted = key[rows] ^ np.uint64(flip << 32) | other[rows] & np.uint64(mask)
        first = np.searchsorted(full, wanted)
        return order, first, np.searchsorted(full, wanted, "right") - first

    def verify(rows: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray) -> None:
        hit = n > 0
        rows, first, n = rows[hit], first[hit], n[hit]
        ends = np.cumsum(n)
        at = 0
        while at < len(rows):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            some = n[at:upto]
            left = np.repeat(rows[at:upto], some)
            within = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
            right = order[np.repeat(first[at:upto], some) + within]
            close = np.bitwise_count(fps[left] ^ fps[right]) <= DISTANCE
            forest.link(number[left[close]], number[right[close]])
            at = upto

    for flip in (0, *(1 << bit for bit in range(bits))):
        rows = np.flatnonzero(~own | ((low & np.uint32(flip)) != 0)) if flip else np.arange(len(fps))
        order, first, n = looked_up(0, rows, flip)
        few = n <= BUCKET
        verify(rows[few], order, first[few], n[few])
        if not few.all():
            for mask in _MASKS:
                verify(rows[~few], *looked_up(mask, rows[~few], flip))
    member = np.flatnonzero(forest.root != np.arange(len(every)))
    return list(zip(every[member].tolist(), every[forest.root[member]].tolist(), strict=True))


def links(distinct: DataFrame) -> DataFrame:
    """Edges a, b between nodes, with the components that all links of at most DISTANCE bits have.

    `distinct` has one row a fingerprint: node and fp (longs). No link is lost. Where
    very many fingerprints share the upper bits of a half, they are dealt out by two
    parts of the other half, as in link_group().
    """
    ship(distinct.sparkSession)
    total = distinct.count()
    prefix = min(28, max(LEAST_PREFIX, math.ceil(math.log2(max(1, total) / GROUP))))
    halves = F.array(
        *[
            F.struct(
                F.shiftrightunsigned("fp", 32 * half + 32 - prefix).bitwiseAND((1 << prefix) - 1).alias("upper"),
                F.shiftrightunsigned("fp", 32 * half).bitwiseAND((1 << (32 - prefix)) - 1).cast("int").alias("low"),
                F.shiftrightunsigned("fp", 32 - 32 * half).bitwiseAND(0xFFFFFFFF).alias("other"),
                F.lit(half).alias("half"),
            )
            for half in (0, 1)
        ]
    )
    flips = F.array(*[F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(prefix)]])
    rows = (
        distinct.select("node", "fp", F.explode(halves).alias("h"))
        .select("node", "fp", "h.*", F.explode(flips).alias("flip"))
        .select((F.col("upper").bitwiseXOR(F.col("flip")) * 2 + F.col("half")).alias("g"), (F.col("flip") == 0).alias("own"), "half", "low", "other", "node", "fp")
    )
    # Of so many rows or more there are at most MAX_HOT_KEYS groups.
    most = max(HOT_GROUP, total * 2 * (prefix + 1) // MAX_HOT_KEYS)
    hot = rows.groupBy("g").count().where(F.col("count") > most).select(F.col("g").alias("hot"))
    parts = F.array(*[F.xxhash64(F.lit(i), F.col("other").bitwiseAND(mask)) for i, mask in enumerate(_MASKS)])
    part = F.explode(F.when(F.col("hot").isNotNull(), parts).otherwise(F.array(F.lit(0).cast("long")))).alias("part")
    rows = rows.join(F.broadcast(hot), F.col("g") == F.col("hot"), "left").select("g", part, "half", "own", "low", "node", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []

        def batch() -> pa.RecordBatch:
            a, b = zip(*edges, strict=True) if edges else ((), ())
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for _, _, half, own, low, node, fp in _by_key(batches, 2):
            edges.extend(link_group(node, fp.view(np.uint64), own, low.astype(np.uint32), 32 - prefix, int(half[0])))
            if len(edges) >= PAIRS_AT_ONCE:
                yield batch()
        yield batch()

    return rows.repartition("g", "part").sortWithinPartitions("g", "part").mapInArrow(run, "a long, b long").distinct()


def _forest(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges node, root with the components of the edges a, b, as each of some tasks sees them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            a, b = (np.concatenate(c) for c in zip(*held, strict=True))
            every, number = np.unique(np.concatenate((a, b)), return_inverse=True)
            forest = _Forest(len(every))
            forest.link(number[: len(a)], number[len(a) :])
            member = np.flatnonzero(forest.root != np.arange(len(every)))
            yield pa.RecordBatch.from_arrays([pa.array(every[member]), pa.array(every[forest.root[member]])], names=["node", "root"])

    ship(edges.sparkSession)
    return edges.select("a", "b").coalesce(tasks).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (its component's smallest node) of each node of undirected edges a, b that is not a root.

    Tasks of up to EDGES_A_TASK edges first reduce what they have to a forest; where one
    task has them all, that is the result. Else large-star and small-star steps in turn:
    each round hangs neighbours onto the smallest node near them until every node hangs
    onto its root. Each round's edges are a written table. A star's middle, which may
    have very many neighbours, only ever takes part in minima, which are combined before
    the shuffle.
    """
    own = staged(edges.where("a <> b"), "edges")
    tasks = max(1, -(-own.count() // EDGES_A_TASK))
    now = staged(_forest(own, tasks), "edges")
    drop_staged(own)
    if tasks == 1:
        return now
    now = now.select(F.col("node").alias("a"), F.col("root").alias("b"))
    mark = None
    for _ in range(rounds):
        # Large star: each node's larger neighbours to the smallest of it and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a <> b").distinct(), "edges")
        # Small star: each node and its smaller neighbours to the smallest of them.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b")))
        after = staged(small.where("a <> b").distinct(), "edges")
        got = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_staged(large)
        drop_staged(now)
        now = after
        if got == mark:
            break
        mark = got
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document (doc_id, text)."""
    prints = staged(fingerprinted(documents, shingle), "fingerprints")
    each = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(links(each.select(F.col("fp").alias("node"), "fp")))
    rooted = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    # Of linked fingerprints only: one row a component.
    smallest = rooted.join(roots.select(F.col("root")).distinct(), "root", "left_semi").groupBy("root").agg(F.min("first").alias("least"))
    ids = rooted.join(smallest, "root", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id"))
    total = prints.count()
    return join_unique(prints, ids, "fp", "n", total).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


class _WordHashes(dict):
    """Hashes of words, remembered until there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = _hash(word)
        return found


_word_hashes = _WordHashes()


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles in order; a text of fewer words has one, of all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < shingle:
        return np.array([_hash(b" ".join(words))], np.uint64)
    each = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    rolled = each[: len(each) - shingle + 1].copy()
    for k in range(1, shingle):
        rolled *= _MIX[2]
        rolled += each[k : len(each) - shingle + 1 + k]
    found = np.sort(_mixed(rolled, 1))
    return found[np.append(True, found[1:] != found[:-1])]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have SIMILAR_OF[0] / SIMILAR_OF[1] of their union in common."""
    if min(len(a), len(b)) * SIMILAR_OF[1] < max(len(a), len(b)) * SIMILAR_OF[0]:
        return False
    both = np.sort(np.concatenate((a, b)), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common * SIMILAR_OF[1] >= (len(a) + len(b) - common) * SIMILAR_OF[0]


def parities(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of PARITY_BITS classes of hashes: whether the set has an odd number of them.

    Where two sets' bits differ, an element is in one set only, so as many elements or
    more are: a bound that no pair of sets is below.
    """
    odd = np.bincount((hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def may_be_similar(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets of these parities and sizes (of both together) can be similar: those that are have few elements in one set only."""
    apart = np.bitwise_count(left ^ right).sum(1, dtype=np.int64)
    part, whole = SIMILAR_OF
    return apart * (whole + part) <= sizes * (whole - part)


class Layout(NamedTuple):
    """Segments of the fingerprints of sets: `count` of `bits` each."""

    bits: int
    count: int

    @classmethod
    def of(cls, texts: int) -> Layout:
        """For about so many texts: a segment's bits follow the logarithm of their number, so that a table's
        entries are few; the number of segments is such that similar sets of which BIT_APART of the bits differ
        have one in which at most one bit does, but for MISSED of them."""
        bits = min(32, max(16, math.ceil(math.log2(max(2, texts))) - 2))
        hit = (1 - BIT_APART) ** bits + bits * BIT_APART * (1 - BIT_APART) ** (bits - 1)
        return cls(bits, math.ceil(math.log(MISSED) / math.log(1 - hit)))

    @property
    def names(self) -> list[str]:
        return [f"fp{k}" for k in range(-(-self.bits * self.count // 64))]

    def prefix(self, nodes: int) -> int:
        """Upper bits of a segment by which so many nodes are dealt out, besides their sizes."""
        return max(0, math.ceil(math.log2(max(1, nodes / SIZES_APART) / NEAR_GROUP)))

    @property
    def far(self) -> int:
        return int(FAR * self.bits * self.count)

    def fingerprint(self, hashes: np.ndarray) -> np.ndarray:
        ones = _ones(hashes, len(self.names))
        ones[self.bits * self.count :] = 0
        return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")

    def value(self, k: int) -> Column:
        """Segment k by the columns of a fingerprint's words."""
        word, bit = divmod(k * self.bits, 64)
        got = F.shiftrightunsigned(f"fp{word}", bit) if bit else F.col(f"fp{word}")
        if bit + self.bits > 64:
            got = got.bitwiseOR(F.shiftleft(f"fp{word + 1}", 64 - bit))
        return got.bitwiseAND((1 << self.bits) - 1)

    def values(self, words: np.ndarray) -> np.ndarray:
        """All segments, a column each, by the rows of words."""
        out = np.empty((len(words), self.count), np.uint32)
        for k in range(self.count):
            word, bit = divmod(k * self.bits, 64)
            got = words[:, word] >> np.uint64(bit)
            if bit + self.bits > 64:
                got |= words[:, word + 1] << np.uint64(64 - bit)
            out[:, k] = got & np.uint64((1 << self.bits) - 1)
        return out


def _described(documents: DataFrame, shingle: int, layout: Layout) -> DataFrame:
    """For each row (doc_id, row, text): node and check, two hashes of its set of shingles, the set's size and fingerprint."""
    names = layout.names

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, shingle) for t in b.column(2).to_pylist()]
            node, check = (np.array([f(s.tobytes()) for s in sets], np.uint64).view(np.int64) for f in (_hash, _check))
            fps = np.array([layout.fingerprint(s) for s in sets], np.uint64).view(np.int64)
            columns = [b.column(0), b.column(1), pa.array(node), pa.array(check), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, np.ascontiguousarray(fps.T))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "node", "check", "n", *names])

        return batch

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row binary, node long, check long, n long, " + ", ".join(f"{x} long" for x in names)
    return map_text(documents.select("doc_id", "row", "text"), schema, make)


def _distinct(described: DataFrame, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """The rows, and a row for each node: n and the fingerprint. Sets that share a node by chance, but not the check, get nodes of their own."""
    each = lambda rows: staged(rows.groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high"), *[F.min(c).alias(c) for c in ("n", *layout.names)]), "distinct")
    nodes = each(described)
    mixed = nodes.where("low <> high").select("node", F.col("low").alias("_low"))
    if not mixed.isEmpty():  # of 10 ** 10 sets about three pairs
        apart = F.when(F.col("check") != F.col("_low"), F.xxhash64("node", "check")).otherwise(F.col("node"))
        described = staged(described.join(_few(mixed), "node", "left").withColumn("node", apart).drop("_low"), "described")
        nodes = each(described)
    return described, nodes.drop("low", "high")


def _dealt(nodes: DataFrame, total: int, layout: Layout, every: bool) -> DataFrame:
    """Rows of the tables, for nodes (node, root, n, fp0 ...): table, part, split, segment, own, low and the node's columns.

    A table holds a segment's fingerprints of sets of about one size that share its
    upper bits. Each node is in the table of its own, and visits that of the next size
    and those in whose upper bits one bit differs. Tables with very many rows are
    dealt out in parts; where `every` pair is wanted, each two parts meet.
    """
    prefix = layout.prefix(total)
    low = layout.bits - prefix
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(SIZE_STEP)).cast("long")
    segments = F.array(*[F.struct(F.lit(k).alias("segment"), layout.value(k).alias("v")) for k in range(layout.count)])
    flips = [0, *(1 << b for b in range(prefix))]
    visits = F.array(*[F.struct(F.lit(step).cast("long").alias("step"), F.lit(flip).cast("long").alias("flip")) for step in (0, 1) for flip in flips])
    columns = [c for c in nodes.columns if c not in layout.names] + layout.names
    rows = (
        nodes.select(*columns, size.alias("size"), F.explode(segments).alias("s"))
        .select(*columns, "size", "s.*", F.explode(visits).alias("t"))
        .withColumn("upper", F.shiftrightunsigned("v", low))
        # Within a size, the one of the greater upper bits visits the other.
        .where((F.col("t.flip") == 0) | (F.col("t.step") == 1) | (F.col("upper").bitwiseAND(F.col("t.flip")) != 0))
        .select(
            ((F.col("segment") * MAX_SIZES + F.col("size") + F.col("t.step")) * (1 << prefix) + F.col("upper").bitwiseXOR(F.col("t.flip"))).alias("table"),
            "segment", ((F.col("t.flip") == 0) & (F.col("t.step") == 0)).alias("own"),
            F.col("v").bitwiseAND((1 << low) - 1).alias("low"), *columns,
        )
    )
    # Of so many rows or more there are at most MAX_HOT_KEYS tables.
    most = max(TABLE_ROWS, total * layout.count * 2 * (prefix + 1) // MAX_HOT_KEYS)
    hot = rows.groupBy("table").count().where(F.col("count") > most).select(F.col("table").alias("hot"), F.ceil(F.col("count") / most).alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.join(F.broadcast(hot), F.col("table") == F.col("hot"), "left").withColumn("part", F.pmod(F.xxhash64("node", "segment"), parts))
    rows = rows.withColumn("split", parts > 1)
    if every:
        other = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
        rows = rows.withColumn("other", other).withColumn("part", F.least("part", "other") * parts + F.greatest("part", "other"))
    return rows.select("table", "part", "split", "segment", "own", "low", *columns)


def near_pairs(
    layout: Layout, low_bits: int, split: bool, segment: int, own: np.ndarray, low: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, fps: np.ndarray,
    every: bool, odd: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a table's rows, with their distances: of different roots, sizes that allow similarity, and a small distance.

    For each row, the values of a ball of radius 1 round its low bits are looked up
    among the table's own rows, and what is found is verified by the complete distance.
    Where parities are given, pairs that these rule out are left out.
    `every`: all such pairs that no earlier segment has, by their places. Else by their
    nodes, and for each row the nearest and the smallest of what it looks at: at most 2 * WINDOW entries with a value, and the
    smallest of them all. A row that would have more to look at, as have all of a table
    that is `split`, comes as a pair with itself.
    """
    entries = np.flatnonzero(own)
    if not len(entries) or len(node) < 2 or (root == root[0]).all():
        return
    values = layout.values(fps)
    second = np.unique(root, return_inverse=True)[1].astype(np.uint64) if every else values[:, (segment + 1) % layout.count].astype(np.uint64)
    key = low.astype(np.uint64) << np.uint64(32) | second
    entries = entries[np.argsort(key[entries], kind="stable")]
    table = key[entries]
    place = np.full(len(node), -1)
    place[entries] = np.arange(len(entries))
    top, below = np.uint64(1 << 32), np.uint64((1 << 32) - 1)
    more = np.full(len(node), split)
    by_node = entries[np.lexsort((node[entries], low[entries]))]
    lows, first_of_low = np.unique(low[by_node], return_index=True)
    stars = place[by_node[first_of_low]]  # of each value the entry of the smallest node

    def looked_up(flip: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, and the beginnings and ends of what they look at in the table."""
        rows = np.flatnonzero(~own | ((low & flip) != 0)) if flip else np.arange(len(node))
        base = key[rows] & ~below ^ np.uint64(flip << 32)
        at = base | second[rows]
        first, last = np.searchsorted(table, base), np.searchsorted(table, base + (top - np.uint64(1)), "right")
        hit = last > first
        rows, at, first, last = rows[hit], at[hit], first[hit], last[hit]
        mine = own[rows] & (flip == 0)  # each such pair is found from both sides, but for the places
        if every:
            after = np.searchsorted(table, at, "right")
            yield rows, after, last
            others = ~mine
            yield rows[others], first[others], np.searchsorted(table, at[others])
        else:
            middle = np.where(mine, place[rows] + 1, np.searchsorted(table, at))
            begin = np.where(mine, middle, np.maximum(first, middle - WINDOW))
            end = np.minimum(last, middle + WINDOW)
            yield rows, begin, end
            star = stars[np.searchsorted(lows, (base >> np.uint64(32)).astype(np.int64)[hit])]
            yield rows, star, star + 1
            cut = (middle - first > WINDOW) | (last - middle > WINDOW)
            more[rows[cut]] = True
            covered = np.zeros(len(entries) + 1, np.int64)
            np.add.at(covered, first[cut], 1)
            np.add.at(covered, last[cut], -1)
            more[entries[np.cumsum(covered)[:-1] > 0]] = True

    def verified(rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        hit = end > begin
        rows, begin, count = rows[hit], begin[hit], (end - begin)[hit]
        ends = np.cumsum(count)
        at = 0
        while at < len(rows):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            some = count[at:upto]
            left = np.repeat(rows[at:upto], some)
            right = entries[np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(begin[at:upto], some)]
            at = upto
            may = (root[left] != root[right]) & (np.minimum(n[left], n[right]) * SIMILAR_OF[1] >= np.maximum(n[left], n[right]) * SIMILAR_OF[0])
            left, right = left[may], right[may]
            apart = np.bitwise_count(fps[left] ^ fps[right]).sum(1, dtype=np.int64)
            may = apart <= layout.far
            left, right, apart = left[may], right[may], apart[may]
            if odd is not None and len(left):
                may = may_be_similar(odd[left], odd[right], n[left] + n[right])
                left, right, apart = left[may], right[may], apart[may]
            if every and segment and len(left):
                earlier = (np.bitwise_count(values[left, :segment] ^ values[right, :segment]) <= 1).any(1)
                left, right, apart = left[~earlier], right[~earlier], apart[~earlier]
            if len(left):
                yield left, right, apart

    best = np.full(len(node), 1 << 20)
    nearest = np.full(len(node), -1)
    smallest = node.copy()
    for flip in (0, *(1 << b for b in range(low_bits))):
        for looked in looked_up(flip):
            for left, right, apart in verified(*looked):
                if every:
                    yield left, right, apart
                    continue
                for x, y in ((left, right), (right, left)):
                    np.minimum.at(smallest, x, node[y])
                    order = np.argsort(-apart, kind="stable")  # the last to be written is the nearest
                    x, y, d = x[order], y[order], apart[order]
                    nearer = d < best[x]
                    x, y, d = x[nearer], y[nearer], d[nearer]
                    nearest[x], best[x] = y, d
    if not every:
        found = np.flatnonzero(nearest >= 0)
        other = node[nearest[found]]
        yield np.minimum(node[found], other), np.maximum(node[found], other), best[found]
        less = np.flatnonzero(smallest < node)
        yield smallest[less], node[less], np.full(len(less), layout.far)
        left_over = np.unique(node[more])
        yield left_over, left_over, np.zeros(len(left_over), np.int64)


def _pairs(nodes: DataFrame, layout: Layout) -> DataFrame:
    """Some pairs a <= b of nodes (node, root, n, fp0 ...) and their distance, a few a node: see near_pairs()."""
    total = nodes.count()
    low_bits = layout.bits - layout.prefix(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _by_key(batches, 2):
            split, segment, own, low, node, root, n, *words = columns[2:]
            fps = np.stack(words, 1).view(np.uint64)
            for got in near_pairs(layout, low_bits, bool(split[0]), int(segment[0]), own, low, node, root, n, fps, False):
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["a", "b", "d"])

    dealt = _dealt(nodes.select("node", "root", "n", *layout.names), total, layout, False)
    return dealt.repartition("table", "part").sortWithinPartitions("table", "part").mapInArrow(run, "a long, b long, d long")


def _units(nodes: DataFrame, layout: Layout) -> DataFrame:
    """unit and node: for each two blocks (or one) with near pairs of different roots between them, the nodes of these pairs.

    So pairs, of which a dense group has very many, never leave the task that finds them;
    and those that are near but cannot be similar are ruled out there by their parities.
    """
    total = nodes.count()
    low_bits = layout.bits - layout.prefix(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _by_key(batches, 2):
            split, segment, own, low, node, root, n, block, *words = columns[2:]
            odd, fps = (np.stack(w, 1).view(np.uint64) for w in (words[: len(PARITIES)], words[len(PARITIES) :]))
            found = np.empty((0, 2), np.int64)
            for left, right, _ in near_pairs(layout, low_bits, bool(split[0]), int(segment[0]), own, low, node, root, n, fps, True, odd):
                least, most = np.minimum(block[left], block[right]), np.maximum(block[left], block[right])
                unit = _mixed(least.view(np.uint64) * _MIX[1] + most.view(np.uint64), 1).view(np.int64)
                some = np.stack((np.concatenate((unit, unit)), np.concatenate((node[left], node[right]))), 1)
                found = np.unique(np.concatenate((found, some)), axis=0)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["unit", "node"])

    dealt = _dealt(nodes.select("node", "root", "n", "block", *PARITIES, *layout.names), total, layout, True)
    found = dealt.repartition("table", "part").sortWithinPartitions("table", "part").mapInArrow(run, "unit long, node long")
    return found.distinct()


def unit_edges(node: np.ndarray, root: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], far: int) -> list[tuple[int, int]]:
    """Edges between similar sets of a unit that connect what these roots and the edges before do not."""
    every, number = np.unique(root, return_inverse=True)
    forest = _Forest(len(every))
    n = np.array([len(s) for s in sets])
    edges = []
    for i in range(len(node) - 1):
        apart = np.bitwise_count(fps[i + 1 :] ^ fps[i]).sum(1, dtype=np.int64)
        may = (apart <= far) & (forest.root[number[i + 1 :]] != forest.root[number[i]])
        may &= np.minimum(n[i + 1 :], n[i]) * SIMILAR_OF[1] >= np.maximum(n[i + 1 :], n[i]) * SIMILAR_OF[0]
        places = np.flatnonzero(may)
        for j in (places[np.argsort(apart[places], kind="stable")] + i + 1).tolist():
            if forest.root[number[i]] != forest.root[number[j]] and similar(sets[i], sets[j]):
                forest.link(number[i : i + 1], number[j : j + 1])
                edges.append((int(node[i]), int(node[j])))
    return edges


def _verified_units(units: DataFrame, nodes: DataFrame, sets: DataFrame, layout: Layout) -> DataFrame:
    """Edges a, b between similar sets of each unit (unit, node), by nodes (node, root, fp0 ...) and sets (node, set)."""
    names = layout.names
    rows = units.join(nodes.select("node", "root", *names), "node").join(sets.select("node", "set"), "node").select("unit", "node", "root", "set", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def done() -> pa.RecordBatch:
            node, root, sets, *words = zip(*held, strict=True)
            edges = unit_edges(np.array(node), np.array(root), np.array(words, np.int64).T.copy().view(np.uint64), list(sets), layout.far)
            a, b = zip(*edges, strict=True) if edges else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for unit, node, root, packed, *words in zip(*columns, strict=True):
                if held and unit != last:
                    yield done()
                    held = []
                last = unit
                held.append((node, root, np.frombuffer(packed, "<u8"), *words))
        if held:
            yield done()

    return rows.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(run, "a long, b long")


def _by_key(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows that are equal in the first `width` columns, of sorted batches of numbers."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not b.num_rows:
            continue
        change = np.any([c[1:] != c[:-1] for c in columns[:width]], axis=0)
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for first, last in pairwise(starts):
            part = [c[first:last] for c in columns]
            if held and any(h[0] != p[0] for h, p in zip(held[0][:width], part[:width], strict=True)):
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            held.append(part)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are similar, by sets (node, block, set).

    Nodes that may be similar are in blocks of bounded size. Each two blocks with pairs
    between them are a task's unit, to which the sets of these pairs go once.
    """
    block = sets.select("node", "block")
    met = (
        pairs.select("a", "b")
        .join(block.select(F.col("node").alias("a"), F.col("block").alias("block_a")), "a")
        .join(block.select(F.col("node").alias("b"), F.col("block").alias("block_b")), "b")
        .select(F.xxhash64(F.least("block_a", "block_b"), F.greatest("block_a", "block_b")).alias("unit"), "a", "b")
    )
    needed = met.select("unit", F.col("a").alias("node")).unionByName(met.select("unit", F.col("b").alias("node"))).distinct()
    shipped = needed.join(sets, "node").select("unit", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), "set")
    rows = shipped.unionByName(met.select("unit", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("set")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        last = None
        for whole in batches:
            good = []
            units, kinds, left, right = (whole.column(i).to_pylist() for i in range(4))
            for i, (unit, kind, a, b) in enumerate(zip(units, kinds, left, right, strict=True)):
                if unit != last:
                    held, last = {}, unit
                if kind == 0:
                    held[a] = np.frombuffer(whole.column(4)[i].as_py(), "<u8")
                elif similar(held[a], held[b]):
                    good.append((a, b))
            x, y = zip(*good, strict=True) if good else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return rows.repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(run, "a long, b long")


def _few(df: DataFrame) -> DataFrame:
    """A table of ids, marked for broadcast if it has at most BROADCAST_ROWS; else it is joined as Spark chooses."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sets(documents: DataFrame, described: DataFrame, blocks: DataFrame, shingle: int) -> DataFrame:
    """node, block, set (its hashes as bytes) and parities of the nodes of blocks (node, block)."""

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, shingle) for t in b.column(3).to_pylist()]
            odd = np.array([parities(s) for s in sets], np.uint64).reshape(-1, len(PARITIES)).view(np.int64)
            columns = [*(b.column(i) for i in range(3)), pa.array([s.tobytes() for s in sets], pa.binary()), *map(pa.array, np.ascontiguousarray(odd.T))]
            return pa.RecordBatch.from_arrays(columns, names=["node", "block", "copies", "set", *PARITIES])

        return batch

    rows = described.join(blocks, "node").groupBy("row", "node", "block").agg(F.count("*").alias("copies"))
    first = rows.groupBy("node", "block").agg(F.min("row").alias("row"), F.min_by("copies", "row").alias("copies"))
    first = staged(first, "first")
    texts = documents.select("row", "text").join(_few(first), "row").select("node", "block", "copies", "text")
    sets = map_text(texts, "node long, block long, copies long, set binary, " + ", ".join(f"{c} long" for c in PARITIES), make)
    own = ["set", *PARITIES]
    once = sets.where("copies = 1").select("node", "block", *own)
    if first.where("copies > 1").isEmpty():
        return once
    return once.unionByName(sets.where("copies > 1").groupBy("node", "block").agg(F.first(F.struct(*own)).alias("s")).select("node", "block", "s.*"))


def _blocks(found: DataFrame) -> DataFrame:
    """node and block of all nodes of the pairs a <= b: those with one smallest partner, in parts of about BLOCK."""
    hubs = (
        found.select(F.col("b").alias("node"), F.col("a").alias("hub"))
        .unionByName(found.select(F.col("a").alias("node"), F.col("a").alias("hub")))
        .groupBy("node").agg(F.min("hub").alias("hub"))
    )
    sizes = hubs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    return hubs.join(sizes, "hub").select("node", F.xxhash64("hub", F.pmod(F.xxhash64("node"), "parts")).alias("block"))


def _groups(documents: DataFrame, described: DataFrame, each: DataFrame, shingle: int, layout: Layout) -> DataFrame | None:
    """node and root of the nodes that are not roots of their groups; None if no two nodes may be similar."""
    names = layout.names
    found = staged(_pairs(each.withColumn("root", F.col("node")), layout), "near")
    if found.isEmpty():
        return None
    some = found.where("a <> b")
    by_b = some.groupBy("b").agg(F.min_by("a", "d").alias("a"), F.min("a").alias("least"))
    by_a = some.groupBy("a").agg(F.min_by("b", "d").alias("b"))
    first = by_b.select("a", "b").unionByName(by_b.select(F.col("least").alias("a"), "b")).unionByName(by_a.select("a", "b"))
    first = staged(first.distinct(), "pairs")
    sets = staged(_sets(documents, described, staged(_blocks(found), "blocks"), shingle), "sets")
    edges = staged(_verified(first, sets), "edges")
    # All others between the components that these have.
    rooted = each.join(sets.select("node", "block", *PARITIES), "node").join(components(edges), "node", "left")
    active = staged(rooted.select("node", F.coalesce("root", "node").alias("root"), "n", "block", *PARITIES, *names), "active")
    units = staged(_units(active, layout), "units")
    return components(edges.unionByName(staged(_verified_units(units, active, sets, layout), "edges")))


def _identity(documents: DataFrame) -> Column:
    """128 bits of all columns of a row, and of which of them are null (a hash of columns passes over nulls)."""
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in documents.columns])
    half = lambda k: F.lpad(F.hex(F.xxhash64(F.lit(k), nulls, *[F.col(f"`{c}`") for c in documents.columns])), 16, "0")
    return F.unhex(F.concat(half(0), half(1)))


def _decided(documents: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Of documents (doc_id, row, text): what is kept (doc_id, row, how many rows are equal to it), and the rows that go."""
    layout = Layout.of(documents.count())
    described, each = _distinct(staged(_described(documents, shingle, layout), "described"), layout)
    roots = _groups(documents, described, each, shingle, layout)
    rows = described.groupBy("row", "node").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    root = F.col("node")
    if roots is not None:
        rows, root = rows.join(roots, "node", "left"), F.coalesce("root", "node")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "copies")
    kept = staged(rows.groupBy(root.alias("root")).agg(F.min(order).alias("first")).select("first.doc_id", "first.row", "first.copies"), "kept")
    gone = staged(rows.select("row").join(kept, "row", "left_anti"), "gone")
    return kept, gone


def near_groups(documents: DataFrame, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """The ids of the rows of which each group of near copies keeps one, that with the smallest id: column doc_id."""
    return _decided(documents.select("doc_id", "text", _identity(documents).alias("row")), shingle)[0].select("doc_id")


def keep_first(documents: DataFrame, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """The documents, with all their columns, of which each group of near copies keeps one row: that with the smallest id.

    Rows are told apart by all their columns and not by their ids: rows with the same
    id and other texts are documents of their own, as are rows without an id, which
    come last in the order of ids. Of rows that are equal in all columns one stays.
    Further columns may have any name. Texts are not shuffled unless very many rows go.
    """
    own = next(name for k in range(len(documents.columns) + 1) if (name := f"_row{k}") not in map(str.lower, documents.columns))
    rows = documents.withColumn(own, _identity(documents))
    kept, gone = _decided(rows.select("doc_id", "text", F.col(own).alias("row")), shingle)
    again = staged(kept.where("copies > 1").select("row"), "again")
    named = lambda df: df.withColumnRenamed("row", own)
    left = rows.join(_few(named(gone.unionByName(again))), own, "left_anti").drop(own)
    if again.isEmpty():
        return left
    one = rows.join(_few(named(again)), own, "left_semi").dropDuplicates([own]).drop(own)
    return left.unionByName(one)
