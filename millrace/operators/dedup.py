"""Exact identity, perceptual near-duplicates, and splits that keep copies together."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import flag, hash_fraction, hash_order
from millrace.operators.ranking import hash_ranked
from millrace.session import ship

#: Kinds of groups (label and size) that a split may have; groups of one kind are alike to it.
MAX_KINDS = 200_000
#: Places among a kind's groups whose parts are found at once.
STRETCH = 1 << 14


def group_id(content: str) -> Column:
    """Identity by content alone; near copies are never merged into it."""
    return F.concat(F.lit("sha256-"), F.sha2(F.col(content), 256))


def exact_groups(df: DataFrame, content: str, key: str) -> DataFrame:
    """Groups of more than one row with equal content: their size and smallest key."""
    return df.where(F.col(content).isNotNull()).groupBy(group_id(content).alias("group_id")).agg(
        F.count("*").alias("n"), F.min(key).alias("first")
    ).where(F.col("n") > 1)


def group_conflicts(df: DataFrame, content: str, label: str) -> DataFrame:
    """Groups of equal content whose rows have more than one label, with the labels in order."""
    return df.where(F.col(content).isNotNull()).groupBy(group_id(content).alias("group_id")).agg(
        F.countDistinct(label).alias("n_labels"), F.array_join(F.sort_array(F.collect_set(label)), ",").alias("labels")
    ).where(F.col("n_labels") > 1)


def inventory_vs_spec(df: DataFrame, spec: DataFrame, label: str) -> DataFrame:
    """Expected and observed counts by label, from both sides."""
    seen = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("observed"))
    return seen.join(spec, "label", "full").select(
        "label", F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.coalesce("observed", F.lit(0)).alias("observed"),
        (F.coalesce("observed", F.lit(0)) == F.coalesce("expected", F.lit(0))).alias("agrees"),
    )


def difference_hash(values: Column, bits: int) -> Column:
    """Whether each of the first `bits` values is over the next one, the first as the highest bit."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(bits)), F.lit(0).cast("long"),
        lambda h, i: h * 2 + F.when(F.element_at(values, i) > F.element_at(values, i + 1), 1).otherwise(0),
    )


def near_pairs(df: DataFrame, key: str, block: str, bits: int, distance: int) -> DataFrame:
    """Pairs a < b of one block with different content whose hashes differ in at most `distance` bits.

    The hash is cut into distance + 1 bands, of which one must be equal; a pair is
    kept in the first band that it shares. Columns: key, block, hash, content.
    """
    width = -(-bits // (distance + 1))
    band = lambda h, i: F.shiftright(h, width * i).bitwiseAND((1 << width) - 1)
    bands = F.array(*[F.struct(F.lit(i).alias("i"), band(F.col("hash"), i).alias("v")) for i in range(distance + 1)])
    rows = df.select(key, block, "hash", "content", F.explode(bands).alias("band"))
    a = rows.select(block, "band", F.col(key).alias("a"), F.col("hash").alias("ha"), F.col("content").alias("ca"))
    b = rows.select(block, "band", F.col(key).alias("b"), F.col("hash").alias("hb"), F.col("content").alias("cb"))
    differ = F.col("ha").bitwiseXOR(F.col("hb"))
    earlier = F.lit(False)
    for i in range(distance + 1):
        earlier = earlier | ((F.col("band.i") > i) & (band(differ, i) == 0))
    return (
        a.join(b, [block, "band"])
        .where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.bit_count(differ) <= distance) & ~earlier)
        .select("a", "b", F.bit_count(differ).cast("int").alias("distance"))
    )


def hash_split(df: DataFrame, tokens: Column, seed: str = "split", train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Adds `split` by a hash of the lower-cased tokens; labels play no part, and equal content goes together."""
    text = F.concat(F.lit(seed + "\x1e"), F.array_join(F.transform(tokens, F.lower), "\x1f"))
    x = hash_fraction(text)
    return df.withColumn("split", F.when(x < train, "train").when(x < train + validation, "validation").otherwise("test"))


class Parts:
    """Where groups of one label and size go, one after another: each to the part in which it costs least at the time.

    A part costs, for a label, its squared miss of the target over the target, three times as
    much above it; and a quarter of the same (without the factor) for all labels together.
    What one more group costs a part only rises with the groups that it has, so the groups take
    the smallest costs of all parts' lists in order, and how many a part has after any number
    of groups is found by halving; none has to be gone through for that. Equal costs go to
    the part that is named first.
    """

    def __init__(self, size: float, have: list[float], targets: list[float], whole: list[float], whole_targets: list[float]):
        self.size, self.have, self.targets, self.whole, self.whole_targets = size, have, targets, whole, whole_targets

    def costs(self, part: int, taken: np.ndarray) -> np.ndarray:
        """What the next group costs a part that has taken so many; without differences of large squares."""
        g, t, w = self.size, self.targets[part], self.whole_targets[part]
        h, all_ = self.have[part] + g * taken, self.whole[part] + g * taken
        step = g * (2 * (h - t) + g)
        across = 3 * (h + g - t) ** 2 - (h - t) ** 2
        own = np.where(h + g <= t, step, np.where(h >= t, 3 * step, across))
        return own / max(t, 1.0) + 0.25 * g * (2 * (all_ - w) + g) / max(w, 1.0)

    def _cost(self, part: int, taken: int) -> float:
        return float(self.costs(part, np.array([taken]))[0])

    def _under(self, part: int, limit: float, most: int) -> int:
        """How many of a part's first `most` costs are at most `limit`."""
        return bisect_right(range(most), limit, key=lambda k: self._cost(part, k))

    def taken(self, n: int) -> list[int]:
        """How many groups each part has after n of them."""
        parts = range(len(self.have))
        if n <= STRETCH:
            return np.bincount(self._merged([0] * len(parts), n), minlength=len(parts)).tolist()
        low, high = -1.0, 1.0
        counts = lambda limit: [self._under(p, limit, n) for p in parts]
        while sum(counts(low)) > n:
            low *= 4
        while sum(counts(high)) <= n and high < 1e300:
            high *= 4
        while high - low > 1e-15 * max(abs(low), abs(high)) and (middle := (low + high) / 2) not in (low, high):
            if sum(counts(middle)) <= n:
                low = middle
            else:
                high = middle
        found = counts(low)
        # What is left are the next costs in order: equal ones, or some too near for the halving.
        rest = self._merged(found, n - sum(found))
        return [f + int(m) for f, m in zip(found, np.bincount(rest, minlength=len(parts)), strict=True)]

    def _merged(self, start: list[int], n: int) -> np.ndarray:
        costs = np.concatenate([self.costs(p, start[p] + np.arange(n)) for p in range(len(start))])
        of = np.repeat(np.arange(len(start)), n)
        return of[np.lexsort((of, costs))[:n]]

    def stretch(self, first: int, n: int) -> np.ndarray:
        """The parts of n groups from place `first` on."""
        return self._merged(self.taken(first), n)


def greedy_group_split(groups: DataFrame, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """Adds `split` to groups (group_id, label, size) so that labels keep their shares and groups stay whole.

    Large groups come first, then those of rare labels, then by a seeded hash. A group goes
    where the sum of relative squared misses (three times as much where a part is over its
    target, and a quarter of that of the part's total) is smallest. Groups of one label and
    size are alike, so the driver only needs how many there are of each such kind; a
    group's place among its kind is a distributed rank, and the parts of a stretch of places
    are found in the task that has them (see Parts).

    Refused: shares that are not positive or do not sum to 1, a group with several labels or
    rows, fewer groups than parts, and a split that leaves a part empty.
    """
    names = list(shares)
    if not names or min(shares.values()) <= 0 or abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must be positive and sum to 1")
    rows = groups.groupBy("group_id").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))
    bad = rows.agg(F.count("*").alias("groups"), F.coalesce(F.sum(flag(F.col("labels") > 1)), F.lit(0)).alias("mixed"), F.coalesce(F.sum(flag(F.col("n") > 1)), F.lit(0)).alias("repeated")).first()
    if bad["mixed"] or bad["repeated"]:
        raise ValueError(f"{bad['mixed']} groups have conflicting labels, {bad['repeated']} more than one row")
    if bad["groups"] < len(names):
        raise ValueError("fewer groups than parts")
    kinds = groups.groupBy("label", "size").agg(F.count("*").alias("n")).limit(MAX_KINDS + 1).collect()
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of groups")
    total: dict[str, float] = defaultdict(float)
    for k in kinds:
        total[k["label"]] += k["size"] * k["n"]
    every = sum(total.values())
    have = {label: [0.0] * len(names) for label in total}
    whole, number = [0.0] * len(names), [0] * len(names)
    plan: dict[tuple, tuple[Parts, int]] = {}
    for k in sorted(kinds, key=lambda k: (-k["size"], total[k["label"]], str(k["label"]))):
        own = have[k["label"]]
        parts = Parts(float(k["size"]), list(own), [total[k["label"]] * shares[s] for s in names], list(whole), [every * shares[s] for s in names])
        plan[k["label"], k["size"]] = parts, k["n"]
        for i, n in enumerate(parts.taken(k["n"])):
            own[i] += k["size"] * n
            whole[i] += k["size"] * n
            number[i] += n
    if not all(number):
        raise ValueError("a part would be empty: " + ", ".join(s for s, n in zip(names, number, strict=True) if not n))

    spark = groups.sparkSession
    ship(spark)
    shared, columns = spark.sparkContext.broadcast(plan), groups.columns  # one entry a kind
    ranked = hash_ranked(groups, ["label", "size"], hash_order(F.lit(seed), F.col("group_id")), "_rank")

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = shared.value
        known: dict[tuple, np.ndarray] = {}
        for batch in batches:
            split = np.empty(len(batch), object)
            at = batch["_rank"].to_numpy() // STRETCH
            for (label, size, stretch), places in batch.groupby(["label", "size", pd.Series(at, index=batch.index)], dropna=False, sort=False).indices.items():
                key = (None if pd.isna(label) else label, size, stretch)
                if key not in known:
                    if len(known) > 64:
                        known.clear()
                    parts, n = plan[key[:2]]
                    known[key] = parts.stretch(int(stretch) * STRETCH, min(STRETCH, n - int(stretch) * STRETCH))
                split[places] = [names[p] for p in known[key][batch["_rank"].to_numpy()[places] % STRETCH]]
            yield batch[columns].assign(split=split)

    fields = ", ".join(f"`{c}` {t}" for c, t in groups.dtypes)
    return ranked.mapInPandas(dealt, f"{fields}, split string")


def split_audit(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows by split and label, and how many groups are in more than one split."""
    crossing = df.groupBy(group).agg(F.countDistinct("split").alias("n")).where("n > 1").agg(F.count("*").alias("crossing_groups"))
    return df.groupBy("split", label).agg(F.count("*").alias("n")).crossJoin(F.broadcast(crossing))


def missing_from(expected: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """Identities on one side only, with the side."""
    only = lambda a, b, name: a.select(*key).join(b.select(*key), key, "left_anti").withColumn("side", F.lit(name))
    return only(expected, observed, "expected").unionByName(only(observed, expected, "observed"))


def record_audit(df: DataFrame, key: str, sizes: list[str]) -> DataFrame:
    """One row: null and repeated keys, and sizes that are not positive."""
    repeated = df.groupBy(key).count().where("count > 1").agg(F.count("*").alias("repeated"))
    return df.agg(
        F.count("*").alias("n_rows"), F.coalesce(F.sum(flag(F.col(key).isNull())), F.lit(0)).alias("null_keys"),
        *[F.coalesce(F.sum(flag(~(F.col(c) > 0))), F.lit(0)).alias(f"bad_{c}") for c in sizes],
    ).crossJoin(F.broadcast(repeated))
