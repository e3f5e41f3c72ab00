"""Instances in labelled points: overlap, one-to-one matching, and scores of plots and sites.

Points are (plot, pred, ref, cls) with whole numbers. A prediction with id 0 or -1 is
none; one with strictly more than half of its points in the boundary class is left
out whole. A reference point counts where its class is one of ACTIVE and its id is
positive.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.scalar import flag, ratio
from millrace.operators.graphs import components
from millrace.session import ship, staged

IGNORED = (0, -1)
BOUNDARY = 3
ACTIVE = (4, 5, 6)


def counted(points: DataFrame) -> DataFrame:
    """How many points each (plot, pred, ref) has (column n), of them in the boundary class (boundary) and where the reference counts (live).

    All else comes from these counts, so no point is joined.
    """
    return points.groupBy("plot", "pred", "ref").agg(
        F.count("*").alias("n"), F.sum(flag(F.col("cls") == BOUNDARY)).alias("boundary"), F.sum(flag(F.col("cls").isin(*ACTIVE) & (F.col("ref") > 0))).alias("live")
    )


def _excluded(counts: DataFrame) -> DataFrame:
    sizes = counts.where(~F.col("pred").isin(*IGNORED)).groupBy("plot", "pred").agg(F.sum("n").alias("n"), F.sum("boundary").alias("boundary"))
    return sizes.where(2 * F.col("boundary") > F.col("n"))


def boundary_excluded(points: DataFrame) -> DataFrame:
    """Predictions that are left out, with their size and boundary points."""
    return _excluded(counted(points))


def active(points: DataFrame) -> DataFrame:
    """The counts of counted(), with whether the prediction counts (pa); written once, since what is read from it is read several times."""
    return _active(staged(counted(points), "counts"))


def _active(counts: DataFrame) -> DataFrame:
    own = F.coalesce(~F.col("pred").isin(*IGNORED), F.lit(False))
    out = _excluded(counts).select("plot", "pred", F.lit(True).alias("_out"))
    columns = ["plot", "pred", "ref", "n", "live"]
    # A plot's points without a prediction may be most of its points, and meet nothing.
    none = counts.where(~own).select(*columns, F.lit(False).alias("pa"))
    some = counts.where(own).join(out, ["plot", "pred"], "left").select(*columns, F.col("_out").isNull().alias("pa"))
    return staged(some.unionByName(none), "active")


def overlaps(points: DataFrame) -> DataFrame:
    """Pairs (plot, pred, ref) that share points: the shared ones, and the size of the union. No pair without any is made."""
    return _overlaps(active(points))


def _overlaps(a: DataFrame) -> DataFrame:
    preds = a.where("pa").groupBy("plot", "pred").agg(F.sum("n").alias("_p"))
    refs = a.where("live > 0").groupBy("plot", "ref").agg(F.sum("live").alias("_r"))
    shared = a.where("pa AND live > 0").select("plot", "pred", "ref", F.col("live").alias("shared"))
    return shared.join(preds, ["plot", "pred"]).join(refs, ["plot", "ref"]).select(
        "plot", "pred", "ref", "shared", (F.col("_p") + F.col("_r") - F.col("shared")).alias("whole")
    )


def maximum_matching(scores: dict[int, list[tuple[int, float]]]) -> list[tuple[int, int]]:
    """A largest one-to-one matching by augmenting paths.

    Predictions come by falling best score, then id; their candidates by falling score, then id.
    """
    wanted = {p: [r for r, _ in sorted(c, key=lambda x: (-x[1], x[0]))] for p, c in scores.items()}
    owner: dict[int, int] = {}
    for first in sorted(scores, key=lambda p: (-max(s for _, s in scores[p]), p)):
        # Depth first, with a stack of (prediction, its remaining candidates).
        seen, path, trail = set(), [(first, iter(wanted[first]))], []
        while path:
            p, rest = path[-1]
            for r in rest:
                if r not in seen:
                    seen.add(r)
                    trail.append((p, r))
                    if r not in owner:
                        path = []
                        owner.update({ref: pred for pred, ref in trail})
                    else:
                        path.append((owner[r], iter(wanted[owner[r]])))
                    break
            else:
                path.pop()
                if trail:
                    trail.pop()
    return sorted((p, r) for r, p in owner.items())


def matches(points: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A largest one-to-one matching of the pairs whose IoU is at least the threshold (plot, pred, ref, iou).

    From a threshold of one half on, several pairs of a prediction are all exactly one
    half, and each of their references has no other pair (and the other way round), so
    the first pair in order of score and id is a largest matching; that is decided by
    windows. Below it, augmenting paths go through the connected parts of the graph of pairs.
    """
    return _matches(active(points), threshold)


def _matches(a: DataFrame, threshold: float) -> DataFrame:
    p = _overlaps(a).where(F.col("shared") >= F.lit(threshold) * F.col("whole")).withColumn("iou", F.col("shared") / F.col("whole"))
    if threshold >= 0.5:
        first = lambda own, other: F.row_number().over(Window.partitionBy("plot", own).orderBy(F.desc("iou"), other))
        ordered = p.withColumns({"_a": first("pred", "ref"), "_b": first("ref", "pred")})
        return ordered.where("_a = 1 AND _b = 1").select(*[F.col(c).cast("long").alias(c) for c in ("plot", "pred", "ref")], "iou")
    return _matched_by_component(staged(p.select(*[F.col(c).cast("long").alias(c) for c in ("plot", "pred", "ref")], "iou"), "pairs"))


def _matched_by_component(pairs: DataFrame) -> DataFrame:
    """A largest matching of (plot, pred, ref, iou), connected part by connected part.

    A pair that is the only one of both its sides is a match. The others are cut into
    connected parts first; a part, not a plot, is what a task holds. From a threshold t
    on, no instance has more than 1 / t partners, so parts are small beside plots.
    Parts have no pair between them, so what is found does not depend on the cut.
    """
    ship(pairs.sparkSession)
    by_pred = pairs.groupBy("plot", "pred").agg(F.count("*").alias("_dp"))
    by_ref = pairs.groupBy("plot", "ref").agg(F.count("*").alias("_dr"))
    degrees = pairs.join(by_pred, ["plot", "pred"]).join(by_ref, ["plot", "ref"])
    alone = (F.col("_dp") == 1) & (F.col("_dr") == 1)
    tied = staged(degrees.where(~alone).select("plot", "pred", "ref", "iou"), "tied")
    side = lambda kind, c: F.struct("plot", F.lit(kind).alias("kind"), F.col(c).alias("id"))
    roots = components(tied.select(side(0, "pred").alias("a"), side(1, "ref").alias("b")))
    # Parts are many and small, so a group is those whose roots share a hash, about GROUP_ROWS rows whatever the table.
    groups = -(-tied.count() // GROUP_ROWS) or 1
    parts = tied.withColumn("node", side(0, "pred")).join(roots, "node")
    parts = parts.select(F.pmod(F.xxhash64("root"), F.lit(groups)).alias("root"), "root.kind", "root.id", "plot", "pred", "ref", "iou")
    solved = parts.groupBy("root").applyInPandas(_match_parts, "plot long, pred long, ref long, iou double")
    return degrees.where(alone).select("plot", "pred", "ref", "iou").unionByName(solved)


#: About how many pairs are matched in one call.
GROUP_ROWS = 20_000


def _match_parts(frame: pd.DataFrame) -> pd.DataFrame:
    """The matches of rows (plot, kind, id, pred, ref, iou), each connected part (plot, kind, id) by itself."""
    parts: dict[tuple[int, int, int], dict[int, list[tuple[int, float]]]] = {}
    iou = {}
    for plot, kind, node, pred, ref, value in zip(*[frame[c].tolist() for c in ("plot", "kind", "id", "pred", "ref", "iou")], strict=True):
        parts.setdefault((plot, kind, node), {}).setdefault(pred, []).append((ref, value))
        iou[plot, pred, ref] = value
    found = [(part[0], p, r, iou[part[0], p, r]) for part, scores in parts.items() for p, r in maximum_matching(scores)]
    return pd.DataFrame(found, columns=["plot", "pred", "ref", "iou"]).astype({"plot": "int64", "pred": "int64", "ref": "int64", "iou": "float64"})


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [ratio(tp, tp + fp, 6).alias("precision"), ratio(tp, tp + fn, 6).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn, 6).alias("f1")]


def plot_scores(points: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row a plot: points, instances, true and false positives, false negatives, precision, recall, F1, matched IoU."""
    counts = staged(counted(points), "counts")
    a = _active(counts)
    sizes = a.groupBy("plot").agg(
        F.sum("n").alias("points"), F.sum(F.when(F.col("pa"), F.col("n")).otherwise(F.col("live"))).alias("evaluated"),
        F.countDistinct(F.when(F.col("pa"), F.col("pred"))).alias("predicted"), F.countDistinct(F.when(F.col("live") > 0, F.col("ref"))).alias("referenced"),
    )
    out = _excluded(counts).groupBy("plot").agg(F.count("*").alias("excluded"))
    found = _matches(a, threshold).groupBy("plot").agg(
        F.count("*").alias("tp"), F.avg("iou").alias("_mean"), F.median("iou").alias("_median")
    )
    s = sizes.join(out, "plot", "left").join(found, "plot", "left").na.fill(0, ["excluded", "tp", "_mean", "_median"])
    s = s.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("referenced") - F.col("tp")})
    return s.select(
        "plot", "points", "evaluated", "predicted", "referenced", "excluded", "tp", "fp", "fn",
        *prf(F.col("tp"), F.col("fp"), F.col("fn")), F.round("_mean", 6).alias("mean_iou"), F.round("_median", 6).alias("median_iou"),
    )


def aggregated(scores: DataFrame, levels: list[list[str]]) -> DataFrame:
    """Micro scores (ratios of sums) and means and medians over plots, at each level, in one pass over grouping sets."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    over = [F.count("*").alias("plots"), F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.median("f1"), 6).alias("median_f1")]
    made = scores.groupingSets([[F.col(k) for k in level] for level in levels], *keys).agg(*sums, *over)
    return made.select(*keys, "plots", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")), "mean_f1", "median_f1")


def variant_pairs(scores: DataFrame, key: list[str], variants: list[str], value: str = "f1") -> DataFrame:
    """A row a key: the value of each variant, and the second's gain over the first."""
    wide = scores.groupBy(*key).pivot("variant", variants).agg(F.first(value))
    return wide.withColumn("gain", F.round(F.col(variants[1]) - F.col(variants[0]), 6))


def differing(stored: DataFrame, made: DataFrame) -> DataFrame:
    """One row: rows that only one of two tables has; both 0 means that they are equal."""
    count = lambda a, b, name: a.exceptAll(b.select(*a.columns)).agg(F.count("*").alias(name))
    return count(stored, made, "only_stored").crossJoin(F.broadcast(count(made, stored, "only_made")))


def dense_index(df: DataFrame, index: str) -> DataFrame:
    """Whether an index is exactly 0 to n - 1."""
    return df.agg(
        F.count("*").alias("n"), ((F.min(index) == 0) & (F.max(index) == F.count("*") - 1) & (F.countDistinct(index) == F.count("*"))).alias("dense")
    )
