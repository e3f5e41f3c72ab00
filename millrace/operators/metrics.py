"""Metrics of predictions: regression, ranking, classification, calibration. All are aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import ratio
from millrace.operators.ranking import average_ranked, top_of
from millrace.session import staged

EPSILON = 2.220446049250313e-16  # of a double
MAX_RELEVANCE = 50.0


def point_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """MAE, RMSE and R2 (0 for constant targets) of (actual, predicted)."""
    a, p = F.col("actual"), F.col("predicted")
    error = a - p
    spread = F.sum(a * a) - F.sum(a) * F.sum(a) / F.count("*")
    left = F.when(F.abs(spread) > 1e-12 * F.greatest(F.sum(a * a), F.lit(1.0)), 1 - F.sum(error * error) / spread)
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.coalesce(left, F.lit(0.0)).alias("r2"),
    )


def _pearson(x: Column, y: Column) -> Column:
    """From moments, 0 for a constant side (corr() would raise there)."""
    n = F.count("*")
    cov = F.sum(x * y) - F.sum(x) * F.sum(y) / n
    vx, vy = F.sum(x * x) - F.sum(x) * F.sum(x) / n, F.sum(y * y) - F.sum(y) * F.sum(y) / n
    root = F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
    return F.coalesce(F.try_divide(cov, F.when(root > 1e-12, root)), F.lit(0.0))


def spearman(df: DataFrame, by: list[str]) -> DataFrame:
    """Pearson's coefficient of average ranks in each group; a group with all rows is ranked by many tasks."""
    needed = df.select(*by, "actual", "predicted")
    ranks = average_ranked(average_ranked(needed, by, "actual", "_ra"), by, "predicted", "_rp")
    return ranks.groupBy(*by).agg(_pearson(F.col("_ra"), F.col("_rp")).alias("spearman"))


def _relevance() -> Column:
    return F.least(F.greatest(F.col("actual"), F.lit(0.0)), F.lit(MAX_RELEVANCE))


def _discounted(df: DataFrame, by: list[str], k: int, first: str, entity: str, name: str) -> DataFrame:
    """The discounted gain of the first k rows of each group, by falling `first`, then entity."""
    gain = F.pow(F.lit(2.0), F.col("actual")) - 1
    top = top_of(df, by, [F.desc(first), F.col(entity)], k, "_place")
    return top.groupBy(*by).agg(F.sum(gain / F.log2(F.col("_place") + 1.0)).alias(name))


def ndcg(df: DataFrame, by: list[str], k: int = 10, entity: str = "entity") -> DataFrame:
    """Gain 2^relevance - 1 with relevance cut to [0, 50], discount log2(place + 1), k at most the group's size."""
    cut = df.select(*by, entity, "predicted", _relevance().alias("actual"))
    both = _discounted(cut, by, k, "predicted", entity, "_own").join(_discounted(cut, by, k, "actual", entity, "_best"), by)
    return both.select(*by, ratio(F.col("_own"), F.col("_best")).alias("ndcg"))


def topk_overlap(df: DataFrame, by: list[str], k: int = 10, entity: str = "entity") -> DataFrame:
    """Share of the k highest actual values that are among the k highest predictions.

    The last of the k highest actual values of a group, with its entity, tells whether a row is among them.
    """
    narrow = df.select(*by, entity, "actual", "predicted")
    actual = top_of(narrow, by, [F.desc("actual"), F.col(entity)], k, "_place")
    last = actual.groupBy(*by).agg(F.count("*").alias("_top"), F.max_by(F.struct(F.col("actual").alias("a"), F.col(entity).alias("e")), "_place").alias("_last"))
    predicted = top_of(narrow, by, [F.desc("predicted"), F.col(entity)], k, "_place").join(last, by)
    both = (F.col("actual") > F.col("_last.a")) | ((F.col("actual") == F.col("_last.a")) & (F.col(entity) <= F.col("_last.e")))
    return predicted.groupBy(*by).agg(ratio(F.sum(both.cast("int")), F.max("_top")).alias("overlap"))


def metric_bundle(df: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """Point metrics over all rows, and unweighted means over groups of the ranking metrics; the rows are made once."""
    df = staged(df.select(*by, "entity", "actual", "predicted"), "predictions")
    ranking = spearman(df, by).join(ndcg(df, by, k), by).join(topk_overlap(df, by, k), by)
    means = ranking.agg(F.avg("spearman").alias("spearman"), F.avg("ndcg").alias("ndcg"), F.avg("overlap").alias("overlap"))
    return point_metrics(df).crossJoin(F.broadcast(means))  # one row each


def confusion_matrix(df: DataFrame, labels: list) -> DataFrame:
    """A row for each actual label that occurs, a column `predicted_<label>` for each label."""
    counts = df.groupBy("actual").pivot("predicted", labels).agg(F.count(F.lit(1)))
    return counts.select("actual", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).cast("long").alias(f"predicted_{k}") for k in labels])


def class_counts(df: DataFrame, labels: list) -> DataFrame:
    """True positives, predictions and support of each label, also of those that do not occur."""
    every = df.sparkSession.createDataFrame([(k,) for k in labels], "label int")
    return F.broadcast(every).join(sides(df, "actual", "predicted", "label"), "label", "left").na.fill(0, ["tp", "predicted", "support"])


def sides(df: DataFrame, actual: str, predicted: str, label: str) -> DataFrame:
    """tp, predicted and support of each label that occurs on either side: one pass, by the counts of pairs of labels."""
    pairs = df.groupBy(F.col(actual).alias("_a"), F.col(predicted).alias("_p")).agg(F.count("*").alias("_n"))
    none = F.lit(0).cast("long")
    both = F.array(
        F.struct(F.col("_a").alias("label"), F.when(F.col("_a") == F.col("_p"), F.col("_n")).otherwise(none).alias("tp"), none.alias("predicted"), F.col("_n").alias("support")),
        F.struct(F.col("_p").alias("label"), none.alias("tp"), F.col("_n").alias("predicted"), none.alias("support")),
    )
    each = pairs.select(F.explode(both).alias("s")).where(F.col("s.label").isNotNull())
    return each.groupBy(F.col("s.label").alias(label)).agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "predicted", "support")])


def class_prf(df: DataFrame, labels: list) -> DataFrame:
    """Precision, recall and F1 of each label; 0 where they are not defined."""
    c = class_counts(df, labels)
    return c.select(
        "label", "support", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
    )


def classifier_summary(df: DataFrame, labels: list) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted F1, and Matthews' coefficient of many classes."""
    c = class_counts(df, labels)
    f1 = ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support"))
    s, p, t = F.sum("support").cast("double"), F.col("predicted").cast("double"), F.col("support").cast("double")
    hit = F.sum("tp").cast("double")
    root = F.sqrt((s * s - F.sum(p * p)) * (s * s - F.sum(t * t)))
    return c.agg(
        F.sum("support").alias("n"), ratio(hit, s).alias("accuracy"), F.avg(recall).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"),
        ratio(F.sum(f1 * t), s).alias("weighted_f1"), ratio(hit * s - F.sum(p * t), root).alias("mcc"),
    )


def softmax(scores: str) -> Column:
    """Probabilities from an array of scores."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def argmax(probabilities: str) -> Column:
    """The place, from 0, of the first maximum."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def log_loss_brier(df: DataFrame) -> DataFrame:
    """Log loss (probabilities cut at the rounding of a double) and the Brier score over all classes, of (actual from 0, probabilities)."""
    own = F.element_at("probabilities", (F.col("actual") + 1).cast("int"))
    cut = F.least(F.greatest(own, F.lit(EPSILON)), F.lit(1 - EPSILON))
    square = F.aggregate(
        F.transform("probabilities", lambda p, i: F.pow(p - F.when(i == F.col("actual"), 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, b: a + b
    )
    return df.agg(F.count("*").alias("n"), (-F.avg(F.ln(cut))).alias("log_loss"), F.avg(square).alias("brier"))


def ece_bins(df: DataFrame, bins: int = 15) -> DataFrame:
    """Bins (low, high] of confidence with their accuracy and mean confidence; a confidence of 0 is in none.

    The edges are the numbers k / bins themselves: rounding up confidence * bins could differ at an edge.
    """
    edges = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    place = F.size(F.filter(edges, lambda e: e < F.col("confidence")))
    return (
        df.where((F.col("confidence") > 0) & (F.col("confidence") <= 1))
        .groupBy(place.alias("bin"))
        .agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("confidence").alias("confidence"))
    )


def ece(df: DataFrame, bins: int = 15) -> DataFrame:
    n = df.agg(F.count("*").alias("_all"))
    gap = F.col("n") / F.col("_all") * F.abs(F.col("accuracy") - F.col("confidence"))
    return ece_bins(df, bins).crossJoin(F.broadcast(n)).agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("ece"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows over classes times the class's rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))
    return counts.crossJoin(F.broadcast(whole)).select(label, "n", (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"))
