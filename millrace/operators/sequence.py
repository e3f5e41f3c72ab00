"""Tagged token sequences: spans, their metrics, vocabularies and encoding.

Rows are (sentence, position, token, tag); a tag is O, B-x or I-x.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.scalar import flag, ratio, whole_match
from millrace.operators.metrics import sides
from millrace.operators.ranking import numbered

PAD, UNK = "<pad>", "<unk>"


def malformed(tokens: DataFrame, tag: str = "tag") -> DataFrame:
    """Rows whose tag is none of O, B-x, I-x."""
    return tokens.where(F.col(tag).isNull() | ~whole_match(F.col(tag), "O|[BI]-.+"))


def spans(tokens: DataFrame, sentence: list[str], tag: str = "tag") -> DataFrame:
    """Spans (label, start, end), half open. An I- after another label or after O opens a span, like a B-."""
    w = Window.partitionBy(*sentence).orderBy("position")
    label = F.when(F.col(tag) != "O", F.expr(f"substring({tag}, 3)"))
    inside = F.col(tag).startswith("I-") & label.eqNullSafe(F.lag(label).over(w))
    opened = tokens.withColumns({"_label": label, "_opens": flag(label.isNotNull() & ~inside)})
    numbered_ = opened.withColumn("_span", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered_.where(F.col("_label").isNotNull())
        .groupBy(*sentence, "_span")
        .agg(F.first("_label").alias("label"), F.min("position").alias("start"), (F.max("position") + 1).alias("end"))
        .drop("_span")
    )


def span_metrics(expected: DataFrame, predicted: DataFrame, sentence: list[str]) -> DataFrame:
    """Exact spans in both, in one only, and precision, recall and F1 by label."""
    key = [*sentence, "label", "start", "end"]
    both = expected.select(*key, F.lit(1).alias("e")).join(predicted.select(*key, F.lit(1).alias("p")), key, "full")
    c = both.groupBy("label").agg(
        F.sum(flag(F.col("e").isNotNull() & F.col("p").isNotNull())).alias("tp"),
        F.sum(flag(F.col("e").isNull())).alias("fp"), F.sum(flag(F.col("p").isNull())).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", ratio(tp, tp + fp, 6).alias("precision"), ratio(tp, tp + fn, 6).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn, 6).alias("f1"))


def token_metrics(tokens: DataFrame, expected: str = "tag", predicted: str = "predicted") -> DataFrame:
    """Accuracy, macro F1 and support-weighted F1 over the tags that occur on either side."""
    c = sides(tokens, expected, predicted, "tag")
    f1 = ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    return c.agg(
        F.sum("support").alias("n"), ratio(F.sum("tp"), F.sum("support"), 6).alias("accuracy"), F.round(F.avg(f1), 6).alias("macro_f1"),
        ratio(F.sum(f1 * F.col("support")), F.sum("support"), 6).alias("weighted_f1"),
    )


def vocabulary(tokens: DataFrame, specials: tuple[str, ...] = (PAD, UNK)) -> DataFrame:
    """(value, index): the specials, then the lower-cased tokens in order. Give it training tokens only."""
    values = tokens.select(F.lower("token").alias("value")).where(~F.col("value").isin(*specials)).distinct()
    head = tokens.sparkSession.createDataFrame([(v, i) for i, v in enumerate(specials)], "value string, index long")
    return head.unionByName(numbered(values, ["value"], "index", len(specials)))


def encoded(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds token_id: the index of the lower-cased token, or that of the unknown one."""
    unknown = vocab.where(F.col("value") == UNK).select(F.col("index").alias("_unknown"))  # one row
    own = vocab.select(F.col("value").alias("_value"), F.col("index").alias("_index"))
    joined = tokens.join(own, F.lower("token") == F.col("_value"), "left").crossJoin(F.broadcast(unknown))
    return joined.select(*tokens.columns, F.coalesce("_index", "_unknown").alias("token_id"))


def padded(encodings: DataFrame, sentence: list[str], length: int | None = None, pad: int = 0) -> DataFrame:
    """Arrays of ids and of a mask, 1 where there is a token, as long as the longest sentence.

    Where `length` is given, arrays of that length; a longer sentence is an error.
    """
    ids = F.transform(F.sort_array(F.collect_list(F.struct("position", "token_id"))), lambda s: s["token_id"])
    own = encodings.groupBy(*sentence).agg(ids.alias("ids"))
    if length is None:
        longest = encodings.groupBy(*sentence).agg(F.count("*").alias("n")).agg(F.max("n").cast("int").alias("_longest"))  # one row
        own = own.crossJoin(F.broadcast(longest))
    room = (F.col("_longest") if length is None else F.lit(length)) - F.size("ids")
    if length is not None:
        room = F.when(room >= 0, room).otherwise(F.raise_error(F.concat(F.lit(f"a sentence is longer than {length}: "), F.size("ids").cast("string"))).cast("int"))
    return own.select(
        *sentence, F.concat("ids", F.array_repeat(F.lit(pad).cast("long"), room)).alias("ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), room)).alias("mask"),
    )


def length_guard(tokens: DataFrame, sentence: list[str], limit: int) -> DataFrame:
    """Sentences that are longer than the limit."""
    return tokens.groupBy(*sentence).agg(F.count("*").alias("length")).where(F.col("length") > limit)


def first_best(history: DataFrame, score: str, epoch: str = "epoch") -> DataFrame:
    """The first epoch with the highest score, and whether epochs run from 1 without a gap."""
    best = F.min(F.struct((-F.col(score)).alias("minus"), F.col(epoch).alias("epoch")))
    return history.agg(
        best["epoch"].alias("best_epoch"), (-best["minus"]).alias("best_score"),
        ((F.min(epoch) == 1) & (F.max(epoch) == F.count("*")) & (F.countDistinct(epoch) == F.count("*"))).alias("consecutive"),
    )


def early_stop(history: DataFrame, run: list[str], score: str, patience: int, epoch: str = "epoch") -> DataFrame:
    """A row a run: the epoch after which it stops, since `patience` epochs in a row were no better than the best, and the best one until then.

    A run that never waits so long stops after its last epoch. Epochs run from 1 without a gap.
    """
    w = Window.partitionBy(*run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct(F.col(score), (-F.col(epoch)).alias("minus"))).over(w)
    seen = history.withColumn("_best", best).withColumn("_waited", F.col(epoch) + F.col("_best.minus"))
    end = F.struct(F.col(epoch).alias("at"), (-F.col("_best.minus")).alias("best"))
    last = F.coalesce(F.min(F.when(F.col("_waited") >= patience, end)), F.max(end))
    return seen.groupBy(*run).agg(last["at"].alias("stopped"), last["best"].alias("best_epoch"))
