"""Global numbering and ranks that no single task has to count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import staged


def numbered(df: DataFrame, by: list[str], name: str = "index", start: int = 0) -> DataFrame:
    """Adds the place of each row in the order of `by`, from `start`: range partitions count, their totals are summed up."""
    placed = staged(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return placed.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_before") + here - 1 + start).cast("long")).select(*df.columns, name)


def hash_ranked(df: DataFrame, by: list[str], digest: Column, name: str = "rank") -> DataFrame:
    """Adds each row's rank (from 0) within `by` in the order of a hexadecimal digest.

    The first two digits cut every group into 256 parts, so a group that holds most
    rows is counted by many tasks.
    """
    cut = df.withColumn("_digest", digest).withColumn("_part", F.substring("_digest", 1, 2))
    parts = cut.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    here = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_digest"))
    return cut.withColumn("_here", here).join(starts, [*by, "_part"]).withColumn(name, F.col("_before") + F.col("_here") - 1).select(*df.columns, name)


#: About how many rows a range has, so that what sorts a range needs the same memory whatever the size of the table.
RANGE_ROWS = 1 << 19


def ranges(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """`df` in the order of `by` and `value`, cut into ranges (_range) of which one value, however common, may fill several."""
    salted = df.withColumn("_salt", F.rand(0))
    parallel = df.sparkSession.sparkContext.defaultParallelism
    return staged(salted.repartitionByRange(max(parallel, -(-df.count() // RANGE_ROWS)), *by, value, "_salt").withColumn("_range", F.spark_partition_id()).drop("_salt"), "ranges")


def average_ranked(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds the rank of `value` within `by`, from 1 in ascending order, ties sharing the mean of their places.

    Rows are put in order over range partitions, so a group, or a value, with most of the rows
    is spread over many tasks. Each range counts what is less and what is equal within it; only
    a range's first and last value of a group can go on in other ranges, and those, of groups
    in more than one range, are added up over the ranges: a few rows a range, whatever the
    number of groups. Rows whose value is null get no rank and count for none.
    """
    placed = ranges(df, by, value)
    here = ["_range", *by]
    group = Window.partitionBy(*by)
    counts = placed.where(F.col(value).isNotNull()).groupBy(*here, F.col(value).alias("_v")).agg(F.count("*").alias("_equal"))
    entry = F.struct("_v", "_equal")
    sizes = counts.groupBy(*here).agg(F.sum("_equal").alias("_n"), F.min(entry).alias("_low"), F.max(entry).alias("_high"))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spanning = staged(sizes.withColumns({"_spans": F.count("*").over(group), "_before": before}).where("_spans > 1"), "spans")

    # The first and last value of each range of such a group: how often it is in all ranges, and how many rows are less.
    lowest = F.struct(F.col("_low._v").alias("v"), F.col("_low._equal").alias("equal"), F.col("_before").alias("less"))
    highest = F.struct(F.col("_high._v").alias("v"), F.col("_high._equal").alias("equal"), (F.col("_before") + F.col("_n") - F.col("_high._equal")).alias("less"))
    ends = spanning.select(*here, F.explode(F.array_distinct(F.array(lowest, highest))).alias("_end")).select(*here, "_end.*")
    ties = Window.partitionBy(*by, "v")
    known = ends.select(
        *[F.col(c).alias(f"_e_{c}") for c in here], F.col("v").alias("_v"), F.sum("equal").over(ties).alias("_all_equal"), F.min("less").over(ties).alias("_all_less")
    )
    starts = spanning.select(*[F.col(c).alias(f"_s_{c}") for c in here], F.col("_before").alias("_start"))

    there = F.col(value).isNotNull()
    ranked = placed.withColumns({
        "_less": F.rank().over(Window.partitionBy(*here).orderBy(F.col(value).asc_nulls_last())) - 1,
        "_equal": F.count("*").over(Window.partitionBy(*here, value)),
    })
    same = lambda side: [F.col(c).eqNullSafe(F.col(f"_{side}_{c}")) for c in here]
    met = ranked.join(F.broadcast(starts), same("s"), "left").join(F.broadcast(known), [*same("e"), F.col(value) == F.col("_v")], "left")
    less = F.coalesce("_all_less", F.coalesce("_start", F.lit(0)) + F.col("_less"))
    return met.select(*df.columns, F.when(there, less + (F.coalesce("_all_equal", F.col("_equal")) + 1) / 2).alias(name))


def top_of(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows of each group in an order, with their place from 1.

    The limit on row_number() is applied before the shuffle as well (a limit by group in each
    task), so no task receives more than k rows of a group from another one.
    """
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
