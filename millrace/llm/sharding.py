"""Sharding by bytes: contiguous shards of near equal size, in native DataFrame operations.

Rows are put in order of their ids, range partition by range partition. Each
partition's total gives, summed over the partitions before it, the global place
where it begins; a window within the partition does the rest. A row goes to the
shard in which the middle of its bytes falls when all bytes are cut at equal
targets. Only ids, sizes and checksums are shuffled, never texts.

Cases: a null text has no bytes, so its row has the size of the fixed 16 bytes a
row, and checksum 0. Rows with a null id come first; rows with equal ids stay
beside each other, in the order of size, checksum and a fixed draw. An empty
table gives no rows. A row larger than a shard's target leaves the shards that it
spans empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import staged

SHARDS = 40
#: What each row takes beside its text.
ROW_BYTES = 16


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, size and text_crc32 of documents (doc_id, text)."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return documents.select(
        "doc_id", (F.octet_length(data) + ROW_BYTES).cast("long").alias("size"), F.crc32(data).alias("text_crc32")
    )


def by_bytes(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds shard (int) and slot (long, from 0 in each shard) to rows with doc_id, size and text_crc32."""
    columns = rows.columns
    own = ["doc_id", "size", "text_crc32", "_draw"]
    # Written once: the ranges and draws that the totals come from are those that the rows keep.
    placed = staged(
        rows.withColumn("_draw", F.rand(0)).repartitionByRange(*own).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    totals = placed.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    starts = totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    here = Window.partitionBy("_range").orderBy(*own)
    middle = F.col("_bytes_before") + F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.expr("size div 2")
    shard = F.least(F.floor(middle.cast("decimal(38,0)") * shards / F.col("_all")).cast("int"), F.lit(shards - 1))
    cut = placed.join(F.broadcast(starts), "_range").withColumns(
        {"shard": shard, "_place": F.col("_rows_before") + F.row_number().over(here) - 1}
    )
    firsts = cut.groupBy("shard").agg(F.min("_place").alias("_first"))  # one row a shard
    return cut.join(F.broadcast(firsts), "shard").select(*columns, "shard", (F.col("_place") - F.col("_first")).alias("slot"))
