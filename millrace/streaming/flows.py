"""The panel's and the batches' operators over streams: an extension, with the same results as the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_panel(events: DataFrame, late: str = "2 days", period: str = "2 days") -> DataFrame:
    """Sums of points by entity and tumbling period; rows later than the watermark are left out.

    events: ts (timestamp), entity, points. Rows come out once their period is closed.
    """
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", period).alias("w"), "entity")
        .agg(F.sum("points").alias("points"), F.count("*").alias("minutes"))
        .select("entity", F.col("w.start").alias("start"), "points", "minutes")
    )


def first_batches(batches: DataFrame, late: str = "1 day") -> DataFrame:
    """Each idempotency key once, however often a batch is offered within the watermark."""
    return batches.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["idempotency_key"])
