"""The log as Structured Streaming: windowed usage, and an append sink that a repeated batch doesn't fill twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def usage(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """event_type, start, n and value of each window; rows later than ``late`` behind the newest event are left out of closed windows."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("event_type", F.col("w.start").alias("start"), "n", "value")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Events without repeated sends of the same id; ids are remembered for ``late`` of event time."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def append(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that is there now to a log kept as Parquet, laid out by event type. Each batch has its own folder, which a repetition of it replaces."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("event_type").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
