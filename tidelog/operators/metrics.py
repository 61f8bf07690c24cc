"""Usage figures: consumption and publishing KPIs, lags, statistics, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, seconds: int, by: list[str], size: Column) -> DataFrame:
    """Events and bytes of each window of ``seconds`` and group: summed before the shuffle."""
    start = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)) * seconds).cast("long")
    return events.groupBy(start.alias("window_start"), *by).agg(F.count(F.lit(1)).alias("n_events"), F.sum(size).cast("long").alias("n_bytes"))


def unconsumed(stats: DataFrame, committed: DataFrame) -> DataFrame:
    """Events behind each partition's commit; null without one."""
    return stats.join(F.broadcast(committed), "partition", "left").withColumn("unconsumed", F.col("last") - F.col("committed"))


def next_event_lag(log: DataFrame, committed: DataFrame, as_of: Column) -> DataFrame:
    """Whole seconds since the first event after each commit; 0 at the tail.

    The commits are metadata and broadcast; the events behind them are aggregated where they are read.
    """
    behind = log.join(F.broadcast(committed), "partition").where("offset > committed")
    nearest = behind.groupBy("partition").agg(F.min_by("ts", "offset").alias("next_ts"))
    seconds = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("next_ts").cast("timestamp"))) / 1_000_000).cast("long")
    return committed.join(nearest, "partition", "left").select("partition", F.coalesce(seconds, F.lit(0)).cast("long").alias("lag_seconds"))


def publishing_sizes(events: DataFrame, batch: Column, size: Column) -> DataFrame:
    """Per batch: events, bytes as sent (with brackets and commas), and the average size, a whole number."""
    grouped = events.groupBy(batch.alias("batch_id")).agg(F.count(F.lit(1)).alias("n_events"), F.sum(size).cast("long").alias("event_bytes"))
    total = F.col("event_bytes") + F.col("n_events") + 1
    return grouped.select("batch_id", "n_events", total.alias("batch_bytes"), F.floor((total - F.col("n_events") - 1) / F.col("n_events")).cast("long").alias("avg_bytes"))


def duplicates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Groups with more than one row."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def order_violations(results: DataFrame, by: list[str], order: str, failed: Column) -> DataFrame:
    """Successful records that follow a failed one of the same key: behind the first failure, which is an aggregate."""
    first = results.where(failed).groupBy(*by).agg(F.min(order).alias("_first"))
    return results.where(~failed).join(first, by).where(F.col(order) > F.col("_first")).drop("_first")


def variance(log: DataFrame) -> DataFrame:
    """How unevenly events lie over partitions: the population variance of their counts."""
    return log.groupBy("partition").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.var_pop("n"), 3).alias("spread"))


def change_records(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Data-change records between two snapshots: op C, U or D with the content before and after."""
    a, b = old.select(key, F.col(content).alias("before")), new.select(key, F.col(content).alias("after"))
    op = F.when(F.col("before").isNull(), "C").when(F.col("after").isNull(), "D").when(F.col("before") != F.col("after"), "U")
    return a.join(b, key, "full").withColumn("data_op", op).where("data_op is not null")
