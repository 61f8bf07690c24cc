"""Positions in a log of timelines: order, distance, shift, lag, validation and listings.

A cursor is (partition, c_order, c_offset). Its global position is the rows of
the timelines before plus its offset. The last offset of a timeline and -1 of
the next have the same position, so comparing and measuring are plain numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def locate(cursors: DataFrame, lines: DataFrame, order: str = "c_order", offset: str = "c_offset", name: str = "position") -> DataFrame:
    """``cursors`` with the global position of their order and offset columns (null for unknown timelines)."""
    starts = lines.select("partition", F.col("tl_order").alias(order), F.col("start").alias("_start"))
    return cursors.join(F.broadcast(starts), ["partition", order], "left").withColumn(name, F.col("_start") + F.col(offset)).drop("_start")


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two positions."""
    return F.signum(a - b).cast("int")


def place(positions: DataFrame, lines: DataFrame, forward: Column) -> DataFrame:
    """c_order and c_offset of a column ``position``, and an error for one before the beginning.

    A border between timelines is the end of the earlier one if it was reached ``forward``, else the beginning of the later one.
    """
    ends = lines.withColumn("_from", F.col("start") - 1).withColumn("_to", F.col("start") + F.col("size") - 1)
    # open timelines take all later positions
    fits = (positions["partition"] == ends["partition"]) & F.when(
        forward, ((F.col("position") > F.col("_from")) | ((F.col("position") == -1) & (F.col("tl_order") == 1))) & ((F.col("position") <= F.col("_to")) | F.col("is_open"))
    ).otherwise((F.col("position") >= F.col("_from")) & ((F.col("position") < F.col("_to")) | F.col("is_open")) & (F.col("size") > 0))
    found = positions.join(F.broadcast(ends), fits, "left").select(
        *[positions[c] for c in positions.columns], "tl_order", (F.col("position") - F.col("start")).alias("tl_offset")
    )
    return found.withColumn("error", F.when(F.col("position") < -1, F.lit("UNAVAILABLE")))


def roll_forward(cursors: DataFrame, lines: DataFrame) -> DataFrame:
    """Cursors at the end of a closed timeline moved to -1 of the next one that holds events or is open."""
    closed = lines.where(~F.col("is_open"))
    ends = closed.select("partition", F.col("tl_order").alias("c_order"), F.col("last_offset").alias("_last"))
    later = lines.where("size > 0 or is_open").select("partition", F.col("tl_order").alias("_next"))
    following = closed.select("partition", F.col("tl_order").alias("c_order")).join(later, "partition").where("_next > c_order").groupBy("partition", "c_order").agg(F.min("_next").alias("_next"))
    at_end = F.col("c_offset") == F.col("_last")
    return (
        cursors.join(F.broadcast(ends), ["partition", "c_order"], "left").join(F.broadcast(following), ["partition", "c_order"], "left")
        .withColumn("r_order", F.when(at_end, F.col("_next")).otherwise(F.col("c_order")))
        .withColumn("r_offset", F.when(at_end, F.lit(-1)).otherwise(F.col("c_offset")).cast("long")).drop("_last", "_next")
    )


def statistics(log: DataFrame, by: list[str], offset: str = "offset") -> DataFrame:
    """first, last and before_first of each group: aggregated before the shuffle, and from file statistics where there are any."""
    return log.groupBy(*by).agg(F.min(offset).alias("first"), F.max(offset).alias("last")).withColumn("before_first", F.col("first") - 1)


def validate(cursors: DataFrame, stats: DataFrame) -> DataFrame:
    """``cursors`` (partition and offset, both maybe null) with the error of each, or null."""
    known = stats.select(F.col("partition").alias("_p"), "before_first", "last")
    error = (
        F.when(F.col("partition").isNull(), "NULL_PARTITION").when(F.col("_p").isNull(), "PARTITION_NOT_FOUND").when(F.col("c_offset").isNull(), "NULL_OFFSET")
        .when((F.col("c_offset") < F.col("before_first")) | (F.col("c_offset") > F.col("last")), "UNAVAILABLE")
    )
    return cursors.join(F.broadcast(known), F.col("partition") == F.col("_p"), "left").withColumn("error", error).drop("_p", "before_first", "last")


def listing(lines: DataFrame) -> DataFrame:
    """Oldest and newest cursor of each partition. The newest is the last of the latest timeline that holds events."""
    full = lines.where("size > 0")
    newest = full.groupBy("partition").agg(F.max_by(F.struct("tl_order", "last_offset"), "tl_order").alias("n"))
    oldest = lines.groupBy("partition").agg(F.min("tl_order").alias("o"))
    return oldest.join(newest, "partition", "left").select(
        "partition", scalars.cursor_text(F.col("o"), F.lit(0).cast("long")).alias("oldest"), scalars.cursor_text(F.col("n.tl_order"), F.col("n.last_offset")).alias("newest")
    )


def lag(cursors: DataFrame, lines: DataFrame) -> DataFrame:
    """partition, newest cursor, and unconsumed events behind each cursor."""
    ends = lines.groupBy("partition").agg((F.sum("size") - 1).alias("_end"))
    located = locate(cursors, lines).join(F.broadcast(ends), "partition").join(F.broadcast(listing(lines)), "partition")
    return located.withColumn("unconsumed", F.col("_end") - F.col("position")).drop("_end")


def compact(log: DataFrame, as_of: Column, min_lag_days: int) -> DataFrame:
    """The newest record of each key; of keys whose newest is a tombstone, none once it is older than the lag."""
    newest = log.groupBy("partition", "key").agg(F.max_by(F.struct(*log.columns), "offset").alias("_newest"))
    kept = newest.select("_newest.*")
    return kept.where(F.col("value").isNotNull() | (F.col("ts") >= as_of - F.expr(f"INTERVAL {min_lag_days} DAYS")))


def retain(log: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Records not older than the retention."""
    return log.where(F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def added_and_removed(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Rows of new alone (added) and of old alone (removed)."""
    added = new.join(old, on, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.join(new, on, "left_anti").withColumn("change", F.lit("removed")))


def changes_to_remove(changes: DataFrame, as_of: Column, ttl_days: int) -> DataFrame:
    """Change ids to drop per event type: all if the newest is past its time, else all but the newest (by date, then id)."""
    newest = changes.groupBy("event_type").agg(F.max(F.struct("at", "id")).alias("newest"))
    past = F.col("newest.at") < as_of - F.expr(f"INTERVAL {ttl_days} DAYS")
    return changes.join(newest, "event_type").where(past | (F.struct("at", "id") < F.col("newest"))).drop("newest")


def running_max_before(rows: DataFrame, by: list[str], order: str, bucket: Column, column: str, name: str) -> DataFrame:
    """``rows`` with the greatest ``column`` of the rows before them in their group, in order.

    ``bucket`` is a coarse form of the order: the greatest value of earlier buckets is added to that inside the bucket, so
    a group of any size is spread over its buckets.
    """
    dealt = rows.withColumn("_bucket", bucket)
    tops = dealt.groupBy(*by, "_bucket").agg(F.max(column).alias("_top"))
    past = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = tops.select(*by, "_bucket", F.max("_top").over(past).alias("_earlier"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    both = dealt.withColumn("_inside", F.max(column).over(inside)).join(earlier, [*by, "_bucket"])
    return both.withColumn(name, F.greatest("_earlier", "_inside")).drop("_bucket", "_inside", "_earlier")
