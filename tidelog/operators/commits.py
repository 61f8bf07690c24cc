"""Commits of consumers: running maximum, skipped ranges, autocommit, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources.log import number_rows
from .positions import running_max_before


#: Sequence numbers or offsets that one task takes in order.
BUCKET = 50_000


def commit(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Whether each request (partition, seq, c_offset) moves its partition's commit on, and the commit after it."""
    ran = running_max_before(requests, ["partition"], "seq", F.floor(F.col("seq") / BUCKET), "c_offset", "_asked")
    joined = ran.join(F.broadcast(current), "partition", "left")
    before = F.greatest(F.coalesce("committed", F.lit(-1)), F.coalesce("_asked", F.lit(-1)))
    return joined.withColumn("before", before).select("partition", "seq", "c_offset", (F.col("c_offset") > F.col("before")).alias("moved"), F.greatest("before", "c_offset").alias("after"))


def new_commits(requests: DataFrame, current: DataFrame) -> DataFrame:
    """The commits after all requests: an aggregation and a merge."""
    asked = requests.groupBy("partition").agg(F.max("c_offset").alias("asked"))
    return current.join(asked, "partition", "full").select("partition", F.greatest("committed", "asked").alias("committed"))


def validate_requests(requests: DataFrame, sessions: DataFrame, topology: DataFrame) -> DataFrame:
    """An error for requests whose stream id is no UUID, has no session, or doesn't hold the partition."""
    alive = sessions.select(F.col("session").alias("stream_id"), F.lit(True).alias("_alive"))
    owned = topology.select("partition", F.col("session").alias("stream_id"), F.lit(True).alias("_owns"))
    joined = requests.join(F.broadcast(alive), "stream_id", "left").join(F.broadcast(owned), ["partition", "stream_id"], "left")
    error = F.when(~scalars.is_uuid(F.col("stream_id")), "NOT_A_UUID").when(F.col("_alive").isNull(), "NO_SESSION").when(F.col("_owns").isNull(), "NOT_ASSIGNED")
    return joined.withColumn("error", error).drop("_alive", "_owns")


def reset(current: DataFrame, given: DataFrame) -> DataFrame:
    """Commits with those of ``given`` partitions replaced."""
    return current.join(given, "partition", "left_anti").unionByName(given.select(*current.columns))


def skipped_ranges(skipped: DataFrame) -> DataFrame:
    """Runs of neighbouring skipped offsets: partition, first and last."""
    numbered = number_rows(skipped.select("partition", "offset"), ["partition"], ["offset"], F.floor(F.col("offset") / BUCKET), "_nth")
    return numbered.withColumn("_i", F.col("offset") - F.col("_nth")).groupBy("partition", "_i").agg(F.min("offset").alias("first"), F.max("offset").alias("last")).drop("_i")


def autocommit(ranges: DataFrame, current: DataFrame) -> DataFrame:
    """The commit that skipped ranges allow: the end of the first range beyond the commit, if it begins right after it or before."""
    beyond = ranges.join(F.broadcast(current), "partition").where("last > committed")
    first = beyond.groupBy("partition", "committed").agg(F.min(F.struct("first", "last")).alias("r"))
    return first.where(F.col("committed") >= F.col("r.first") - 1).select("partition", F.col("r.last").alias("suggested"))


def apply_commit(state: DataFrame) -> DataFrame:
    """A stream's state after a commit: ``sent``, ``committed`` and ``asked`` give the new commit, sent, count and what to do."""
    asked, sent, committed = F.col("asked"), F.col("sent"), F.col("committed")
    action = F.when(asked < committed, "REWIND").when(asked > sent, "SEEK").otherwise("ADVANCE")
    return state.select(
        "*", action.alias("action"), asked.alias("new_commit"),
        F.when(asked < committed, asked).otherwise(F.greatest(sent, asked)).alias("new_sent"),
        F.when(asked < committed, F.lit(0)).otherwise(asked - committed).cast("long").alias("advanced"),
    )


def failed_commits(state: DataFrame, max_send_count: int | None) -> DataFrame:
    """Failed-commit counters after a stream closes: up where events are uncommitted, zero where a commit came."""
    if max_send_count is None:
        return state.withColumn("failed_after", F.col("failed"))
    return state.withColumn("failed_after", F.when(F.col("committed_now"), 0).when(F.col("sent") > F.col("committed"), F.col("failed") + 1).otherwise(F.col("failed")))


def dead_letters(events: DataFrame, subscription: str, error: Column) -> DataFrame:
    """Records for the dead-letter store."""
    return events.select(
        F.lit(subscription).alias("subscription_id"), "event_type", F.col("partition").cast("string").alias("partition"), scalars.offset_text(F.col("offset")).alias("log_offset"),
        error.alias("error_message"), F.col("props").alias("event"),
    )

