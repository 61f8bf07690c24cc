"""Batches of a stream: by count, event-time span, limits and idle batches, and their text form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def by_count(log: DataFrame, limit: int) -> DataFrame:
    """Tumbling batches of ``limit`` events of a partition: offsets are dense, so no order is computed."""
    return log.withColumn("batch_no", F.floor(F.col("offset") / limit).cast("long"))


def cursor_line(partition: Column, offset: Column, rest: Column | None = None) -> Column:
    """A line of the JSON stream: the cursor, and what follows in it."""
    head = F.concat(F.lit('{"cursor":{"partition":"'), partition.cast("string"), F.lit('","offset":"'), scalars.offset_text(offset), F.lit('"}'))
    return F.concat(head, rest, F.lit("}")) if rest is not None else F.concat(head, F.lit("}"))


def json_lines(rows: DataFrame, batch: list[str], body: str) -> DataFrame:
    """One line for each batch: its last cursor and its events. A batch is bounded by its limit."""
    sorted_ = F.array_sort(F.collect_list(F.struct("offset", body)))
    grouped = rows.groupBy(*batch).agg(sorted_.alias("_e"), F.max("offset").alias("_last"))
    events = F.concat(F.lit(',"events":['), F.array_join(F.transform("_e", lambda e: e[body]), ","), F.lit("]"))
    return grouped.select(*batch, cursor_line(F.col(batch[0]), F.col("_last"), events).alias("line"))


def first_events(log: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """The first ``limit`` events in read order: a top-k, not a sort of the log."""
    return log.orderBy(*order).limit(limit)


def within_window(log: DataFrame, committed: DataFrame, most: int, order: list[str], uncommitted: int = 0) -> DataFrame:
    """Events behind the commits that may be sent, in read order, while at most ``most`` of the stream are uncommitted.

    The cap holds for the sum over all partitions; ``uncommitted`` were sent before. A top-k, not a sort of the log.
    """
    behind = log.join(F.broadcast(committed), "partition").where("offset > committed")
    return behind.orderBy(*order).limit(max(0, most - uncommitted))


def idle_runs(batches: DataFrame, by: str, order: str, size: str) -> DataFrame:
    """The length of each partition's last run of empty batches."""
    last_full = batches.groupBy(by).agg(F.max(F.when(F.col(size) > 0, F.col(order))).alias("_full"), F.max(order).alias("_end"), F.min(order).alias("_begin"))
    return last_full.select(by, (F.col("_end") - F.coalesce("_full", F.col("_begin") - 1)).alias("empties"))


def visible(log: DataFrame, subscription: str, denied: DataFrame, on: list[str]) -> DataFrame:
    """Events not tagged for another subscription and not of a denied owner. The owners may be many."""
    return log.where(F.col("tag").isNull() | (F.col("tag") == subscription)).join(denied, on, "left_anti")


def skip_lost(committed: DataFrame, stats: DataFrame) -> DataFrame:
    """Where to read on when retention has passed a commit, and how many events that skips."""
    joined = committed.join(stats, "partition")
    return joined.select("partition", F.greatest("committed", "before_first").alias("resume"), F.greatest(F.col("before_first") - F.col("committed"), F.lit(0)).alias("skipped"))


SPAN = "partition int, batch_no long, first_offset long, last_offset long, n long"


class SpanFold:
    """Batches of a partition by event-time span, in order of arrival.

    A batch is due when the newest buffered event reaches the end of the window that the
    first one opened; it takes the leading events before that end, at least one, and the
    next window begins at the later of that end and the last taken time.
    """

    def __init__(self, span: float):
        self.span, self.buffer, self.end = span, [], None

    def add(self, time: float) -> list[int]:
        """The sizes of the batches that an event at ``time`` makes due."""
        sizes = []
        if self.end is None:
            self.end = time + self.span
        self.buffer.append(time)
        while self.buffer and self.buffer[-1] >= self.end:
            n = next((k for k, t in enumerate(self.buffer) if t >= self.end), len(self.buffer)) or 1
            sizes.append(n)
            self.end = max(self.end, self.buffer[n - 1]) + self.span
            self.buffer = self.buffer[n:]
        return sizes

    def rest(self) -> list[int]:
        """The size of the open batch, if there is one."""
        return [len(self.buffer)] if self.buffer else []


def span_fold(times: list[float], span: float, drain: bool = False) -> list[int]:
    """Sizes of the batches of one partition; ``drain`` gives the open one as a last batch."""
    fold = SpanFold(span)
    sizes = [n for t in times for n in fold.add(t)]
    return sizes + (fold.rest() if drain else [])


def by_span(log: DataFrame, seconds: float) -> DataFrame:
    """Batches of each partition by event-time span: a fold over the partition in order, as the windows depend on the events.

    A partition's rows stream through one task sorted, a batch of rows at a time; only an open window is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fold, number, first = None, SpanFold(seconds), 0, 0

        def rows(sizes: list[int]) -> list[tuple]:
            nonlocal number, first
            out = []
            for n in sizes:
                out.append((now, number, first, first + n - 1, n))
                number, first = number + 1, first + n
            return out

        for pdf in batches:
            out = []
            for p, offset, t in zip(pdf["partition"], pdf["offset"], pdf["seconds"]):
                if p != now:
                    out += rows(fold.rest())
                    now, fold, number, first = p, SpanFold(seconds), 0, offset
                out += rows(fold.add(t))
            yield pd.DataFrame(out, columns=["partition", "batch_no", "first_offset", "last_offset", "n"])
        yield pd.DataFrame(rows(fold.rest()), columns=["partition", "batch_no", "first_offset", "last_offset", "n"])

    rows = log.select("partition", "offset", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    return rows.repartition("partition").sortWithinPartitions("partition", "offset").mapInPandas(run, SPAN)


def heaviest(log: DataFrame, size: Column) -> DataFrame:
    """The partition with the most buffered bytes."""
    return log.groupBy("partition").agg(F.sum(size).alias("bytes")).agg(F.max_by("partition", F.struct("bytes", -F.col("partition"))).alias("partition"), F.max("bytes").alias("bytes"))


def micro_batches(events: DataFrame, key: str, order: list[str], most: int, seconds: int) -> DataFrame:
    """Groups of at most ``most`` events of a key inside the same ``seconds``, which are aligned to the epoch, not to a first event."""
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    slotted = events.withColumn("slot", slot)
    at = F.row_number().over(Window.partitionBy(key, "slot").orderBy(*order)) - 1
    return slotted.withColumn("part", F.floor(at / most).cast("long"))
