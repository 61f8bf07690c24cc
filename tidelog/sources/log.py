"""The log and its timelines, derived from a table of events, and readers and writers for logs.

Columns of a log: event_type, partition, offset, key, value (null: a tombstone),
ts, and what else the events have. ``offset`` is dense from 0 in each partition.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars

PARTITIONS = 8

#: Logs made here, with their rows before they were numbered, and with their sizes once these are known.
_parted: WeakKeyDictionary[DataFrame, DataFrame] = WeakKeyDictionary()
_known: WeakKeyDictionary[DataFrame, list] = WeakKeyDictionary()


def number_rows(df: DataFrame, by: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in each group of ``by``, in ``order``.

    ``bucket`` is a coarse form of the first order column (a day of a time). Rows are numbered inside (group,
    bucket) and the counts of earlier buckets added, so a group of any size is spread over its buckets.
    """
    dealt = df.withColumn("_bucket", bucket)
    counts = dealt.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    return dealt.withColumn("_at", F.row_number().over(inside) - 1).join(starts, [*by, "_bucket"]).withColumn(name, (F.col("_start") + F.col("_at")).cast("long")).drop("_bucket", "_at", "_start")


def from_events(events: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """A log of one stream: partition by the hash of user_id, offset by ts and event_id."""
    keyed = events.withColumn("key", F.col("user_id").cast("string"))
    parted = keyed.withColumn("partition", scalars.partition_of([F.col("key")], partitions))
    log = number_rows(parted, ["partition"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "offset")
    _parted[log] = parted
    return log


def load(spark: SparkSession, sf_dir: str, partitions: int = PARTITIONS) -> DataFrame:
    """The log of the events table in a folder."""
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), partitions)


def sizes(log: DataFrame) -> DataFrame:
    """Rows of each partition.

    A log from :func:`from_events` is counted before its rows are numbered, and once: the driver then holds a row for each partition.
    """
    counts = lambda rows: rows.groupBy("partition").agg(F.count(F.lit(1)).alias("n"))
    if log not in _parted:
        return counts(log)
    if log not in _known:
        _known[log] = [(r["partition"], r["n"]) for r in counts(_parted[log]).collect()]
    return log.sparkSession.createDataFrame(_known[log], "partition int, n long")


def timelines(log: DataFrame) -> DataFrame:
    """Four timelines of each partition: a quarter of it, an empty one, another quarter, and the open rest.

    Columns: partition, tl_order, size, start (rows of earlier timelines), last_offset (size - 1), is_open.
    """
    quarter, half = F.floor(F.col("n") / 4), F.floor(F.col("n") / 2)
    size = F.when(F.col("tl_order") == 1, quarter).when(F.col("tl_order") == 2, 0).when(F.col("tl_order") == 3, half - quarter).otherwise(F.col("n") - half)
    rows = sizes(log).withColumn("tl_order", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)]))).withColumn("size", size.cast("long"))
    before = Window.partitionBy("partition").orderBy("tl_order").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "partition", "tl_order", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("start"),
        (F.col("size") - 1).alias("last_offset"), (F.col("tl_order") == 4).alias("is_open"),
    )


def on_timelines(log: DataFrame, lines: DataFrame) -> DataFrame:
    """``log`` with tl_order and tl_offset. ``lines`` has a row for each partition and timeline: metadata, and small."""
    found = (log["partition"] == lines["partition"]) & (log["offset"] >= lines["start"]) & (log["offset"] < lines["start"] + lines["size"])
    return log.join(F.broadcast(lines), found).select(log["*"], "tl_order", (log["offset"] - lines["start"]).alias("tl_offset"))


def scan(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events after each partition's cursor (exclusive; -1 is the beginning). ``cursors``: partition, cursor."""
    return log.join(F.broadcast(cursors), "partition").where("offset > cursor").drop("cursor")


def scan_timelines(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events after (c_order, c_offset) over all later timelines, without tombstones, by order and offset."""
    later = F.struct("tl_order", "tl_offset") > F.struct(F.col("c_order").alias("tl_order"), F.col("c_offset").alias("tl_offset"))
    return log.join(F.broadcast(cursors), "partition").where(later & F.col("value").isNotNull()).drop("c_order", "c_offset")


def append(log: DataFrame, path: str) -> None:
    """Append records to a log kept as Parquet, laid out by event type and partition, so that scans read what they need."""
    log.write.mode("append").partitionBy("event_type", "partition").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A log kept as Parquet."""
    return spark.read.parquet(path)


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A log kept as Parquet, as a stream; ``files_per_trigger`` bounds a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def kafka(spark: SparkSession, servers: str, topics: str, starting: str = "earliest") -> DataFrame:
    """A Kafka source as a log stream. It needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", starting).load()
    return raw.select(F.col("topic").alias("event_type"), "partition", "offset", F.col("key").cast("string"), F.col("value").cast("string"), F.col("timestamp").alias("ts"))


def avro_column(value: Column, schema_json: str) -> Column:
    """An Avro record as a struct. It needs Spark's Avro package on the class path."""
    from pyspark.sql.avro.functions import from_avro

    return from_avro(value, schema_json)
