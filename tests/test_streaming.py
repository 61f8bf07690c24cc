"""Streams against the same batch results."""

from pyspark.sql import functions as F

from tidelog.sources import log
from tidelog.streaming import flow

EVENTS = "/root/testdata/sf0.001/events.parquet"


def stream(spark, tmp_path):
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    return events, log.read_stream(spark, str(tmp_path / "in"), events.schema)


def test_append_takes_every_event_once(spark, tmp_path):
    events, source = stream(spark, tmp_path)
    for _ in range(2):
        flow.append(source, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.event_id for r in out.collect()) == sorted(r.event_id for r in events.collect())


def test_usage_equals_the_batch_result(spark, tmp_path):
    events, source = stream(spark, tmp_path)
    query = flow.usage(source, late="10000 days").writeStream.format("memory").queryName("usage").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    found = {(r.event_type, r.start): r.n for r in spark.table("usage").collect()}
    expected = events.groupBy("event_type", F.date_trunc("hour", "ts").alias("start")).count().collect()
    assert found == {(r.event_type, r.start): r["count"] for r in expected}


def test_repeated_sends_are_taken_once(spark, tmp_path):
    events, _ = stream(spark, tmp_path)
    events.union(events).write.parquet(str(tmp_path / "twice"))
    source = log.read_stream(spark, str(tmp_path / "twice"), events.schema, files_per_trigger=100)
    query = flow.once(source).writeStream.format("memory").queryName("once").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("once").count() == events.count()
