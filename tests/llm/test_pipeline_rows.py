"""The pipeline's stages on clashing names, null ids, and empty tables."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import tokens

DIR = "/root/testdata/sf0.001"
CLASHING = {"score": "double", "rejected": "boolean", "kept": "string", "row": "long", "n_words": "int", "text_hash": "int", "component_id": "long", "_gone": "long", "_hash": "long", "toxic": "int"}


@pytest.fixture(scope="module")
def docs(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    nameless = docs.limit(40).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", F.lit(" nameless words here")))
    return docs.unionByName(nameless).withColumns({c: F.lit(None).cast(t) for c, t in CLASHING.items()})


def test_clashing_names_and_null_ids(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        rows = out.collect()
        assert out.columns == docs.columns, name
        assert any(r.doc_id is None for r in rows), name
        docs = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    assert any(r.doc_id is None for r in packed) and len(packed) >= docs.count()


def test_one_row_of_null_ids_with_equal_texts(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (None, text), (3, text + " a"), (4, "other words of another text that is alone here"), (None, "one more that nobody else has in this table")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    out = corpus_pipeline.near_dedup(spark, docs, DIR).collect()
    assert sorted((r.doc_id or 0, r.text[:5]) for r in out) == [(0, "one m"), (3, "w0 w1"), (4, "other")]


def test_empty_tables(spark, docs):
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DIR).count() == 0, name


def test_batches_are_bounded_by_bytes(spark):
    """Texts of 20 MB go to a Python worker a few at a time, all of them, and a session's own bound stays."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    docs = spark.range(0, 10_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 200).alias("text"))
    few = docs.limit(3)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(tokens.BATCH_SETTING)
            stage(spark, few.withColumn("lang", F.lit("en")), DIR)
            got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
            assert sum(r["rows"] for r in got) == 10_000 and max(r["bytes"] for r in got) < 1.1 * tokens.BATCH_BYTES, name
        spark.conf.set(tokens.BATCH_SETTING, "64k")
        assert not tokens.bound_batches(spark) and spark.conf.get(tokens.BATCH_SETTING) == "64k"
    finally:
        spark.conf.unset(tokens.BATCH_SETTING)
