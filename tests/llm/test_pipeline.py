"""The pipeline against what its stages' operators say, and the registered queries."""

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tidelog.llm import decontam, minhash, queries, toxicity

DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "!!! 123", "en", "x", 7), (10**6 + 1, None, None, None, None)], docs.schema)
    docs = docs.unionByName(junk)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        out = spark.createDataFrame(stage(spark, docs, DIR).collect(), docs.schema)
        assert out.columns == docs.columns, name
        after = {r.doc_id for r in out.collect()}
        assert after <= before
        if k == 0:
            assert not after & {10**6, 10**6 + 1} and len(before - after) <= 6
        elif k == 2:
            kept = {r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()}
            assert after == kept
        elif k == 3:
            bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
            hit = {r.doc_id for r in decontam.report(docs, bench).where("contaminated").collect()}
            assert after == before - hit
        docs = out
    assert docs.count() > 100


def test_toxic_documents_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = corpus_pipeline.remove_toxic(spark, docs, "/root/testdata/sf0.01")
    gone = docs.join(out, "doc_id", "left_anti").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    counts = gone.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    assert counts["t"] >= 25 and counts["t"] >= 0.9 * counts["n"]
    assert queries.TOXIC_FROM == 0.7 and toxicity.FEATURES


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, DIR).collect()
    sizes = {}
    for r in rows:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert max(sizes.values()) <= 2048
    assert 100 < len({r.doc_id for r in rows}) < 200


def test_every_operator_has_its_query():
    found = __spark_entry__.queries()
    assert "pipeline" in found
    assert sorted(int(k[2:].split("_")[0]) for k in found if k.startswith("op") and k[2].isdigit()) == list(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(found)
