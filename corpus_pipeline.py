"""The corpus pipeline: language ID, toxicity, near-dedup, decontamination and packing, one after the other.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs``, the documents that the stage before kept, and returns
those that it keeps with the columns of documents; the last one returns the packed pieces. ``run`` writes each stage's
result as Parquet in the shared folder and reads it again for the next one.

Further columns of ``docs`` are kept, whatever their names (doc_id, text and lang have their meaning). Long texts count whole. An empty
table gives an empty result. Only ids and texts go through Python, and verdicts come back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontam, langid, minhash, packing, queries, scratch, tokens, toxicity

#: Rows of a table of decisions that may be broadcast (a doc_id and a hash each); beyond it both sides are shuffled.
MOST_BROADCAST = 500_000


def _without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text aren't in ``decided`` (doc_id and text_hash); null ids are equal."""
    gone = scratch.keep(decided.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct(), "gone")
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    same = docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_hash"])
    return docs.join(gone, same, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose nearest language centroid isn't too far. It learns from four fifths of the documents it gets.

    Texts that are null, empty or without a letter go. Equal texts are judged alike, of equal cosines the first language counts.
    """
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"), 5, 0)))
    return docs.where(~langid.judge(F.col("text"), model)["rejected"])


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score below the toxic threshold. It learns from two thirds of the labels.

    Null and empty texts have no toxic word and stay. Equal texts are judged alike; a score at the threshold goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~langid.held_out(F.col("doc_id"), 3, 1))
    return docs.where(toxicity.judge(F.col("text"), toxicity.fit(docs, labels)) < queries.TOXIC_FROM)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each near-duplicate component, similarity 0.85 or more.

    Texts without words are linked with nothing and stay. Rows of one doc_id are one document and stay or go together;
    rows of a null doc_id with equal texts are one, of which one row stays.
    """
    named = docs.where(F.col("doc_id").isNotNull()).unionByName(docs.where(F.col("doc_id").isNull()).dropDuplicates(["text"]))
    return _without(named, minhash.near_duplicates(named, 85, with_hash=True).where(~F.col("kept")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that share no span of 10 words with a benchmark item, nor the whole of a shorter item.

    Null and empty texts share none and stay; each row is judged by its own text, null ids too.
    """
    found = decontam.report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), span=10)
    return _without(docs, found.where("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the documents' tokens in sequences of at most 2048. A null or empty text is its end id alone, a null doc_id stays null."""
    return packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), 2048, end_id=0)


def _released(stage):
    """The stage, after the intermediate tables of the stage before are removed: its result has been written by then.

    The session's batches are bounded from then on, as the stage's result is computed only after it returns.
    """

    def step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release(spark)
        tokens.bound_batches(spark)
        return stage(spark, docs, sf_dir)

    step.__doc__, step.__name__ = stage.__doc__, stage.__name__
    return step


STAGES = [
    ("language ID", _released(language_id)),
    ("toxicity", _released(remove_toxic)),
    ("MinHash near-dedup", _released(near_dedup)),
    ("benchmark decontamination", _released(decontaminate)),
    ("best-fit packing", _released(pack)),
]

#: No SQL: the stages learn models and count tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep. They lie in the shared folder until the session's end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    bounded = tokens.bound_batches(spark)
    try:
        for k, (_, stage) in enumerate(STAGES):
            path = f"{scratch.folder(spark)}-stage-{k}-{uuid.uuid4().hex}"
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
            docs = spark.read.parquet(path)
            if before:
                scratch.drop(spark, before)
            before = path
    finally:
        if bounded:
            spark.conf.unset(tokens.BATCH_SETTING)
    scratch.hold(before, result=True)
    return docs
