"""The thin queries of the operators, by name, with DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, minhash, packing, scratch, sharding, syncmers, tokenbin, toxicity, urltree

ORACLE: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learnt from two thirds of the labels."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", langid.held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    labels = _table(spark, sf_dir, "labels").where(~langid.held_out(F.col("doc_id"), 3, 1))
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model, ("doc_id", "held_out"))
    return scored.withColumn("predicted", F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0))


#: The score from which a text counts as toxic.
TOXIC_FROM = 0.7


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_rows(rows))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return sharding.shard(_table(spark, sf_dir, "documents"), 16)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), 85)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that lie in spans of benchmark items."""
    found = decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), span=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE["op1_minhash"] = minhash.ORACLE
ORACLE["op2_decontamination"] = decontam.ORACLE

#: The rules of op3 (fixed values): verdict, host and start of the path.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return urltree.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048, end_id=0)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return syncmers.compare_edited(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from four fifths of them."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id"), 5, 0))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, ("doc_id", "held_out"))


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written in binary blocks and read back."""
    path = scratch.new_path(spark, "token-files")
    tokenbin.write(_table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return tokenbin.read(spark, path)


QUERIES = {"op1_minhash": op1_minhash, "op2_decontamination": op2_decontamination, "op3_url_filters": op3_url_filters, "op4_best_fit_packing": op4_best_fit_packing, "op5_fingerprints": op5_fingerprints, "op6_language_id": op6_language_id, "op7_token_binary": op7_token_binary, "op8_toxicity": op8_toxicity, "op9_chat_format": op9_chat_format, "op10_sharding": op10_sharding}
