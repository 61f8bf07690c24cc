"""Language ID: held-out accuracy, and the odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import langid, queries

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = queries.op6_language_id(spark, DIR).join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out]
    assert 150 < len(held) < 250
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.005
    assert all(0 <= r.score <= 1 for r in rows)


def test_counts_are_those_of_each_text_alone():
    texts = [b"ab c", b"", "É7!".encode(), b"ab" * 100]
    together = langid._counts(texts)
    for k, t in enumerate(texts):
        alone = langid._counts([t])[0]
        assert np.abs(together[k] - alone).sum() <= 4  # n-grams over the edge end in a blank
    assert together[1].sum() == 0 or together[1].sum() <= 2


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "en"), (3, "123 !!", "en"), (4, "the cat and the dog", "en"), (5, "le chat et le chien", "fr"), (6, "the " * 50000, "en"), (4, "the cat and the dog", "en")]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    model = langid.fit(docs.select("text", "lang"))
    out = langid.predict(docs, model).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.lang_pred for r in out} == {1: "und", 2: "und", 3: "und", 4: "en", 5: "fr", 6: "en"}
    assert all(r.rejected for r in out if r.lang_pred == "und")


@pytest.mark.parametrize("where", ["false", "doc_id < 0"])
def test_nothing_to_learn_from(spark, where):
    docs = spark.createDataFrame([(1, "abc", "en")], "doc_id long, text string, lang string")
    assert langid.fit(docs.where(where)) is None
    assert langid.predict(docs, None).collect()[0].lang_pred == "und"
    assert langid.predict(docs.where(F.lit(False)), None).count() == 0


FOREIGN = {
    "it": "Questa è una frase italiana abbastanza lunga che parla del tempo e della vita quotidiana nelle città del paese.",
    "nl": "Dit is een Nederlandse zin die lang genoeg is om over het weer en het dagelijks leven te praten in de stad.",
    "pt": "Esta é uma frase em português que fala sobre o tempo e a vida cotidiana nas cidades do país.",
    "fi": "Tämä on suomenkielinen lause joka kertoo säästä ja jokapäiväisestä elämästä maan kaupungeissa.",
    "sw": "Hii ni sentensi ya Kiswahili inayozungumzia hali ya hewa na maisha ya kila siku katika miji ya nchi.",
    "id": "Ini adalah kalimat bahasa Indonesia yang membicarakan cuaca dan kehidupan sehari hari di kota kota negara.",
}


def test_unlearnt_languages_are_rejected_and_short_valid_texts_are_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("held_out", langid.held_out(F.col("doc_id"), 5, 0))
    model = langid.fit(docs.where("NOT held_out"))
    foreign = spark.createDataFrame([(f"{k} {n}", (t + " ") * n) for k, t in FOREIGN.items() for n in (1, 8, 64)], "doc_id string, text string")
    assert [r.doc_id for r in langid.predict(foreign, model).collect() if not r.rejected] == []
    held = langid.predict(docs.where("held_out"), model, ("doc_id", "text")).collect()
    assert np.mean([r.rejected for r in held]) < 0.005
    short = [r for r in held if len(r.text or "") < 200 and len(set((r.text or "").split())) >= 8]  # prose, not one word or a repeated one
    assert len(short) > 20 and sum(r.rejected for r in short) <= 1


def test_the_sample_stays_in_tasks(spark, monkeypatch):
    rows = [(f"{words} {k}", lang) for k in range(60) for lang, words in (("en", "the cat sat on the mat"), ("de", "der hund ist nicht hier"), ("fr", "le chat est dans la rue"))]
    frame = type(spark.range(1))
    sent, collect = [], frame.collect

    def counted(df):
        got = collect(df)
        sent.append(sum(len(v) for r in got for v in r if isinstance(v, (bytes, bytearray))))
        return got

    monkeypatch.setattr(frame, "collect", counted)
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), per_language=2)
    assert 0 < sum(sent) <= (langid.FOLDS + 1) * 3 * 2 * langid.DIMENSIONS * 4 and sorted(set(model.languages)) == ["de", "en", "fr"]
