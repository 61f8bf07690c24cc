"""Toxicity: deobfuscation, held-out scores, and the odd cases."""

import numpy as np
import pytest

from tidelog.llm import queries, toxicity

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def decoder(spark):
    words = ["idiot", "stupid", "clown", "pathetic", "good", "morning", "people", "tell", "news", "nothing", "book"]
    texts = spark.createDataFrame([(" ".join(words),)] * 30, "text string")
    return toxicity.Decoder(toxicity.language_model(toxicity.count_trigrams(texts)))


@pytest.mark.parametrize("written, word", [("1d10t", "idiot"), ("id!ot", "idiot"), ("idiiiot", "idiot"), ("stup1d", "stupid"), ("cl0wn", "clown"), ("p4th3t1c", "pathetic"), ("goood", "good"), ("$tupid", "stupid")])
def test_leetspeak_and_repetition(decoder, written, word):
    assert word in decoder.words(written)


@pytest.mark.parametrize("text, word", [("you i d i o t here", "idiot"), ("s.t.u.p.i.d", "stupid"), ("so c-l-o-w-n", "clown"), ("1 d 1 0 t", "idiot")])
def test_spacing(decoder, text, word):
    assert word in decoder.spread(text)


@pytest.mark.parametrize("written, word", [("idi" + "o" * 60 + "t", "idiot"), ("_".join(["g00d", "m0rning", "p3ople", "t3ll", "n3ws", "n0thing", "1d10t"]), "idiot")])
def test_disguises_of_more_than_40_characters(decoder, written, word):
    assert len(written) > 40 and word in decoder.words(written)


@pytest.mark.parametrize("text", [
    "g o o d i d i o t", "i  d  i  o  t", "so i. d. i. o. t", "g o o d   i d i o t", " ".join("goodmorningpeople" * 2 + "pathetic" + "idiot"),
    " ".join("goodmorningpeopletell" + "newsnothinggoodgood" + "idiot" + "news"),
])
def test_spread_passages_without_ends_of_words(decoder, text):
    assert "idiot" in decoder.spread(text)


def test_three_spread_letters_and_long_pieces(decoder):
    assert decoder.spread("a b o o k") and decoder.spread("t e l") != []
    assert decoder.spread("to a b c-") == [] and decoder.spread("a b") == []
    long = "1d10t_" * 20_000
    assert decoder.words(long).count("idiot") == 20_000


def test_plain_words_stay(decoder):
    assert decoder.words("morning,") == ["morning"]
    assert decoder.words("été") == ["été"]
    assert decoder.spread("this is a plain text") == []
    assert decoder.words("a" * 5000) and decoder.words("$" * 100) == []


def test_words_of_many_doubles_are_asked_of_their_reading(decoder):
    written = "iiddiioott" + "cclloowwnn"
    plain, *read = decoder.words(written)
    assert plain == written and read and written not in read
    assert decoder.words(written, lambda words: read[0] in words) == [written, *read]
    assert decoder.words(written, lambda _: False) == [written]


def test_trigram_counts(spark):
    texts = spark.createDataFrame([("ab",), ("Ab  b",), (None,), ("",)], "text string")
    counts = toxicity.count_trigrams(texts)
    assert counts[0, 0, 1] == 2 and counts[0, 1, 2] == 2 and counts[1, 2, 0] == 2 and counts[0, 0, 2] + counts[2, 0, 2] >= 1


def test_held_out(spark):
    rows = queries.op8_toxicity(spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    toxic, clean = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert np.mean([s >= 0.7 for s in clean]) < 0.03
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc > 0.8


def test_disguised_words_score_like_plain_ones(spark):
    clean = ["good morning people", "nothing new in the book", "people tell good news", "the morning news"]
    rows = [(k, clean[k % 4] + f" {k}", 0) for k in range(80)] + [(100 + k, clean[k % 4] + f" idiot stupid {k}", 1) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    odd = [(1, "good morning people"), (2, "you 1d10t and stup1d"), (3, "an i d i o t , s t u p i d people"), (4, None), (5, ""), (6, "good " * 30000), (2, "you 1d10t and stup1d")]
    out = toxicity.score(spark.createDataFrame([(*r, 1.0) for r in odd], "doc_id long, text string, score double"), model).collect()
    got = {r.doc_id: r.score for r in out}
    assert len(out) == len(odd)
    assert got[2] >= 0.7 and got[3] >= 0.7
    assert all(got[k] < 0.5 for k in (1, 4, 5, 6))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", 1)], "doc_id long, text string, toxic int")
    assert toxicity.fit(docs, docs.select("doc_id", "toxic")) is None
    assert toxicity.score(docs, None).collect()[0].score == 0.0
    assert toxicity.fit(docs.limit(0), docs.select("doc_id", "toxic").limit(0)) is None
    assert toxicity.score(docs.limit(0), None).count() == 0
