"""Toxicity's decoding, language centroids and closed syncmers, each against a plain version that tries everything."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import langid, minhash, syncmers, toxicity


@pytest.fixture(scope="module")
def decoder(spark):
    words = ["idiot", "stupid", "clown", "good", "morning", "tell", "news", "book", "see", "all"]
    texts = spark.createDataFrame([(" ".join(words),)] * 30, "text string")
    return toxicity.Decoder(toxicity.language_model(toxicity.count_trigrams(texts)))


def best_price(piece, model):
    """The price of the best path through the whole lattice, by trying all of them."""
    options = []
    for k, char in enumerate(piece):
        repeated, own = k > 0 and char == piece[k - 1], toxicity._code(char)
        read = [(char, toxicity._PRICE_KEEP if repeated else 0.0)] if own else [(" ", toxicity._PRICE_ITSELF)]
        read += [(x, toxicity._PRICE_LEET) for x in toxicity.LEET.get(char, "")]
        if not own:
            read.append(("", toxicity._PRICE_NOTHING))
        elif repeated:
            read.append(("", toxicity._PRICE_DROP))
        options.append(read)
    best = {}
    for path in itertools.product(*options):
        a = b = 0
        price, text = 0.0, ""
        for letter, cost in path:
            price += cost
            if letter:
                c = toxicity._code(letter)
                if not (c == 0 and b == 0):
                    price += model[a][b][c]
                    a, b = b, c
                else:
                    a = 0
                text += letter
        price += model[a][b][0] if b else 0.0
        best[text] = max(best.get(text, -math.inf), price)
    return best


@pytest.mark.parametrize("piece", ["1d10t", "$tup!d", "g00d", "c|0wn", "idiiot", "stuupid", "s33", "4ll", "b00k!", "t3||", "n3w$", "8@4", "aab1", "0"])
def test_viterbi_finds_the_best_path_of_the_lattice(decoder, piece):
    prices = best_price(piece, decoder.model)
    found = decoder.decode(piece)
    assert prices[found] >= max(prices.values()) - 1e-4


@pytest.mark.parametrize("written, word", [("idiiot", "idiot"), ("stuupid", "stupid"), ("bookk", "book")])
def test_doubled_letters_are_read_both_ways(decoder, written, word):
    assert word in decoder.words(written) and written in decoder.words(written)
    assert decoder.words(written, lambda readings: word in readings)[1:] and decoder.words(written, lambda _: False) == [written]
    assert decoder.words("ab" * 20 + "aabb" * 3000)


def test_nearest_centroid_is_that_of_plain_vectors(spark):
    draw = random.Random(1)
    words = {"en": ["the", "house", "and", "river", "was"], "fr": ["le", "maison", "et", "rivière", "était"], "de": ["das", "haus", "und", "fluß", "war"]}
    rows = [(k, " ".join(draw.choice(words[lang]) for _ in range(draw.randrange(1, 40))), lang) for k, lang in enumerate(["en", "fr", "de"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.select("text", "lang"))
    texts = [t for _, t, _ in rows]
    df = np.zeros(langid.DIMENSIONS)
    for t in texts:
        df += langid._counts([t.encode()])[0] > 0
    idf = np.where(df > 0, np.log((1 + len(texts)) / (1 + df)) + 0.1, 0)
    assert np.allclose(model.idf, idf, atol=1e-5)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for k, t, _ in rows:
        v = np.log1p(langid._counts([t.encode()])[0]) * idf
        cosines = model.centroids @ (v / np.linalg.norm(v))
        assert abs(got[k].score - cosines.max()) < 1e-4
        assert got[k].lang_pred in {model.languages[j] for j in np.flatnonzero(cosines > cosines.max() - 1e-4)}
    assert np.mean([got[k].lang_pred == lang for k, _, lang in rows]) > 0.95


def test_kept_k_mers_are_the_closed_syncmers(spark):
    draw = random.Random(2)
    texts = [" ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(0, 40))) for _ in range(60)]
    runs = sorted({tuple(t.split()[k : k + syncmers.S]) for t in texts for k in range(len(t.split()) - syncmers.S + 1)})
    hashed = spark.createDataFrame([(list(r),) for r in runs], "w array<string>").select("w", F.xxhash64(*[F.col("w")[j] for j in range(syncmers.S)]).alias("h")).collect()
    of = {tuple(r.w): r.h for r in hashed}
    got = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", syncmers.anchors(F.col("text")).alias("a")).collect()
    for r in got:
        w = texts[r.k].split()
        inner = [of[tuple(w[k : k + syncmers.S])] for k in range(len(w) - syncmers.S + 1)]
        places = [k for k in range(len(w) - syncmers.K + 1) if min(inner[k], inner[k + syncmers.K - syncmers.S]) == min(inner[k : k + syncmers.K - syncmers.S + 1])]
        assert [x["at"] for x in r.a or []] == (places or ([0] if w else []))


def test_pairs_at_the_threshold_match_by_their_signatures():
    draw, matched = random.Random(4), 0
    for _ in range(400):
        common = [draw.getrandbits(64) for _ in range(850)]
        a, b = (np.unique(np.array(common + [draw.getrandbits(64) for _ in range(75)], np.uint64)) for _ in range(2))
        x, y = minhash.signatures([a, b])
        matched += int((x == y).sum() >= minhash.MATCH)
    assert matched >= 399  # a miss has a probability of 1.5e-7
