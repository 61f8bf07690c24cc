"""Decontamination against a plain comparison of all spans."""

import hashlib
import random
import re

import pytest

from tidelog.llm import decontam


def plain_words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items, span):
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for item, other in items:
            v = plain_words(other)
            n = min(span, len(v))
            for a in range(len(v) - n + 1 if v else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(item))
        out.append((doc, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("span, k, seed", [(10, 4, 1), (5, 3, 2), (3, 2, 3)])
def test_all_shared_spans_are_found(spark, span, k, seed):
    draw = random.Random(seed)
    word = lambda: draw.choice(["a", "B", "é", "c1", "d", "e"])
    text = lambda n: draw.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    items = [(k_, text(draw.choice([0, 1, 2, 3, span - 1, span, span + 3, 30]))) for k_ in range(15)] + [(100, None), (3, text(12))]
    docs = [(k_, text(draw.choice([0, 1, 4, 12, 60]))) for k_ in range(25)] + [(50, None), (51, ""), (52, "...")]
    docs += [(60 + k_, text(20) + " " + items[k_][1].upper() + "! " + text(5)) for k_ in range(12)]
    rows = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, words string, at int")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, gram int")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in decontam.report(rows, bench, span, k).collect()]
    assert sorted(got) == plain(docs, items, span)


def test_shuffled_join_finds_the_same(spark):
    docs = spark.createDataFrame([(1, "x y z a b c d e f g h i j k"), (1, "x y z a b c d e f g h i j k")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e f g h i j"), (8, "q")], "item_id long, text string")
    spans = decontam.find_spans(docs, bench, 10, 4, most_broadcast=0).collect()
    assert [(r.doc_id, r.item_id, r.start, r.length) for r in spans] == [(1, 7, 3, 10)]
    assert decontam.report(docs, bench).count() == 2


def test_empty_tables_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "w " * 30000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "w " * 12)], "item_id long, text string")
    r = decontam.report(docs, bench).collect()[0]
    assert (r.n_words, r.n_hit, r["items"]) == (30000, 30000, ["7"])
    assert decontam.report(docs, bench.limit(0)).collect()[0].n_hit == 0
    assert decontam.report(docs.limit(0), bench).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
