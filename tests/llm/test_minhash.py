"""Near-duplicates against all pairs, around the threshold and with long lists."""

import random

import numpy as np
import pytest

from tidelog.llm import minhash


def plain_sets(rows):
    out = {}
    for doc, text in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
        out[doc] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def plain(rows, percent=85):
    sets = plain_sets(rows)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    docs = sorted(sets)
    for k, a in enumerate(docs):
        for b in docs[k + 1 :]:
            x, y = sets[a], sets[b]
            common = len(x & y)
            if x and y and 100 * common >= percent * (len(x) + len(y) - common):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in docs)


def family(draw, first, n, words, edits):
    base = [f"v{draw.randrange(10**6)}" for _ in range(words)]
    out = [(first, " ".join(base))]
    for k in range(1, n):
        w = list(base)
        for _ in range(draw.choice(edits)):
            w[draw.randrange(words)] = f"e{draw.randrange(10**6)}"
        out.append((first + k, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [8, 1024])
def test_components_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    draw = random.Random(7)
    rows = family(draw, 1000, 90, 150, [1, 2, 3, 4]) + family(draw, 2000, 30, 40, [0, 1, 2]) + family(draw, 3000, 5, 400, [3, 8, 12])
    rows += [(10 + k, " ".join(f"u{draw.randrange(30)}" for _ in range(draw.randrange(30)))) for k in range(40)]
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "one Two"), (5, "one\u000btwo "), (6, "É one"), (7, "é one"), (8, "w " * 30000), (9, "w " * 20000)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, signature string").repartition(5)
    got = sorted(tuple(r) for r in minhash.near_duplicates(table).collect())
    assert got == plain(rows)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z u v w q"), (2, "k l m n o p q"), (3, "k l m n o p q"), (4, "x y z u v w q")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(table).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 2, True), (2, 2, True), (3, 2, False), (4, 2, False)]
    assert minhash.near_duplicates(table.limit(0)).count() == 0


def test_shingle_sets_have_the_plain_sizes():
    texts = ["a b c d e f", "a b c", "", "A  b\tc d e", " lead and trail and lead and trail ", "x " * 100]
    sets = minhash.shingle_hashes([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(s) for s in plain_sets(enumerate(texts)).values()]
    assert np.intersect1d(sets[0], sets[3]).size == 1


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.doc_id: r.component_id for r in minhash.components(links).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}


def test_null_ids_in_groups_of_copies(spark):
    long = " ".join(f"w{k}" for k in range(100))
    rows = [(5, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (None, "g h i j k l"), (None, "g h i j k l"), (8, long), (None, long + " end")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(5, 5, True), (7, 5, False), (8, 8, True)]
    unnamed = [r for r in got if r.doc_id is None]
    assert sorted(r.kept for r in unnamed) == [False, False, False, True]
    assert {r.component_id for r in unnamed if r.component_id < 1 << 62} == {5, 8}
    assert len({r.component_id for r in unnamed}) == 3
