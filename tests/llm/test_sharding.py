"""Sharding: the law, sizes, slots and skew, against plain sums."""

import random
import zlib

import pytest

from tidelog.llm import sharding


def checked(rows, out, shards, slack):
    """Sizes, slots and checksums of every row, and the law of near equal bytes."""
    plain = sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32) for r in out) == plain
    bytes_of, slots = dict.fromkeys(range(shards), 0), {}
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        bytes_of[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    for of in slots.values():
        assert sorted(of) == list(range(len(of)))
    largest = max((s for _, s, _ in plain), default=0)
    assert max(bytes_of.values()) - min(bytes_of.values()) <= 2 * largest + slack * sum(bytes_of.values()) / shards


@pytest.mark.parametrize("shards, cell", [(1, 20_000), (4, 50), (16, 20_000)])
def test_law_and_slots(spark, shards, cell):
    draw = random.Random(5)
    rows = [(k, "é" * draw.randrange(60)) for k in range(2500)] + [(None, "x y"), (None, None), (9000, None), (9001, ""), (9002, "w" * 2000)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, size int, shard string, hi int").repartition(6)
    checked(rows, sharding.shard(docs, shards, rows_per_cell=cell).collect(), shards, 0.01)


def test_a_group_of_equal_texts_is_cut_where_the_bytes_ask_for_it(spark):
    rows = [(k, "the same text for all of them") for k in range(3000)] + [(5000 + k, f"another {k}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard(docs, 8).collect()
    checked(rows, out, 8, 0.02)
    hot = {}
    for r in out:
        if r.doc_id < 5000:
            hot[r.shard] = hot.get(r.shard, 0) + 1
    assert len(hot) >= 6 and max(hot.values()) < 700


def test_repeated_rows_stay_and_the_same_input_gives_the_same_shards(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "a b"), (3, "c" * 50)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted(map(tuple, sharding.shard(docs.repartition(n), 2).select("doc_id", "text_crc32", "shard").collect())) for n in (1, 5))
    assert one == two and len(one) == 12


def test_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0


def test_splitters_lie_where_exact_sums_are(spark):
    draw = random.Random(3)
    rows = [(k, "t" * draw.randrange(1, 400) + str(k)) for k in range(3000)]
    keyed = sharding._with_key(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    splitters = sharding.find_splitters(keyed, 5, tolerance=0.0)
    known = sorted((((r.hi & (1 << 64) - 1) << 64) | (r.lo & (1 << 64) - 1), r["size"]) for r in keyed.collect())
    total, largest = sum(n for _, n in known), max(n for _, n in known)
    for i, s in enumerate(splitters, 1):
        assert abs(sum(n for k, n in known if k < s) - total * i / 5) <= largest
