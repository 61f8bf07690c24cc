"""Packing, binary token files and the cached tokenizer, against plain versions."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelog.llm import packing, scratch, tokenbin
from tidelog.llm.tokens import Coder, in_parts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "This.", "a  b\n c", " lead", "trail ", "\n\n x \t y", "it's  don't", "Mixed, CASE. $$$ a$$$, b.$ 9, é.. .. x'. ''", "é́ ́x ÉÀ ΑΣ", "word " * 5000, "same text", "same text", "\x1c a \x85b", "😀 😀x", "a<|endoftext|>b", "c <|startoftext|> , d<|endoftext|>", "x\u00a0 y\u3000  z\u2003", "İx ŉ, Straße."]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(3 * i, t, "x", i, 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, start int, length int")


def plain(path):
    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path, spaces", [(WORDS, False), (BYTES, True)])
def test_cached_ids_are_the_tokenizers(path, spaces):
    own, other = Coder(path, spaces, most=5), plain(path)
    for texts in (TEXTS, TEXTS[::-1], ["  ", "\n", " \n ", "x y", "a<|endoftext|>b"]):
        ids, n = own.encode([t or "" for t in texts])
        assert np.split(ids, np.cumsum(n)[:-1])[0].dtype == np.uint32
        for got, t in zip(np.split(ids, np.cumsum(n)[:-1]), texts):
            assert got.tolist() == other.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t'sé.,1\x1c　Σ\x85\xa0—\u0301İ|<"), max_size=20), max_size=4))
def test_cached_ids_of_any_text(texts):
    for path, spaces in ((WORDS, False), (BYTES, True)):
        own = _coders.get(path) or _coders.setdefault(path, (Coder(path, spaces), plain(path)))
        ids, n = own[0].encode(texts)
        assert ids.tolist() == [i for t in texts for i in own[1].encode(t, add_special_tokens=False).ids]


_coders: dict = {}


def test_in_parts_covers_the_list():
    assert list(in_parts(["aa", None, "b" * 9, "c"], 5)) == [(0, 2), (2, 3), (3, 4)]
    assert list(in_parts([], 5)) == []


def test_pack_places_every_piece_once(docs):
    rows = packing.pack(docs, WORDS, 2048).collect()
    other = plain(WORDS)
    expected = {}
    for i, t in enumerate(TEXTS):
        ids = np.array([*other.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            expected[3 * i, k] = (s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r["offset"], r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(rows) == len(expected)
    assert len(by) <= -(-sum(v[1] for v in expected.values()) // 2048) + 1


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 40), max_size=30))
def test_plan_uses_each_length_as_often_as_given(counts):
    used, bins = {}, packing.plan(counts, 30)
    for b in bins:
        assert b.count > 0 and sum(n * k for n, k in b.runs) == 30 - b.gap and b.gap >= 0
        assert sum(k for n, k in b.runs if 3 * n > 30) <= 2
        for n, k in b.runs:
            used[n] = used.get(n, 0) + k * b.count
    assert used == {n: c for n, c in counts.items() if c}
    total = sum(n * c for n, c in counts.items())
    assert sum(b.count for b in bins) <= 2 * total / 30 + 1  # all sequences but one are more than half full


def test_pack_an_empty_table(spark, docs):
    assert packing.pack(docs.limit(0), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1]), max_size=23))
def test_ranks_come_back(ranks):
    control, data = tokenbin.encode_ranks(np.array(ranks, np.uint32))
    assert len(control) == -(-len(ranks) // 4)
    assert tokenbin.decode_ranks(control, data, len(ranks)).tolist() == ranks


@pytest.mark.parametrize("block", [3, 1000])
def test_files_read_back(spark, docs, block):
    path = scratch.new_path(spark, "test-token-files")
    tokenbin.write(docs, path, BYTES, 2, block)
    rows = tokenbin.read(spark, path, with_ids=True).orderBy("doc_id").collect()
    start, other = 0, plain(BYTES)
    for i, (r, t) in enumerate(zip(rows, TEXTS, strict=True)):
        ids = [*other.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (3 * i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_files_of_an_empty_table(spark, docs):
    path = scratch.new_path(spark, "test-token-files")
    tokenbin.write(docs.limit(0), path, BYTES)
    assert tokenbin.read(spark, path).count() == 0


def test_null_ids_and_equal_ids_in_files(spark):
    rows = [(None, "a b"), (2, "c"), (None, None), (2, "c"), (2, "d e"), (1, "x " * 3000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n long, control int").repartition(3)
    path = scratch.new_path(spark, "test-token-files")
    tokenbin.write(docs, path, BYTES, 2, block_ids=4, file_ids=1500)
    got = sorted(tokenbin.read(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 2, 2, 2]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    other = plain(BYTES)
    assert sorted(tuple(r.ids) for r in got) == sorted((*other.encode(t or "", add_special_tokens=False).ids, 2) for _, t in rows)
