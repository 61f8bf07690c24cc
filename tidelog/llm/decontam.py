"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are hashed, every ``k`` neighbouring words give a k-gram hash, and of each
window of ``span - k + 1`` neighbouring k-grams the least hash (the first of
equal ones) is kept. Two texts that share ``span`` words share such a window
and so the kept k-gram in it: no shared span is missed. Kept k-grams of documents
are joined with those of the benchmark; each meeting brings the words around it,
and the spans of the item that contain the k-gram are compared with them word by
word. Spans that are equal are hits; overlapping hits join up to longer ones.

Items shorter than ``span`` are one span of their own length; winnowing gives no
guarantee there, so all word n-grams of these few lengths are joined, in the same pass,
if there are such items at all.

The benchmark's side is broadcast only if it is counted to be small; else both
sides are shuffled. Rows of a document are never gathered: what meets are single
k-grams with the words around.

Null and empty texts have no words. Each row is judged by its own text, whatever its doc_id, null and
repeated ones too; a repeated item_id counts once, an item of a null id not at all. Texts of any length are whole; there are no ties.
Empty tables give no hits. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words in lower-cased text (a fixed value).
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _GAP), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _positions(n: Column) -> Column:
    """0 up to below n."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def winnow(of_words: Column, k: int, span: int) -> Column:
    """The kept k-grams of an array of words: 31 bits of hash above 31 bits of position, for texts of at least ``span`` words."""
    window = span - k + 1
    hashes = F.transform(of_words, lambda w: F.xxhash64(w))

    def ranked(h: Column) -> Column:
        gram = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
        return F.transform(_positions(F.size(h) - (k - 1)), lambda i: F.shiftleft(gram(i).bitwiseAND(0x7FFFFFFF), 31).bitwiseOR(i.cast("long")))

    def least(r: Column) -> Column:
        return F.array_distinct(
            F.transform(_positions(F.size(r) - (window - 1)), lambda i: F.least(*[F.get(r, i + j) for j in range(window)]))
        )

    return _let(hashes, lambda h: _let(ranked(h), least))


def _short(of_words: Column, n: int) -> Column:
    """All n-grams of an array of words, packed as by :func:`winnow`."""
    gram = lambda i: F.xxhash64(F.lit(n), F.slice(of_words, i + 1, n))
    return F.transform(
        _positions(F.size(of_words) - (n - 1)), lambda i: F.shiftleft(gram(i).bitwiseAND(0x7FFFFFFF), 31).bitwiseOR(i.cast("long"))
    )


def _kept(rows: DataFrame, keys: list[str], k: int, span: int, lengths: list[int]) -> DataFrame:
    """Every row of ``rows`` once with a null gram, and once for each kept k-gram, and each n-gram of the ``lengths``.

    Columns: ``keys``, n_words, gram (its hash), at (its position), first and near, the words from ``span - k``
    before it to as many after. Words and k-grams are each made behind an ``explode``, which the optimizer doesn't copy.
    """
    around = span - k
    worded = rows.select(*keys, F.explode(F.array(F.coalesce(words(F.col("text")), F.array().cast("array<string>")))).alias("words"))
    own = F.when(F.size("words") >= span, winnow(F.col("words"), k, span)).otherwise(F.array().cast("array<bigint>"))
    codes = F.concat(F.array(F.lit(-1).cast("bigint")), own, *[_short(F.col("words"), n) for n in lengths])
    coded = worded.select(*keys, "words", F.explode(F.array(codes)).alias("codes"))
    spread = coded.select(*keys, "words", F.explode("codes").alias("r"))
    at = F.col("r").bitwiseAND(0x7FFFFFFF).cast("int")
    first = F.greatest(at - around, F.lit(0))
    real = F.col("r") >= 0
    return spread.select(
        *keys,
        F.size("words").cast("long").alias("n_words"),
        F.when(real, F.shiftright("r", 31)).alias("gram"),
        F.when(real, at).alias("at"),
        F.when(real, first).alias("first"),
        F.when(real, F.slice("words", first + 1, at + k + around - first)).alias("near"),
    )


def _meetings(docs: DataFrame, benchmark: DataFrame, span: int, k: int, most_broadcast: int) -> DataFrame:
    """row (a number of the document's row), doc_id and n_words of every row of ``docs``, with a null item_id, and
    row, doc_id, n_words, item_id, start and length of every span of it that is a span of an item. One pass over the texts.
    """
    items = benchmark.select("item_id", "text").distinct()
    short = items.select(F.size(words(F.col("text"))).alias("n")).where((F.col("n") > 0) & (F.col("n") < span)).distinct()
    lengths = sorted(r["n"] for r in short.collect())  # fewer than ``span`` numbers
    fits_own = (F.col("n_words") >= span) | (F.col("at") == 0) & (F.size("near") == F.col("n_words"))
    of_items = (
        _kept(items, ["item_id"], k, span, lengths).where("gram is not null")
        .withColumn("length", F.least("n_words", F.lit(span)).cast("int"))
        .where(fits_own)
        .select("item_id", "gram", "length", F.col("at").alias("i_at"), F.col("first").alias("i_first"), F.col("near").alias("i_near"))
        .distinct()
    )
    if of_items.count() <= most_broadcast:
        of_items = F.broadcast(of_items)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    met = _kept(rows, ["row", "doc_id"], k, span, lengths).join(of_items, "gram", "left").where("gram is null or item_id is not null")
    # a span that starts s words before the k-gram, for s from 0 to span - k, inside both texts; a short item starts at it
    back = F.sequence(F.lit(0), F.lit(span - k))
    here = lambda s: F.slice("near", F.col("at") - F.col("first") - s + 1, F.col("length"))
    there = lambda s: F.slice("i_near", F.col("i_at") - F.col("i_first") - s + 1, F.col("length"))
    fits = lambda s: (F.col("at") - F.col("first") >= s) & (F.col("i_at") - F.col("i_first") >= s)
    same = F.filter(back, lambda s: F.when(fits(s), (F.size(here(s)) == F.col("length")) & (here(s) == there(s))).otherwise(False))
    found = met.select(
        "row", "doc_id", "n_words", "item_id", "at", "length", F.explode(F.when(F.col("gram").isNull(), F.array(F.lit(0))).otherwise(same)).alias("s")
    )
    return found.select("row", "doc_id", "n_words", "item_id", (F.col("at") - F.col("s")).alias("start"), "length")


def find_spans(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 4, most_broadcast: int = 200_000) -> DataFrame:
    """doc_id, item_id, start and length of every span of a document that is a span of an item."""
    met = _meetings(docs, benchmark, span, k, most_broadcast)
    return met.where("item_id is not null").select("doc_id", "item_id", "start", "length").distinct()


def merge_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, start and end of the longest runs of words that spans cover, over all items."""
    order = Window.partitionBy(key).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.select(key, "start", (F.col("start") + F.col("length")).alias("stop")).distinct()
    runs = rows.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    return runs.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("stop").alias("end")).drop("run")


def report(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 4, most_broadcast: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as text), contaminated and text_hash for every row of ``docs``."""
    named = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("doc_id"), "text")
    met = scratch.keep(_meetings(named, benchmark, span, k, most_broadcast), "shared-spans")
    spans = met.where("item_id is not null").select("row", "item_id", "start", "length").distinct()
    covered = merge_spans(spans, "row").groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    found = (
        spans.select("row", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    hits = covered.join(found, "row")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return met.where("item_id is null").select("row", "doc_id", "n_words").join(hits, "row", "left").select(
        "doc_id.doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"), "doc_id.text_hash"
    )


#: The same report in DuckDB SQL, by comparing all spans.
ORACLE = r"""
WITH i AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, p, n, item_id FROM dw JOIN iw USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
