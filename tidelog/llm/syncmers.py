"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text's words (runs without white space) make k-mers of ``K`` words; a k-mer is
kept if the least hash of its inner runs of ``S`` words lies at its first or last
place. Whether it is kept depends on its own words alone, so two texts that share
a passage keep the same k-mers in it wherever it stands: anchors by which
passages can be aligned (:func:`anchors`, :func:`align`). A text of fewer than
``K`` words, or one of which no k-mer is kept, has one anchor, its whole text.

The fingerprint is a bottom sketch of the anchors: the ``SKETCH`` of least
distinct hashes, each with its first place, in hexadecimal. The likeness of two
fingerprints matches them by hash and place: it estimates the Jaccard similarity of the anchor
sets from the least hashes of their union, and counts common anchors that moved together; two
texts without words are alike (1), one with and one without aren't (0).

Null and empty texts have an empty fingerprint. Equal texts have equal ones. Repeated rows are rows of their own,
next to each other by doc_id and a hash of the text, and fully equal ones are alike in any order; a null doc_id comes first. An
empty table gives an empty result. Other columns of the input are ignored. Long texts count whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a k-mer, words of its inner runs, and anchors of a fingerprint.
K, S, SKETCH = 4, 2, 64


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _positions(n: Column) -> Column:
    """0 up to below n."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _at_words(text: Column, each, whole) -> Column:
    """``each(i, runs)`` of every k-mer's place where it is kept, as an array; ``whole`` of a shorter text's words."""
    between = K - S

    def of_runs(runs: Column) -> Column:
        def place(i: Column) -> Column:
            edge = F.least(F.get(runs, i), F.get(runs, i + between))
            inner = F.least(*[F.get(runs, i + j) for j in range(1, between)]) if between > 2 else F.get(runs, i + 1)
            return F.when(edge <= inner, each(i, runs))

        return F.array_compact(F.transform(_positions(F.size(runs) - between), place))

    def of_words(w: Column) -> Column:
        runs = F.transform(_positions(F.size(w) - (S - 1)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(S)]))
        kept = F.when(F.size(w) >= K, _let(runs, of_runs))
        return _let(kept, lambda k: F.when(F.size(k) > 0, k).when(F.size(w) > 0, F.array(whole(w))))

    return _let(_words(text), of_words)


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(0xFFFFFFFF)


def anchors(text: Column) -> Column:
    """Places (number of the first word) and 32-bit hashes of the kept k-mers, in order; null without words."""
    return _at_words(
        text,
        lambda i, runs: F.struct(i.alias("at"), _hash(F.get(runs, i), F.get(runs, i + K - S)).alias("hash")),
        lambda w: F.struct(F.lit(0).alias("at"), _hash(F.array_join(w, " ")).alias("hash")),
    )


def _code(hash_: Column, at: Column) -> Column:
    """A hash of 32 bits above a place of 31 bits."""
    return F.shiftleft(hash_, 31).bitwiseOR(at.cast("bigint"))


def _place(code: Column) -> Column:
    return code.bitwiseAND(0x7FFFFFFF)


def sketch(text: Column) -> Column:
    """The SKETCH anchors of least distinct hashes, each with its first place, as ascending codes; empty without words."""
    codes = _at_words(text, lambda i, runs: _code(_hash(F.get(runs, i), F.get(runs, i + K - S)), i), lambda w: _code(_hash(F.array_join(w, " ")), F.lit(0)))
    new = lambda all_: F.filter(all_, lambda c, k: (k == 0) | (F.shiftright(F.get(all_, k - 1), 31) != F.shiftright(c, 31)))
    return F.coalesce(_let(F.sort_array(codes), lambda all_: F.slice(new(all_), 1, SKETCH)), F.array().cast("array<bigint>"))


def as_text(of: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits for each anchor."""
    return F.array_join(F.transform(of, lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches' anchors, of which only those count that lie in passages.

    The estimate is over the least hashes of the union. An anchor of both counts if another one has moved as far, so
    that words which meet by chance don't; an only common anchor counts.
    """
    hashes = lambda of: F.transform(of, lambda c: F.shiftright(c, 31))
    least = F.slice(F.sort_array(F.array_union(hashes(a), hashes(b))), 1, SKETCH)
    places = F.map_from_arrays(hashes(b), F.transform(b, _place))

    def estimate(u: Column) -> Column:
        top = F.get(u, F.size(u) - 1)
        low = F.filter(a, lambda c: F.shiftright(c, 31) <= top)
        shifts = _let(places, lambda at: F.array_compact(F.transform(low, lambda c: F.try_element_at(at, F.shiftright(c, 31)) - _place(c))))
        together = lambda s: F.when(F.size(s) < 2, F.size(s)).otherwise(F.size(F.filter(s, lambda x: F.size(F.filter(s, lambda y: y == x)) > 1)))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(_let(shifts, together) / F.size(u))

    return _let(least, estimate)


def align(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Anchors of ``left`` texts that ``right`` texts hold too: both keys, both places and the shift between them."""
    spread = lambda df, side: df.select(F.col(key).alias(f"{side}_{key}"), F.explode(anchors(F.col("text"))).alias("a")).select(f"{side}_{key}", F.col("a.at").alias(f"{side}_at"), F.col("a.hash").alias("hash"))
    return spread(left, "left").join(spread(right, "right"), "hash").withColumn("shift", F.col("right_at") - F.col("left_at"))


def _with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` (doc_id, text, own) with next_text and next_own of the document that follows by doc_id, the first after the last.

    Rows are exchanged once, by ranges of doc_id. Each range also gets the first row of
    the range after it, so that no order over all rows is needed. Rows with equal doc_id go by a hash of
    the text. The driver holds ``buckets`` bounds; a row finds its range in two steps of their square root.
    """
    spark = docs.sparkSession
    shares = [k / buckets for k in range(1, buckets)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * buckets)).alias("b")).first()["b"] if buckets > 1 else []
    bounds = sorted(set(bounds or []))
    if bounds:
        step = max(1, math.isqrt(len(bounds)))
        coarse = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]])
        fine = F.array(*[F.lit(b) for b in bounds])
        passed = lambda of: F.size(F.filter(of, lambda b: b < F.col("doc_id")))
        low = passed(coarse) * step
        bucket = low + passed(F.slice(fine, low + 1, F.lit(step)))
    else:
        bucket = F.lit(0)
    ids = docs.select("doc_id", F.xxhash64("text").alias("tie"), bucket.cast("int").alias("bucket"))
    firsts = ids.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("f")).select("bucket", "f.*").orderBy("bucket").collect()
    before = [(r["bucket"], r["doc_id"], r["tie"], firsts[k - 1]["bucket"]) for k, r in enumerate(firsts)]
    table = spark.createDataFrame(before, "bucket int, doc_id long, tie long, before int")  # a row for each bucket
    rows = docs.withColumn("tie", F.xxhash64("text")).withColumn("bucket", bucket.cast("int"))
    same = (rows["bucket"] == table["bucket"]) & (rows["tie"] == table["tie"]) & rows["doc_id"].eqNullSafe(table["doc_id"])
    marked = rows.join(F.broadcast(table), same, "left").select(rows["doc_id"], "text", "own", rows["tie"], rows["bucket"], "before")
    here = F.struct(F.col("bucket").alias("part"), F.lit(0).alias("extra"))
    copies = F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("before").alias("part"), F.lit(1).alias("extra"))))
    dealt = marked.select("doc_id", "text", "own", "tie", F.explode(copies).alias("c")).select("doc_id", "text", "own", "tie", "c.part", "c.extra")
    order = Window.partitionBy("part").orderBy("extra", F.asc_nulls_first("doc_id"), "tie")
    return (
        dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_own", F.lead("own").over(order))
        .where("extra = 0").select("doc_id", "text", "own", "next_text", "next_own")
    )


def compare_edited(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """For every row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has its last quarter of code points replaced by as many of the next document's first.
    """
    parts = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = _with_next(own.withColumn("own", sketch(F.col("text"))), parts)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    whole = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    # the sketch of the edited text is needed three times: explode keeps it from being computed as often
    sketched = whole.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "next_own", F.explode(F.array(sketch(F.col("edited")))).alias("changed"))
    return sketched.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
