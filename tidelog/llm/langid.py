"""Language ID by nearest centroid.

A text is a normalised TF-IDF vector of hashed byte n-grams (two and three bytes,
A-Z lower-cased, everything in ASCII that isn't a letter as a blank). Each
language has several centroids, found by spherical k-means; a text gets the
language of the centroid with the highest cosine. It is rejected if that cosine
lies below what all but a small share of that language's texts of about its
length reach, or if it has no letter. Those cosines are of texts that their
centroids weren't fitted on: the sample's by leaving out a fifth of it in turn,
and all training texts outside of the sample. A group of copies counts once.

Document frequencies are counted over all training documents. The centroids are
fitted on a sample of at most about ``sample`` training documents of each
language, chosen by a hash of the text, in one task for each language: ``sample``
vectors of ``DIMENSIONS`` numbers. Centroids alone come to the driver.

Null texts, empty ones and ones without a letter are ``und`` with score 0. Long
texts count whole. Repeated rows get the same answer. Of equal cosines the first
language by name counts. An empty table gives an empty result; without any
training document every text is ``und``. Other columns, whatever their names, aren't read, null
ids neither; :func:`judge` is a column that a caller adds to any table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tokens import give_back, slices, tidy

#: Hashed n-grams: a power of two.
DIMENSIONS = 1 << 13

_KEEP = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Bytes and texts that are counted together.
_CHUNK, _ROWS = 1 << 19, 128
#: Buckets of length (powers of two of n-grams), bins of cosines, and parts of the sample left out in turn.
BUCKETS, BINS, FOLDS = 40, 2000, 5


def _counts(texts: list[bytes]) -> np.ndarray:
    """n-gram counts of every text, with blanks behind it: a row of DIMENSIONS each."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    raw = np.frombuffer(b"  ".join(texts).translate(_KEEP) + b"    ", np.uint8).astype(np.uint32)
    n = len(raw) - 2
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * DIMENSIONS, lengths)[:n]
    a, b, c = raw[:n], raw[1 : n + 1], raw[2 : n + 2]
    two = a << np.uint32(8) | b
    three = two << np.uint32(8) | c
    out = np.zeros(len(texts) * DIMENSIONS, np.int64)
    letters = (a != 32) | (b != 32)
    letters[np.cumsum(lengths) - 1] = False  # the second blank behind a text looks into the next one
    for grams, salt in ((two, 0x9E3779B1), (three, 0x85EBCA77)):
        mixed = (grams + np.uint32(1)) * np.uint32(salt)
        code = (mixed ^ mixed >> np.uint32(15)) & np.uint32(DIMENSIONS - 1)
        out += np.bincount((row + code)[letters], minlength=len(out))
    return out.reshape(len(texts), DIMENSIONS)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norms > 0, norms, 1)


def _buckets(counts: np.ndarray) -> np.ndarray:
    """The bucket of length of every row of counts."""
    return np.minimum(np.log2(1 + counts.sum(1)).astype(np.int64), BUCKETS - 1)


def _least(seen: np.ndarray, tail: float, enough: int) -> np.ndarray:
    """For each bucket the cosine that a share of 1 - ``tail`` reaches; ``seen`` counts texts by bucket and bin.

    A bucket of fewer than ``enough`` texts takes in those around it. If a language has fewer in all, the least cosine is
    that of a normal distribution, or the least one seen if it is lower.
    """
    out = np.zeros(BUCKETS)
    middles = (np.arange(BINS) + 0.5) / BINS
    for b in range(BUCKETS):
        around = seen[b]
        for w in range(1, BUCKETS):
            if around.sum() >= enough:
                break
            around = seen[max(b - w, 0) : b + w + 1].sum(0)
        n = around.sum()
        if n < 2:
            continue
        out[b] = np.argmax(np.cumsum(around) > tail * n) / BINS
        if n < enough:
            mean = (around * middles).sum() / n
            spread = np.sqrt((around * (middles - mean) ** 2).sum() / (n - 1))
            out[b] = max(0.0, min(out[b], mean + NormalDist().inv_cdf(tail) * spread))
    return out


def _judge(cosines: np.ndarray, languages: list[str], said: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bin of its highest cosine, and whether that is of the language it is said to be in (one for all, or each its own)."""
    found = np.array(languages, object)[np.argmax(cosines, axis=1)]
    return np.clip(np.max(cosines, axis=1) * BINS, 0, BINS - 1).astype(np.int64), (found == np.array(said, object)).astype(bool)


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def has_letter(text: Column) -> Column:
    """Whether a text has a letter of any script."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


@dataclass
class Model:
    """Centroids, the language of each, and the least cosine that each language accepts in each bucket of length."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: dict[str, np.ndarray]


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for a, b in slices(batch.column(0), _CHUNK, _ROWS):
                found += (_counts(_bytes(batch.column(0).slice(a, b - a))) > 0).sum(0)
            rows += batch.num_rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(found[at], rows), pa.int64())], ["gram", "n"])

    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for r in texts.mapInArrow(tidy(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        if r["gram"] < 0:
            n = r["n"]
        else:
            df[r["gram"]] = r["n"]
    return df, n


def _cosines(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Products of all vectors and centroids, some vectors at a time in double precision."""
    parts = [vectors[a : a + _ROWS].astype(np.float64) @ centroids.T for a in range(0, len(vectors), _ROWS)]
    return np.concatenate(parts) if parts else np.zeros((0, len(centroids)))


def _means(vectors: np.ndarray, times: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """The mean of the vectors of each of ``k`` clusters, each counted ``times``; zeros for a cluster without any."""
    weights = np.zeros((k, len(vectors)))
    weights[of, np.arange(len(vectors))] = times
    total = np.zeros((k, DIMENSIONS))
    for a in range(0, len(vectors), _ROWS):
        total += weights[:, a : a + _ROWS] @ vectors[a : a + _ROWS].astype(np.float64)
    return total / np.maximum(weights.sum(1, keepdims=True), 1)


def _clusters(vectors: np.ndarray, times: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, each vector counted ``times``, from far apart starts; the same rows give the same centroids."""
    chosen = [_means(vectors, times, np.zeros(len(vectors), np.int64), 1)[0]]
    for _ in range(min(k, len(vectors)) - 1):
        nearest = np.max(_cosines(vectors, np.array(chosen)), axis=1)
        chosen.append(vectors[int(np.argmin(nearest))].astype(np.float64))
    centroids = np.array(chosen)
    for _ in range(rounds):
        nearest = np.argmax(_cosines(vectors, centroids), axis=1)
        means = _means(vectors, times, nearest, len(centroids))
        some = np.bincount(nearest, minlength=len(centroids)) > 0
        centroids = np.where(some[:, None], means, centroids)
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-9)
    return centroids.astype(np.float32)


def fit(training: DataFrame, sample: int = 800, per_language: int = 3, tail: float = 0.001, enough: int = 50) -> Model | None:
    """A model from rows of text and lang (both not null).

    ``tail``: a text is rejected below the cosine that a share of 1 - ``tail`` of its language's texts of
    about its length reach, seen on ``enough`` texts at least.
    """
    lettered = training.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("text", "lang")
    df, n = _document_frequencies(lettered.select("text"))
    if not n:
        return None
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 0.1, 0).astype(np.float32)
    sizes = {r["lang"]: r["count"] for r in lettered.groupBy("lang").count().collect()}
    share = F.lit(None).cast("double")
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / size))).otherwise(share)
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), _CHUNK, _ROWS):
                counts = _counts(_bytes(batch.column(0).slice(a, b - a)))
                v = _vectors(counts, idf).astype(np.float16)
                raw = [x.tobytes() for x in v]
                columns = [batch.column(1)[a:b], pa.array(raw, pa.binary()), pa.array(_buckets(counts)), batch.column(2).slice(a, b - a), pa.array([zlib.crc32(x) % FOLDS for x in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "vector", "bucket", "times", "fold"])

    # copies once, so that a group of them can't outgrow the sample
    drawn = lettered.where(draw < share).groupBy("lang", F.xxhash64("text").alias("hash")).agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("times"))
    vectors = scratch.keep(drawn.select("text", "lang", "times").mapInArrow(tidy(run), "lang string, vector binary, bucket long, times long, fold long"), "langid-vectors")

    def cluster(group: pa.Table) -> pa.Table:
        order = sorted(range(len(group)), key=list(zip(group["vector"].to_pylist(), group["bucket"].to_pylist(), group["times"].to_pylist())).__getitem__)
        times, fold = group["times"].to_numpy()[order], group["fold"].to_numpy()[order]
        found: dict[str, list] = {"lang": [], "left_out": [], "place": [], "centroid": []}
        for f in range(-1, FOLDS):
            own = np.flatnonzero(fold != f)
            if len(own):
                v = np.empty((len(own), DIMENSIONS), np.float16)
                for k, at in enumerate(own.tolist()):
                    v[k] = np.frombuffer(group["vector"][order[at]].as_buffer(), np.float16)
                for k, c in enumerate(_clusters(v, times[own], per_language)):
                    for name, value in zip(found, (group["lang"][0].as_py(), f, k, c.tobytes())):
                        found[name].append(value)
        give_back()
        return pa.table(found, schema=pa.schema([("lang", pa.string()), ("left_out", pa.int32()), ("place", pa.int32()), ("centroid", pa.binary())]))

    clustered = vectors.groupBy("lang").applyInArrow(cluster, "lang string, left_out int, place int, centroid binary").collect()
    without: dict[int, tuple[np.ndarray, list[str]]] = {}
    for f in range(-1, FOLDS):
        own = sorted((r["lang"], r["place"], bytes(r["centroid"])) for r in clustered if r["left_out"] == f)
        without[f] = np.frombuffer(b"".join(c for _, _, c in own), np.float32).reshape(-1, DIMENSIONS), [lang for lang, _, _ in own]
    centroids, languages = without[-1]
    seen = {lang: np.zeros((BUCKETS, BINS), np.int64) for lang in languages}

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(3).to_numpy()
            for f in np.unique(fold).tolist():
                around, names = without[f]
                said = [lang in names for lang in batch.column(0).to_pylist()]
                for at in np.array_split(np.flatnonzero((fold == f) & said), len(fold) // _ROWS + 1):
                    if len(at):
                        part = batch.take(pa.array(at))
                        v = np.frombuffer(b"".join(part.column(1).to_pylist()), np.float16).reshape(-1, DIMENSIONS)
                        place, right = _judge(v.astype(np.float32) @ around.T, names, part.column(0).to_pylist())
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(place)], ["lang", "bucket", "place"]).filter(pa.array(right))

    own_part = vectors.select("lang", "vector", "bucket", "fold").mapInArrow(tidy(left_out), "lang string, bucket long, place long")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), _CHUNK, _ROWS):
                counts = _counts(_bytes(batch.column(0).slice(a, b - a)))
                place, right = _judge(_vectors(counts, idf) @ centroids.T, languages, batch.column(1)[a:b].to_pylist())
                columns = [batch.column(1)[a:b], batch.column(2)[a:b], pa.array(_buckets(counts)), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "hash", "bucket", "place"]).filter(pa.array(right))

    others = lettered.where(draw >= share).select("text", "lang", F.xxhash64("text").alias("hash"))
    judged = others.mapInArrow(tidy(rest), "lang string, hash long, bucket long, place long").distinct()
    for r in judged.select("lang", "bucket", "place").unionByName(own_part).groupBy("lang", "bucket", "place").agg(F.count(F.lit(1)).alias("n")).collect():
        if r["lang"] in seen:
            seen[r["lang"]][r["bucket"], r["place"]] += r["n"]
    give_back()
    return Model(idf, centroids, languages, {lang: _least(s, tail, enough) for lang, s in seen.items()})


PREDICTED = "lang_pred string, score double, rejected boolean"


def judge(text: Column, model: Model | None) -> Column:
    """A struct of lang_pred, score (the cosine) and rejected of a text. Only the text goes through Python."""
    if model is None:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    least = np.array([model.least[x] for x in model.languages])  # by centroid and bucket

    @F.arrow_udf(PREDICTED)
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n = len(batch)
            ok = batch.is_valid().to_numpy(zero_copy_only=False)
            best, score, bucket = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
            for a, b in slices(batch, _CHUNK, _ROWS):
                counts = _counts(_bytes(batch.slice(a, b - a)))
                bucket[a:b] = _buckets(counts)
                cosines = _vectors(counts, model.idf) @ model.centroids.T
                best[a:b] = np.argmax(cosines, axis=1)
                score[a:b] = np.clip(np.max(cosines, axis=1), 0, 1)
            languages = [model.languages[k] if o else "und" for k, o in zip(best.tolist(), ok.tolist())]
            rejected = ~ok | (score < least[best, bucket])
            yield pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(rejected)], ["lang_pred", "score", "rejected"])

    return run(F.when(has_letter(text), text))


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score (the cosine) and rejected of every row of ``docs``."""
    judged = docs.select(*keep, judge(F.col("text"), model).alias("_judged"))
    return judged.select(*keep, "_judged.lang_pred", "_judged.score", "_judged.rejected")


def held_out(doc_id: Column, of: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == remainder, F.lit(False))
