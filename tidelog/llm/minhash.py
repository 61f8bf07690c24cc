"""Near-duplicate documents by a signature-coordinate inverted join.

A document is the set of its distinct shingles of five words (all its words, if
fewer); its MinHash signature has ``COORDINATES`` values. Documents with equal sets
are one class. Classes are posted under each (coordinate, value) pair, and two
classes match if they collide in at least ``MATCH`` coordinates:

* Postings of one class only can't collide and go first. A class with fewer than
  ``MATCH`` postings left has no match.
* Prefix: ordered by the length of their lists, only the shortest lists of a
  class, its postings less ``MATCH`` - 1, are kept. Two matching classes share at
  least one of them.
* Skip: lists with the same members are read once, and so is a pair, in the first list that both are in. Pairs that
  are linked already are skipped, and collisions are counted for the rest only.

Only classes of pairs at or above the match threshold have their full sets fetched, which confirm. MATCH lies far
below what a pair of the least similarity reaches, so that confirming, not the signature, decides. That happens twice:

* Each list's classes are compared with one of them, its hub. In a group of near copies that links most, at a
  cost in proportion to the list, and classes linked to one hub are one label.
* Lists of several labels are read in tasks of two blocks of at most ``BLOCK`` classes, by signatures alone. A task
  names its classes that have a match of another label; no pair leaves it. Their sets are fetched, and tasks return
  a spanning forest of confirmed links.

Components of the links are found by repeatedly giving each class the least label around it, with labels
jumping ahead, until none changes; the driver holds none of them.

Exact copies cost one row each: signatures are combined by class before the
shuffle, and the class of a copy is found by an equi-join that Spark can split.

Null and empty texts, and texts without words, have an empty set and are linked
with nothing. Rows of a null doc_id get an id by a hash of their text, from 2 ** 62 up,
as component_id where no other id is in the component; of such rows with equal
texts at most one is kept. Repeated rows: rows of one doc_id with different texts are linked
to each other, as one document; each input row is returned. An empty table gives
an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tokens import slices, tidy

#: Values of a signature, and collisions of a match. A pair of similarity 0.85 has fewer than 10 of 24 with probability
#: 1.5e-7, one of 0.8 with 6.7e-6 (the binomial sum).
COORDINATES, MATCH = 24, 10
#: Classes in a block, of signatures or of sets, and classes that share a copy of their hub's set.
BLOCK, WITH_HUB = 1024, 256

_U = np.uint64
_ALL = (1 << 64) - 1
_SEED = np.random.Generator(np.random.PCG64(20240229))
#: A random value for each byte, odd powers for places in a word, and multipliers of the coordinates.
_BYTES = _SEED.integers(0, 1 << 64, 256, dtype=_U)
_STEP = 0xD6E8FEB86659FD93
_MULTIPLY = _SEED.integers(0, 1 << 64, COORDINATES, dtype=_U) | _U(1)
_ADD = _SEED.integers(0, 1 << 64, COORDINATES, dtype=_U)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = np.ones(1, _U)
_inverses = np.ones(1, _U)


def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of its inverse modulo 2 ** 64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_STEP, -1, 1 << 64)
        for of, name in ((_STEP, "_powers"), (inverse, "_inverses")):
            out = np.full(size, of, _U)
            out[0] = 1
            globals()[name] = np.cumprod(out, dtype=_U)
    return _powers, _inverses


def shingle_hashes(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (UTF-8)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    raw = np.frombuffer((b" ".join(texts) + b" ").translate(_LOWER), np.uint8) if texts else np.zeros(0, np.uint8)
    ends_of = np.cumsum(lengths)
    blank = _BLANK[raw]
    inside = ~blank
    start = np.flatnonzero(inside & np.append(True, blank[:-1]))
    end = np.flatnonzero(blank & np.append(False, inside[:-1]))
    powers, inverses = _powers_up_to(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[raw] * powers[: len(raw)], dtype=_U)])
    word = _mix((sums[end] - sums[start]) * inverses[start] + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15))
    first = np.searchsorted(start, np.concatenate([[0], ends_of]))
    out = []
    window = np.zeros(max(len(word) - words + 1, 0), _U)
    for j in range(words):
        window += _mix(word[j : j + len(window)] + _U((j + 1) * 0xA0761D6478BD642F & _ALL))
    window = _mix(window)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(window[a : b - words + 1]))
        elif b > a:
            own = sum((_mix(word[a + j : a + j + 1] + _U((j + 1) * 0xE7037ED1A0B428DB & _ALL)) for j in range(b - a)), np.zeros(1, _U))
            out.append(_mix(own + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES values of 63 bits for each set; an empty set has zeros."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros((len(sets), COORDINATES), np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[k] for k in full])
        at = np.cumsum(sizes[full]) - sizes[full]
        for c in range(COORDINATES):
            x = flat * _MULTIPLY[c] + _ADD[c]
            x ^= x >> _U(32)
            x *= _U(0xD6E8FEB86659FD93)
            out[full, c] = np.minimum.reduceat(x >> _U(1), at).astype(np.int64)
    return out


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


SIGNED = "no_id boolean, text_hash long, doc_id long, n_shingles long, set1 long, set2 long, signature array<bigint>"


def signed(docs: DataFrame) -> DataFrame:
    """no_id, doc_id, n_shingles, two hashes of the whole set and the signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 19):
                sets = shingle_hashes(_bytes(batch.column(1).slice(a, b - a)))
                sizes = np.fromiter(map(len, sets), np.int64, b - a)
                one = np.array([s.sum(dtype=_U) for s in sets], _U)
                two = np.array([_mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) for s in sets], _U)
                values = signatures(sets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * COORDINATES, pa.int32()), pa.array(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (2, 3, 0)), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), flat], ["no_id", "text_hash", "doc_id", "n_shingles", "set1", "set2", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text", "no_id", F.xxhash64("text").alias("text_hash")).mapInArrow(tidy(run), SIGNED)


def candidate_lists(classes: DataFrame) -> DataFrame:
    """Members of the lists that hold all matching pairs: coordinate, value and doc_id.

    ``classes``: doc_id, n_shingles and signature, one row each.
    """
    posted = classes.select("doc_id", "n_shingles", F.posexplode("signature").alias("coordinate", "value"))
    counts = posted.groupBy("coordinate", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    colliding = posted.join(counts, ["coordinate", "value"]).groupBy("doc_id", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("n", "coordinate", "value"))).alias("own"))
    prefix = colliding.where(F.size("own") >= MATCH).select("doc_id", "n_shingles", F.explode(F.slice("own", F.lit(1), F.size("own") - (MATCH - 1))).alias("p"))
    members = scratch.keep(prefix.select("doc_id", "n_shingles", "p.coordinate", "p.value"), "minhash-lists")
    mixed = lambda *salt: F.bit_xor(F.xxhash64("doc_id", *salt))
    lists = members.groupBy("coordinate", "value").agg(
        F.count(F.lit(1)).alias("in_list"), F.sum("n_shingles").alias("list_shingles"), mixed().alias("m1"), mixed(F.lit(1)).alias("m2"), F.min("doc_id").alias("m3")
    ).where("in_list > 1")
    once = lists.groupBy("in_list", "list_shingles", "m1", "m2", "m3").agg(F.min(F.struct("coordinate", "value")).alias("l"))
    return members.select("coordinate", "value", "doc_id").join(once.select("l.coordinate", "l.value"), ["coordinate", "value"])


def _tasks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each task, which follow each other; the first ``keys`` columns are numbers that name it."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(k).to_numpy() for k in range(keys)], axis=1)
        starts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
        for a, b in zip(starts, starts[1:]):
            if held and tuple(names[a]) != now:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = tuple(names[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def shingled(docs: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id and shingles (the sorted set's bytes) of the documents in ``names``. A doc_id with different texts has a row for each."""
    names = F.broadcast(names) if names.count() <= 1_000_000 else names  # 8 bytes each

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 19):
                own = shingle_hashes(_bytes(batch.column(1).slice(a, b - a)))
                whole = np.array([s.sum(dtype=_U) for s in own], _U).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(whole), pa.array([s.tobytes() for s in own], pa.binary())], ["doc_id", "own", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(names, "doc_id", "left_semi")
    hashed = texts.mapInArrow(tidy(sets), "doc_id long, own long, shingles binary")
    return hashed.groupBy("doc_id", "own").agg(F.first("shingles").alias("shingles")).select("doc_id", "shingles")


def _enough(a: str, b: str) -> Column:
    """Whether two signatures collide in MATCH coordinates or more."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) >= MATCH


def hub_links(members: DataFrame, signatures_: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """a and b: confirmed links between the classes of a list and its hub, the class with the least hash in it."""
    hubs = members.groupBy("coordinate", "value").agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")).alias("hub")).select("coordinate", "value", F.col("hub.doc_id").alias("hub"))
    pairs = members.join(hubs, ["coordinate", "value"]).where("doc_id <> hub").select("doc_id", "hub").distinct()
    of_hub = signatures_.select(F.col("doc_id").alias("hub"), F.col("signature").alias("hub_signature"), F.col("n_shingles").alias("hub_shingles"))
    small, large = F.least("n_shingles", "hub_shingles"), F.greatest("n_shingles", "hub_shingles")
    matching = pairs.join(signatures_.select("doc_id", "signature", "n_shingles"), "doc_id").join(of_hub, "hub").where((100 * small >= percent * large) & _enough("signature", "hub_signature"))
    matched = scratch.keep(matching.select("doc_id", "hub"), "minhash-hubs")
    with_hub = matched.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / WITH_HUB).alias("parts"))
    dealt = matched.join(with_hub, "hub").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).select("hub", "part", "doc_id", F.lit(1).alias("place"))
    copies = with_hub.select("hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.col("hub").alias("doc_id"), F.lit(0).alias("place"))
    names = matched.select("doc_id").union(matched.select("hub")).distinct()
    rows = dealt.unionByName(copies).join(shingled(docs, names), "doc_id")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in _tasks(batches, 2):
            place, names = task.column("place").to_numpy(), task.column("doc_id").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), _U) for x in task.column("shingles")]
            found = []
            for k in np.flatnonzero(place == 1).tolist():
                for j in np.flatnonzero(place == 0).tolist():  # one, but for a repeated doc_id
                    if _alike(sets[k], sets[j], percent):
                        found.append((int(names[k]), int(names[j])))
                        break
            yield _pairs(found)

    ordered = rows.repartition(F.col("hub"), F.col("part")).sortWithinPartitions("hub", "part", "place")
    return ordered.select("hub", "part", "place", "doc_id", "shingles").mapInArrow(tidy(confirm), "a long, b long")


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= ``percent`` * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def confirmed_links(members: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """a and b: links of pairs in a list with 100 * intersection >= ``percent`` * union, less those that follow from others."""
    masks = members.groupBy("doc_id").agg(F.expr("bit_or(shiftleft(1, coordinate))").alias("mask"))
    signatures_ = scratch.keep(classes.join(masks, "doc_id").select("doc_id", "n_shingles", "mask", "signature"), "minhash-signatures")
    near = scratch.keep(hub_links(members, signatures_, docs, percent), "minhash-near")
    labels = near.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("label"))
    labelled = members.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    open_ = labelled.groupBy("coordinate", "value").agg(F.count(F.lit(1)).alias("in_list"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    dealt = (
        labelled.select("coordinate", "value", "doc_id", "label").join(open_.select("coordinate", "value", "in_list"), ["coordinate", "value"])
        .withColumn("blocks", F.ceil(F.col("in_list") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("coordinate", "value", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "doc_id", "label")
    )
    keys = ["coordinate", "value", "x", "y"]
    tasks = dealt.join(signatures_, "doc_id").repartition(*map(F.col, keys)).sortWithinPartitions(*keys, "block", "doc_id")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in _tasks(batches, 4):
            left, right, match = _matches(task, percent)
            busy = np.unique(np.concatenate([left[match.any(1)], right[match.any(0)]]))
            columns = ["coordinate", "value", "x", "y", "block", "doc_id", "label", "mask", "n_shingles", "signature"]
            for batch in task.select(columns).take(pa.array(busy)).to_batches():
                yield batch

    columns = "coordinate int, value long, x int, y int, block int, doc_id long, label long, mask int, n_shingles long, signature array<bigint>"
    busy = scratch.keep(tasks.select(*keys, "block", "doc_id", "label", "mask", "n_shingles", "signature").mapInArrow(tidy(matched), columns), "minhash-busy")
    again = busy.join(shingled(docs, busy.select("doc_id").distinct()), "doc_id").repartition(*map(F.col, keys)).sortWithinPartitions(*keys, "block", "doc_id")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in _tasks(batches, 4):
            yield _pairs(_links(task, percent))

    return near.unionByName(again.select(*keys, "block", "doc_id", "label", "mask", "n_shingles", "signature", "shingles").mapInArrow(tidy(link), "a long, b long"))


def _matches(task: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two blocks' rows, and which pairs of them match, have different labels, and are met first in this list."""
    block, coordinate = task.column("block").to_numpy(), task.column("coordinate")[0].as_py()
    sign = task.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
    label, mask, sizes = (task.column(c).to_numpy() for c in ("label", "mask", "n_shingles"))
    n = len(block)
    cut = int(np.searchsorted(block, block[-1])) if task.column("x")[0] != task.column("y")[0] else 0
    left, right = (np.arange(cut), np.arange(cut, n)) if cut else (np.arange(n),) * 2
    met, first = np.zeros((len(left), len(right)), np.uint8), np.ones((len(left), len(right)), bool)
    for c in range(COORDINATES):
        same = sign[left, c][:, None] == sign[right, c][None, :]
        met += same
        if c < coordinate:  # a pair belongs to the first list that both are in
            first &= ~(same & (((mask[left] >> c) & 1)[:, None] & ((mask[right] >> c) & 1)[None, :]).astype(bool))
    match = (met >= MATCH) & first & (label[left][:, None] != label[right][None, :])
    i, j = np.nonzero(match)
    match[i, j] = 100 * np.minimum(sizes[left[i]], sizes[right[j]]) >= percent * np.maximum(sizes[left[i]], sizes[right[j]])
    if not cut:
        match = np.triu(match, 1) if task.column("x")[0] == task.column("y")[0] else np.zeros_like(match)
    return left, right, match


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])


def _links(task: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Confirmed links among the rows of a task, as a spanning forest. Pairs inside a block belong to the task of that block alone."""
    left, right, match = _matches(task, percent)
    if not match.any():
        return []
    docs = task.column("doc_id").to_pylist()
    sets = [np.frombuffer(x.as_buffer(), _U) for x in task.column("shingles")]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    rows = docs
    root = list(range(len(rows)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    found = []

    def confirm(i: int, j: int, common: int) -> None:
        if 100 * common >= percent * (sizes[i] + sizes[j] - common) and (a := find(i)) != (b := find(j)):
            root[max(a, b)] = min(a, b)
            found.append((docs[i], docs[j]))

    if match.sum() <= 64:
        for i, j in np.argwhere(match):
            i, j = int(left[i]), int(right[j])
            if find(i) != find(j):
                confirm(i, j, len(np.intersect1d(sets[i], sets[j], assume_unique=True)))
        return found
    # all intersections at once: columns are the shingles of more than one set, a part of them at a time
    busy = np.unique(np.concatenate([left[match.any(1)], right[match.any(0)]]))
    flat = np.concatenate([sets[k] for k in busy])
    owner = np.repeat(busy, sizes[busy])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    use = shared[column]
    column = (np.cumsum(shared) - 1)[column[use]]
    owner = owner[use]
    common = np.zeros((len(left), len(right)), np.float32)
    width = 1024
    for first in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [first, first + width])
        held = np.zeros((len(rows), width), np.float32)
        held[owner[a:b], column[a:b] - first] = 1
        common += held[left] @ held[right].T
    both = sizes[left][:, None] + sizes[right][None, :] - common
    for i, j in np.argwhere(match & (100 * common >= percent * both)):
        confirm(int(left[i]), int(right[j]), int(common[i, j]))
    return found


def components(links: DataFrame) -> DataFrame:
    """doc_id and component_id (the least doc_id reachable) of every end of a link.

    Each round gives every end the least label among its own and its neighbours',
    then the label of that label; it ends when no label changes.
    """
    both = scratch.keep(links.union(links.select("b", "a")).toDF("a", "b").where("a <> b").distinct(), "links")
    labels = scratch.keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "doc_id"), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(around, labels["doc_id"] == around["a"]).select("doc_id", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("doc_id").alias("next"), F.col("label").alias("ahead"))
        new = scratch.keep(spread.join(jump, "next", "left").select("doc_id", F.col("label").alias("old"), F.least("next", F.coalesce("ahead", "next")).alias("label")), "labels")
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("doc_id", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component_id")


def near_duplicates(docs: DataFrame, percent: int = 85, with_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``, and text_hash (xxhash64) on request."""
    made = F.lit(1 << 62) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 60) - 1)
    docs = docs.select("text", F.coalesce(F.col("doc_id").cast("long"), made).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"))
    rows = scratch.keep(signed(docs).withColumn("row", F.monotonically_increasing_id()), "signatures")
    full = rows.where("n_shingles > 0")
    key = ["n_shingles", "set1", "set2"]
    classes = scratch.keep(full.groupBy(*key).agg(F.min(F.struct("doc_id", "signature")).alias("c")).select(*key, "c.doc_id", "c.signature"), "classes")
    lists = scratch.keep(candidate_lists(classes.select("doc_id", "n_shingles", "signature")), "minhash-members")
    links = confirmed_links(lists, classes.select("doc_id", "n_shingles", "signature"), docs, percent)
    of_copies = full.join(classes.select(*key, F.col("doc_id").alias("first")), key).select("doc_id", "first")
    of_rows = scratch.keep(of_copies, "copies")
    several = of_rows.groupBy("doc_id").agg(F.min("first").alias("least")).join(of_rows, "doc_id").where("first <> least").select(F.col("least").alias("a"), F.col("first").alias("b"))
    named = components(scratch.keep(links.union(several).distinct(), "confirmed"))
    of_first = named.withColumnRenamed("doc_id", "first")
    in_component = of_rows.groupBy("doc_id").agg(F.min("first").alias("first")).join(of_first, "first", "left").select("doc_id", F.coalesce("component_id", "first").alias("component_id"))
    one_of = rows.where("no_id").groupBy("doc_id").agg(F.min("row").alias("only"))
    return (
        rows.select("no_id", "text_hash", "row", "doc_id", "n_shingles").join(in_component, "doc_id", "left").join(one_of, "doc_id", "left")
        .select("no_id", "text_hash", "row", "only", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .select(
            F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_shingles", "component_id",
            ((F.col("doc_id") == F.col("component_id")) & (~F.col("no_id") | (F.col("row") == F.col("only")))).alias("kept"), *(["text_hash"] if with_hash else []),
        )
    )


#: The same in DuckDB SQL, by counting the common shingles of all pairs that have one.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT x AS doc_id, least(x, min(y)) AS component_id FROM r GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
