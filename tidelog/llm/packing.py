"""Best-fit packing with large-item matching.

Every document becomes token ids with an end id; longer ones than a sequence are
cut into full pieces and a rest. Pieces above a third of a sequence are large:
no sequence takes more than two of them, matched greedily, the largest with the
largest that still fits. The smaller ones then go, largest first, each into the
tightest gap that takes it, and open a new sequence where none does.

Only lengths matter for that, and there are no more of them than a sequence has
tokens. So the plan is made from the number of pieces of each length: the driver
holds a histogram of at most ``capacity`` rows, and a plan whose size depends on
the capacity, not on the rows. Each piece then finds its place by its rank among
pieces of its length. Ranks are counted in cells, so that no task gets all
pieces of a frequent length.

Null and empty texts are a piece of the end id alone. Repeated rows are packed
as rows of their own. An empty table gives an empty result. Other columns of the
input are ignored, but for ``extra`` ones, which are carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .tokens import coder, slices, tidy

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, and ids on request."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = coder(vocabulary, False)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                flat, lengths = tokenizer.encode(batch.column(1).slice(a, b - a))
                own = np.insert(flat, np.cumsum(lengths), end_id).astype("<u4")
                lengths = lengths + 1
                several = -(-lengths // capacity)
                of = np.repeat(np.arange(b - a), several)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(several) - several, several)
                start = piece * capacity
                length = np.minimum(lengths[of] - start, capacity)
                ends = np.append(0, np.cumsum(length))  # pieces follow each other as in the texts
                raw = memoryview(own).cast("B")
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
                arrays = [batch.column(0).slice(a, b - a).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(cut), schema)


@dataclass
class _Bins:
    """Sequences filled alike: runs of (length, times), tokens left."""

    count: int
    gap: int
    runs: list[tuple[int, int]] = field(default_factory=list)


def plan(counts: dict[int, int], capacity: int) -> list[_Bins]:
    """How many sequences get which lengths, from the number of pieces of each length."""
    left = {n: c for n, c in counts.items() if c}
    if left and (max(left) > capacity or min(left) < 1):
        raise ValueError("a length must be from 1 to the capacity")
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    made: list[_Bins] = []
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= capacity - a and left[x] > (x == a)), None)
            if b is None:
                made.append(_Bins(left[a], capacity - a, [(a, 1)]))
                left[a] = 0
            elif b == a:
                made.append(_Bins(left[a] // 2, capacity - 2 * a, [(a, 2)]))
                left[a] %= 2
            else:
                n = min(left[a], left[b])
                made.append(_Bins(n, capacity - a - b, [(a, 1), (b, 1)]))
                left[a] -= n
                left[b] -= n
    by_gap: dict[int, list[_Bins]] = {}
    for bins in made:
        by_gap.setdefault(bins.gap, []).append(bins)
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        n = left[s]
        while n:
            gap = min((g for g in by_gap if g >= s), default=None)
            if gap is None:
                by_gap.setdefault(capacity, []).append(_Bins(-(-n // (capacity // s)), capacity))
                continue
            bins = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
            each = min(gap // s, n)
            full = min(bins.count, n // each)
            n -= full * each
            by_gap.setdefault(gap - each * s, []).append(_Bins(full, gap - each * s, [*bins.runs, (s, each)]))
            if bins.count > full:
                by_gap.setdefault(gap, []).append(_Bins(bins.count - full, gap, bins.runs))
    return [b for g in sorted(by_gap) for b in by_gap[g] if b.runs]


def _places(bins: list[_Bins]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, times in a sequence, first sequence, offset)."""
    rows, ranks, sequence = [], {}, 0
    for b in bins:
        offset = 0
        for length, times in b.runs:
            rank = ranks.get(length, 0)
            rows.append((length, rank, rank + b.count * times, times, sequence, offset))
            ranks[length] = rank + b.count * times
            offset += length * times
        sequence += b.count
    return rows


_PLACE = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "from_rank", "to_rank", "times", "sequence", "at")])


def place(items: DataFrame, capacity: int = 2048, key: tuple[str, ...] = ("doc_id", "piece"), rows_per_cell: int = 1_000) -> DataFrame:
    """``items`` (with ``length``) and their sequence_id and offset.

    ``items`` must give the same rows each time it is read. A length has a cell for about each ``rows_per_cell`` of its pieces.
    """
    spark = items.sparkSession
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.createDataFrame(_places(plan(histogram, capacity)), _PLACE)
    cells = spark.createDataFrame([(n, -(-times // rows_per_cell)) for n, times in histogram.items()], "length long, _cells long")
    celled = items.join(F.broadcast(cells), "length").withColumn("_cell", F.pmod(F.xxhash64(*key), F.col("_cells"))).drop("_cells")  # a row for each length
    counts = celled.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    order = Window.partitionBy("length", "_cell").orderBy(*key, *([] if "ids_crc32" not in items.columns else ["ids_crc32"]))
    ranked = (
        celled.withColumn("_rank", F.row_number().over(order) - 1)
        .join(first, ["length", "_cell"])
        .withColumn("_rank", F.col("_rank") + F.col("_first"))
    )
    inside = (ranked["length"] == table["length"]) & (ranked["_rank"] >= table["from_rank"]) & (ranked["_rank"] < table["to_rank"])
    behind = F.col("_rank") - F.col("from_rank")
    return ranked.join(F.broadcast(table), inside).select(  # its rows depend on the capacity alone
        *[ranked[c] for c in items.columns],
        (F.col("sequence") + F.floor(behind / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + (behind % F.col("times")) * ranked["length"]).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Documents in as few sequences of ``capacity`` tokens as best fit finds: a row for each piece with its place.

    ``with_ids`` adds the piece's ids, for a writer that lays out the sequences.
    """
    return place(scratch.keep(pieces(docs, vocabulary, capacity, end_id, with_ids), "pieces"), capacity)
