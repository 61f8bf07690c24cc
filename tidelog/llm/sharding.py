"""Shards of near equal bytes by histogram sort, with DataFrame functions only.

Rows have a 128-bit sort key ``(xxhash64(text), doc_id)``, so equal texts are
neighbours. Splitters between shards are searched on histograms: one pass counts
the exact bytes in every cell between evenly spaced probe keys; the next pass
counts again, with finer probes, only the cells that hold a splitter; this ends
when every splitter is within tolerance of its target, or no key lies between
its probes. Then rows are exchanged once, by shard and cell.

Skew: a group of equal texts has one ``xxhash64(text)``, and the probes go on
through the bits of a mixed ``doc_id``, so that a group of any size is cut where
the bytes ask for it. No task or the driver holds a group: the driver sees at
most ``2 ** bits`` counts for each splitter and round.

Rows without text have size 1 and crc32 0; a null doc_id stays null. Repeated rows are rows of their own;
fully equal ones (same text and doc_id) tie in the key and stay in one shard. A text of any
length is one row of one shard. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

_KEY_BITS = 128


def _with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hi"),
        F.xxhash64(F.col("doc_id")).alias("lo"),
    )


def _bits(first: int, n: int) -> Column:
    """Bits ``first`` to ``first + n`` of the key, as a number."""
    word, at = ("hi", first) if first < 64 else ("lo", first - 64)
    return F.shiftrightunsigned(F.col(word), 64 - at - n).bitwiseAND((1 << n) - 1)


def _starts_with(prefix: int, n: int) -> Column:
    """Whether the key's first ``n`` bits are ``prefix``."""
    if n <= 64:
        return _bits(0, n) == prefix if n < 64 else F.col("hi") == _signed(prefix)
    return (F.col("hi") == _signed(prefix >> (n - 64))) & (_bits(64, n - 64) == prefix & ((1 << (n - 64)) - 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def find_splitters(keyed: DataFrame, shards: int, tolerance: float = 0.0005, bits: int = 12) -> list[int]:
    """Keys (of 128 bits) between the shards: shard i takes keys from splitter i - 1 up to below splitter i.

    ``tolerance`` is the bytes that a splitter may be off its target, as a share
    of a shard. Every round is one aggregation over the open cells.
    """
    width = bits
    counted = keyed.groupBy(_bits(0, width).alias("cell")).agg(F.sum("size").alias("bytes")).collect()
    cells = {0: sorted((r["cell"], r["bytes"]) for r in counted)}
    total = sum(b for _, b in cells[0])
    targets = [total * i / shards for i in range(1, shards)]
    allowed = tolerance * total / shards
    #: For each splitter: the open cell's prefix and the bytes below it.
    state = {i: (0, 0) for i in range(shards - 1)}
    found: dict[int, int] = {}
    known = 0
    while state:
        open_: dict[int, tuple[int, int]] = {}
        for i, (prefix, below) in state.items():
            inside = cells.get(prefix, [])
            for cell, n in inside:
                low = (prefix << width) | cell
                if below + n >= targets[i]:
                    break
                below += n
            else:
                found[i] = (prefix + 1) << (_KEY_BITS - known)
                continue
            done = known + width
            if targets[i] - below <= allowed or done >= _KEY_BITS and targets[i] - below < n / 2:
                found[i] = low << (_KEY_BITS - done)
            elif below + n - targets[i] <= allowed or done >= _KEY_BITS:
                found[i] = (low + 1) << (_KEY_BITS - done)
            else:
                open_[i] = (low, below)
        known += width
        state = open_
        if not state:
            break
        width = min(bits, (64 if known < 64 else _KEY_BITS) - known)
        prefixes = sorted({p for p, _ in state.values()})
        which = reduce(
            lambda w, kp: w.when(_starts_with(kp[1], known), F.lit(kp[0])), enumerate(prefixes), F.when(F.lit(False), F.lit(0))
        )
        counted = (
            keyed.withColumn("open", which)
            .where(F.col("open").isNotNull())
            .groupBy("open", _bits(known, width).alias("cell"))
            .agg(F.sum("size").alias("bytes"))
            .collect()
        )
        cells = {p: [] for p in prefixes}
        for r in counted:
            cells[prefixes[r["open"]]].append((r["cell"], r["bytes"]))
        cells = {p: sorted(c) for p, c in cells.items()}
    return [found[i] for i in range(shards - 1)] if total else []


def _unsigned_at_least(word: str, x: int) -> Column:
    """Whether a 64-bit column, read as unsigned, is at least ``x``."""
    flip = -(1 << 63)
    return F.col(word).bitwiseXOR(F.lit(flip)) >= F.lit(_signed(x) ^ flip)


def _at_least(key: int) -> Column:
    if key >= 1 << _KEY_BITS:
        return F.lit(False)
    hi, lo = key >> 64, key & ((1 << 64) - 1)
    if lo == 0:
        return _unsigned_at_least("hi", hi)
    above = _unsigned_at_least("hi", hi + 1) if hi + 1 < 1 << 64 else F.lit(False)
    return above | ((F.col("hi") == F.lit(_signed(hi))) & _unsigned_at_least("lo", lo))


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.0005, rows_per_cell: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of ``docs``.

    Sizes of shards differ by at most ``tolerance`` of a shard and one document at either end.
    Slots are gapless from 0 in each shard; they go by cell, a part of the shard's
    rows of about ``rows_per_cell``, and by key in a cell.
    """
    keyed = scratch.keep(_with_key(docs), "shard-keys")
    splitters = find_splitters(keyed, shards, tolerance)
    number = reduce(lambda a, k: a + F.when(_at_least(k), 1).otherwise(0), splitters, F.lit(0))
    rows = keyed.count()
    cells = max(1, -(-rows // (shards * rows_per_cell)))
    placed = keyed.withColumn("shard", number.cast("int")).withColumn("cell", F.pmod(F.xxhash64(F.lit("cell"), "doc_id"), F.lit(cells)).cast("int"))
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn(
        "first", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("n")
    in_cell = Window.partitionBy("shard", "cell").orderBy("hi", "lo", "doc_id")
    return (
        placed.withColumn("at", F.row_number().over(in_cell) - 1)
        .join(starts, ["shard", "cell"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
