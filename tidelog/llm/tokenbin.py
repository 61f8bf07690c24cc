"""Token ids in binary blocks: frequency-ranked, byte-aligned variable length, control bytes apart.

Ids are replaced by their rank in the corpus (0: the most frequent). A rank takes
1 to 4 bytes, least significant first; its two control bits hold the number of
bytes less one, and four ranks share a control byte. A document's ranks begin with
a control byte of their own, so blocks are documents' bytes one after the other.
The control bytes of a block lie in one array and the data bytes in another: a table
gives the four lengths of each control byte, a running sum gives where each rank
begins, and up to four gathers build the ranks, by numpy alone.

A block is a row of a Parquet table: the documents' ids, their numbers of ids, control
and data, and the number of ids before it in its file. Blocks hold documents in
ascending doc_id order, within and across the files. The rank table (one row for each id
of the vocabulary) is stored beside.

Texts are read once, where they lie: what is exchanged is encoded documents. The number of files
follows the number of ids.

Null and empty texts hold the end id alone. Rows with equal doc_id follow each
other by their text's hash; rows of a null doc_id come first and stay null. A text of any
length is one document of one block. An empty table gives no block and an empty result.
Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .tokens import coder, slices, tidy

#: Lengths of the four ranks of every control byte.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)

_RAW = "doc_id long, tie long, n long, ids binary"
_ENCODED = "doc_id long, tie long, n long, control binary, data binary"
BLOCK = "part int, block int, behind long, n_docs long, n_ids long, docs binary, named binary, counts binary, control binary, data binary"


def _length(ranks: np.ndarray) -> np.ndarray:
    return 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)


def _bytes_of(ranks: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The data bytes of ranks, as many of each as its length."""
    if not len(ranks) or length.max() == 1:
        return ranks.astype(np.uint8)
    keep = np.arange(4, dtype=np.uint8)[None, :] < length[:, None]
    return ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[keep]


def _control(codes: np.ndarray) -> np.ndarray:
    """Control bytes of lengths less one; their number is a multiple of four."""
    codes = codes.reshape(-1, 4)
    return codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of one document."""
    length = _length(ranks)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = length - 1
    return _control(codes).tobytes(), _bytes_of(ranks, length).tobytes()


def decode_ranks(control: bytes, data: bytes, counts: np.ndarray | int) -> np.ndarray:
    """The ranks of documents of ``counts`` ids each, one after the other, by table lookup."""
    counts = np.atleast_1d(np.asarray(counts, np.int64))
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    whole = -(-counts // 4) * 4
    if (whole != counts).any():  # what fills up a document's last control byte has no rank
        used = np.ones(len(length), bool)
        end = np.cumsum(whole)
        for k in range(3):
            used[(end - 1 - k)[whole - counts > k]] = False
        length = length[used]
    at = np.cumsum(length, dtype=np.int64) - length
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[at].astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(length > k)
        if not len(longer):
            break
        ranks[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """An array of neighbouring parts of ``data``; ``ends`` begins with 0."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _tokenized(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Every row's plain ids, in 16 bits each if the vocabulary's do, else in 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = coder(vocabulary, True)
        wide = _width(tokenizer)
        for batch in batches:
            for a, b in slices(batch.column(2)):
                flat, lengths = tokenizer.encode(batch.column(2).slice(a, b - a))
                own = np.insert(flat, np.cumsum(lengths), end_id).astype(wide)
                ids = _binary(np.append(0, np.cumsum(lengths + 1)) * own.itemsize, own)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(lengths + 1), ids], _names(_RAW))

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(tidy(run), _RAW)


def _width(tokenizer) -> str:
    return "<u2" if tokenizer.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers in all values of an array of bytes, one after the other."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data is not None else np.zeros(0, kind)


def _counted(raw: DataFrame, vocabulary: str) -> list[int]:
    """The ids that occur, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = _width(coder(vocabulary, True))
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(_flat(batch.column(0), wide))
            if len(own) > len(total):
                total = np.pad(total, (0, len(own) - len(total)))
            total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    counts = raw.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, block_ids: int = 500_000, file_ids: int = 6_000_000) -> None:
    """Write the blocks to ``path``/blocks and the rank table to ``path``/ranks.

    A block has at least ``block_ids`` ids, or what is left, and a file about ``file_ids``.
    The driver holds the rank table: one row for each id of the vocabulary.
    """
    spark = docs.sparkSession
    plain, coded = (scratch.new_path(spark, name) for name in ("token-ids", "token-ranks"))
    _tokenized(docs, vocabulary, end_id).write.option("compression", "zstd").parquet(plain)
    raw = spark.read.schema(_RAW).parquet(plain)
    ids = _counted(raw, vocabulary)
    spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "rank int, id long").coalesce(1).write.parquet(f"{path}/ranks")
    ranks = np.zeros(max(ids, default=0) + 1, np.uint32)
    ranks[ids] = np.arange(len(ids))
    files = max(1, -(-(raw.agg(F.sum("n")).first()[0] or 0) // file_ids))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = _width(coder(vocabulary, True))
        for batch in batches:
            for a, b in slices(batch.column(3)):
                some = batch.slice(a, b - a)
                own = ranks[_flat(some.column(3), wide)]
                counts = some.column(2).to_numpy()
                length = _length(own)
                whole = -(-counts // 4) * 4
                first = np.cumsum(whole) - whole
                codes = np.zeros(int(whole.sum()), np.uint8)
                codes[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(own))] = length - 1
                control = _binary(np.append(0, np.cumsum(whole // 4)), _control(codes))
                data = _binary(np.append(0, np.cumsum(length, dtype=np.int64))[np.append(0, np.cumsum(counts))], _bytes_of(own, length))
                yield pa.RecordBatch.from_arrays([*some.columns[:3], control, data], _names(_ENCODED))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, behind, held, n = TaskContext.get().partitionId(), 0, 0, [], 0

        def full() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            names, counts = table.column(0).combine_chunks(), table.column(1).combine_chunks().to_numpy()
            named = np.packbits(names.is_valid().to_numpy(zero_copy_only=False))
            values = [part, number, behind, len(names), int(counts.sum()), names.fill_null(0).to_numpy().astype("<i8").tobytes(), named.tobytes(), counts.astype("<u4").tobytes()]
            values += [_flat(table.column(k).combine_chunks(), "u1").tobytes() for k in (2, 3)]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], _names(BLOCK))

        for batch in batches:
            ends = np.cumsum(batch.column(1).to_numpy())
            first = 0
            while first < batch.num_rows:
                before = ends[first - 1] if first else 0
                last = min(int(np.searchsorted(ends, before + block_ids - n)) + 1, batch.num_rows)
                held.append(batch.slice(first, last - first))
                n += int(ends[last - 1] - before)
                first = last
                if n >= block_ids:
                    yield full()
                    number, behind, n = number + 1, behind + n, 0
                    held.clear()
        if held:
            yield full()

    raw.mapInArrow(tidy(encode), _ENCODED).write.option("compression", "zstd").parquet(coded)
    scratch.drop(spark, plain)
    dealt = spark.read.schema(_ENCODED).parquet(coded).withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), "tie", "row"]
    ordered = dealt.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "n", "control", "data")
    ordered.mapInArrow(tidy(block), BLOCK).write.option("compression", "zstd").parquet(f"{path}/blocks")
    scratch.drop(spark, coded)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the blocks below ``path``, and its ids on request.

    ``start`` counts the ids of all documents before: those before in the same file, which a block
    says, and those of the files before. The driver holds a row for each file.
    """
    ids = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()] or [0], np.uint32)
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    files = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = np.cumsum([0, *[n for _, n in files]])
    starts = {part: int(n) for (part, _), n in zip(files, before)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, behind, names, named, counts, control, data = (batch.column(c)[k] for c in range(7))
                lengths = np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)
                own = ids[decode_ranks(control.as_buffer(), data.as_buffer(), lengths)].astype("<u4")
                ends = np.cumsum(lengths)
                raw = memoryview(own).cast("B")
                crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), lengths.tolist())]
                missing = np.unpackbits(np.frombuffer(named.as_buffer(), np.uint8), count=len(lengths)) == 0
                start = starts[part.as_py()] + behind.as_py() + ends - lengths
                arrays = [pa.array(np.frombuffer(names.as_buffer(), "<i8"), mask=missing), pa.array(start), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(ends - lengths, ends[-1:]), pa.int32()), pa.array(own.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return blocks.select("part", "behind", "docs", "named", "counts", "control", "data").mapInArrow(run, schema)
