"""Operator 5: token ids in bit-packed files.

A file is a Parquet table of *segments*.  A segment's ``payload`` stores ids of
consecutive documents, each in the fewest bits that hold the vocabulary, in
blocks of BLOCK ids:

    4 bytes "IDS1" | bits u32 | ids u64 | ids per block u32 | blocks u32 |
    byte offset of each block u64 ... | the blocks, little-endian bits, each padded to whole bytes

so that any id is found from its block's offset, and a block unpacks in numpy at
once.  Segments carry their partition, their first id there and the documents'
ids and lengths; the ids before a partition are the sum over the partitions
before it, a table of one row for each partition.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared, textbatch

BLOCK = 4096
SEGMENT = "part int, segment int, first long, n_ids long, doc_ids binary, doc_lengths binary, payload binary"
_SEGMENT = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), *((c, pa.binary()) for c in ("doc_ids", "doc_lengths", "payload"))])
_HEAD = struct.Struct("<4sIQII")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """A payload of the ids."""
    blocks = []
    for k in range(0, len(ids), block):
        part = ids[k : k + block].astype("<u4")
        if bits == 16:
            blocks.append(part.astype("<u2").tobytes())
        else:
            blocks.append(np.packbits(np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little").ravel(), bitorder="little").tobytes())
    at = np.cumsum([_HEAD.size + 8 * len(blocks), *map(len, blocks)])[: len(blocks)].astype("<u8")
    return b"".join([_HEAD.pack(b"IDS1", bits, len(ids), block, len(blocks)), at.tobytes(), *blocks])


def unpack(payload: bytes, start: int = 0, end: int | None = None) -> np.ndarray:
    """The ids from start to end, from their blocks alone."""
    kind, bits, n, block, blocks = _HEAD.unpack_from(payload)
    if kind != b"IDS1":
        raise ValueError("not a payload of ids")
    end = n if end is None else min(end, n)
    if start >= end:
        return np.empty(0, np.uint32)
    at = np.append(np.frombuffer(payload, "<u8", blocks, _HEAD.size), len(payload)).astype(np.int64)
    low, high = start // block, -(-end // block)
    out = []
    for k in range(low, high):
        count = min(block, n - k * block)
        packed = np.frombuffer(payload, np.uint8, int(at[k + 1] - at[k]), int(at[k]))
        if bits == 16:
            out.append(packed.view("<u2").astype(np.uint32))
        else:
            flags = np.unpackbits(packed, count=count * bits, bitorder="little").reshape(count, bits)
            out.append(np.packbits(np.pad(flags, ((0, 0), (0, 32 - bits))), axis=1, bitorder="little").view("<u4").ravel())
    return np.concatenate(out)[start - low * block : end - low * block]


def write(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, segment_ids: int = 1 << 20) -> None:
    """Writes the ids of all documents, ascending by id, each followed by ``end_id``.

    Documents are ranged over partitions by id; texts move once and are encoded
    where they lie, a chunk at a time.  Null and empty texts give the end id
    alone; repeated ids stay, one after the other; rows without an id are left out.
    """
    bits = bits_for(max(textbatch.library_tokenizer(tokenizer).get_vocab_size(), end_id + 1))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, segment, first = TaskContext.get().partitionId(), 0, 0
        for batch, data, offsets in textbatch.chunks(batches, "_text"):
            ids, place = textbatch.encode_chunk(data, offsets, tokenizer)
            ids = np.insert(ids, place[1:], end_id)
            place = place + np.arange(len(place))
            names, row = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"), 0
            while row < batch.num_rows:
                end = max(row + 1, int(np.searchsorted(place, place[row] + segment_ids, "right")) - 1)
                one = ids[place[row] : place[end]]
                yield shared.rows(_SEGMENT, [part], [segment], [first], [len(one)], [names[row:end].tobytes()], [np.diff(place[row : end + 1]).astype("<i8").tobytes()], [pack(one, bits)])
                segment, first, row = segment + 1, first + len(one), end

    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where("_id is not null")
    own.repartitionByRange("_id").sortWithinPartitions("_id").mapInArrow(segments, SEGMENT).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the ids of all documents before each."""
    files = spark.read.schema(SEGMENT).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return files.join(F.broadcast(before), "part").select("*", (F.col("_before") + F.col("first")).alias("start")).drop("_before")


DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"
_DOCUMENT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def documents(files: DataFrame) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens and its ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                length = np.frombuffer(row["doc_lengths"], "<i8")
                at = np.append(0, np.cumsum(length))
                yield shared.rows(_DOCUMENT, np.frombuffer(row["doc_ids"], "<i8"), row["start"] + at[:-1], length, shared.binary_rows(unpack(row["payload"]).astype("<u4"), 4 * at))

    return files.select("start", "doc_ids", "doc_lengths", "payload").mapInArrow(run, DOCUMENT)
