"""Operator 4: lines that repeat across documents, as compressed keep bitmaps.

Hashes of the lines are ranged over partitions by (hash, document descending)
and sorted there, so that the first document of a hash is the one that keeps it.
Each partition is streamed once; a hot line may spread over many partitions, as
the document is part of the range.  What a partition can't decide alone, its
first run and a short last one, is resolved by a summary of two rows for each
partition.  Texts aren't moved until the bitmaps are applied.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textbatch

MIN_POINTS, MIN_DOCS = 20, 3
_LINE = pa.schema([(c, pa.int64()) for c in ("h1", "h2", "doc_id", "row", "line")])
LINE = "h1 long, h2 long, doc_id long, row long, line long"
_FOUND = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("h1", "h2", "doc_id", "row", "line"))])
FOUND = "kind int, h1 long, h2 long, doc_id long, row long, line long"
DROP, PENDING, SUMMARY = range(3)


def key_of(line: bytes) -> bytes:
    """Stripped of ASCII white space at both ends, A-Z in lower case."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS) -> DataFrame:
    """A row for each line whose key has ``min_points`` code points: 128 bits of hash, document, hash of its text and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in textbatch.chunks(batches, "_text"):
            out: list[tuple[int, int, int]] = []
            digests: list[bytes] = []
            whole = data.tobytes()
            for name, row, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for k, line in enumerate(whole[a:b].split(b"\n")):
                    if len(line) >= min_points and len(key := key_of(line)) >= min_points and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_points):
                        digests.append(xxhash.xxh3_128_digest(key))
                        out.append((name, row, k))
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            place = np.array(out, np.int64).reshape(-1, 3)
            yield shared.rows(_LINE, h[:, 0], h[:, 1], *place.T)

    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_row"), F.col(text_col).alias("_text")).where("_id is not null")
    return own.mapInArrow(run, LINE)


def stream_runs(batches: Iterator[pa.RecordBatch], min_docs: int = MIN_DOCS) -> Iterator[pa.RecordBatch]:
    """Over sorted (h1, h2, doc_id descending, row, line): rows to drop, rows that another partition may decide, and the ends' summaries.

    Of the run that is open at a batch's end only the rows of fewer than
    ``min_docs`` documents are held; later ones are decided as they come.
    """
    held: np.ndarray | None = None  # rows of the open run, while it has few documents
    key, docs, keeper, last, first = None, 0, 0, 0, True

    def found(kind: int, part: np.ndarray) -> pa.RecordBatch:
        return shared.rows(_FOUND, np.full(len(part), kind), *part.T)

    def summary() -> pa.RecordBatch:
        return found(SUMMARY, np.array([[*key, keeper, 0, docs]], np.int64))

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        if key is not None and held is None:  # the open run has enough documents already
            same = (rows[:, 0] == key[0]) & (rows[:, 1] == key[1])
            end = len(same) if same.all() else int(np.argmin(same))
            if end:
                part = rows[:end]
                docs += int((np.diff(part[:, 2], prepend=last) != 0).sum())
                last = int(part[-1, 2])
                yield found(PENDING, part) if first else found(DROP, part[part[:, 2] != keeper])
            rows = rows[end:]
            if not len(rows):
                continue
            if first:
                yield summary()
            first, key = False, None
        elif held is not None:
            rows = np.concatenate([held, rows])
        if not len(rows):
            continue
        fresh = np.append(True, (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0))
        new_doc = fresh | np.append(True, np.diff(rows[:, 2]) != 0)
        run = np.cumsum(fresh) - 1
        starts = np.flatnonzero(fresh)
        count = np.bincount(run, new_doc).astype(np.int64)
        if first and len(starts) > 1:
            part = rows[: starts[1]]
            key, docs, keeper = (int(part[0, 0]), int(part[0, 1])), int(count[0]), int(part[0, 2])
            yield found(PENDING, part)
            yield summary()
        drop = (count[run] >= min_docs) & (rows[:, 2] != rows[starts[run], 2])
        drop &= (run >= (1 if first else 0)) & (run < len(starts) - 1)
        yield found(DROP, rows[drop])
        first = first and len(starts) == 1
        part = rows[starts[-1] :]
        key, docs, keeper, last = (int(part[0, 0]), int(part[0, 1])), int(count[-1]), int(part[0, 2]), int(part[-1, 2])
        held = part
        if docs >= min_docs:
            held = None
            yield found(PENDING, part) if first else found(DROP, part[part[:, 2] != keeper])
    if key is not None:
        if held is not None:
            yield found(PENDING, held)
        yield summary()


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row, n_dropped, bitmap) of the documents that lose lines; ``row`` is the xxhash64 of the text.

    A line's key is the line without ASCII white space at its ends, A-Z in lower
    case.  Keys of ``min_points`` code points in ``min_docs`` documents lose all
    lines but those of the largest id.  ``bitmap`` is zlib over bits, 1 for kept
    lines, up to the last line that goes.  Null texts have one empty line; rows
    without an id keep all lines.  Rows that repeat an id count as one document, of
    the lines of all their texts; each text has a bitmap of its own.
    """
    lines = shared.written(line_hashes(docs, id_col, text_col, min_points), "lines")
    newest = F.col("doc_id").desc()
    ranged = lines.repartitionByRange("h1", "h2", newest).sortWithinPartitions("h1", "h2", newest, "row", "line")
    found = shared.written(ranged.mapInArrow(lambda batches: stream_runs(batches, min_docs), FOUND), "runs")
    ends = found.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("line").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    open_rows = found.where(F.col("kind") == PENDING).join(F.broadcast(ends), ["h1", "h2"]).where("doc_id <> keeper")  # ends: two rows for each partition at most
    gone = found.where(F.col("kind") == DROP).select("doc_id", "row", "line").unionByName(open_rows.select("doc_id", "row", "line"))
    by_doc = gone.groupBy("doc_id", "row").agg(F.collect_set("line").alias("lines"))
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_dropped", pa.int64()), ("bitmap", pa.binary())])

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, packed = [], []
            for lines in batch.column(2).to_pylist():
                keep = np.ones(max(lines) // 8 * 8 + 8, bool)  # whole bytes: what follows stays
                keep[lines] = False
                sizes.append(len(lines))
                packed.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
            yield shared.rows(schema, batch.column(0), batch.column(1), sizes, packed)

    return by_doc.mapInArrow(bitmaps, "doc_id long, row long, n_dropped long, bitmap binary")


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """The number of lines, of lines that go, and what stays."""
    lines = text.split(b"\n")
    if bitmap is None:
        return len(lines), 0, text
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little").astype(bool)[: len(lines)]
    stay = [line for line, k in zip(lines, np.append(keep, np.ones(len(lines) - len(keep), bool)).tolist(), strict=True) if k]
    return len(lines), len(lines) - len(stay), b"\n".join(stay)


def apply(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_lines (before), n_dropped, and kept, the lines that stay joined by \\n (null for a null text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in textbatch.chunks(iter([batch]), "_text"):
                whole = data.tobytes()
                got = [kept_text(whole[a:b], m) for a, b, m in zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column(2).to_pylist(), strict=True)]
                null = part.column(1).is_null().to_pylist()
                yield shared.rows(schema, part.column(0), [g[0] for g in got], [g[1] for g in got], pa.array([None if n else g[2].decode("utf-8", "replace") for g, n in zip(got, null, strict=True)], pa.string()))

    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_row"), F.col(text_col).alias("_text"))
    joined = own.join(bitmaps.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "bitmap"), ["_id", "_row"], "left").select("_id", "_text", "bitmap")
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")


def cleaned(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the text that stays, all columns in place."""
    key, row, mark = (shared.unused(docs, c) for c in ("_key", "_row", "_bitmap"))
    marked = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(row, F.xxhash64(text_col)).join(bitmaps.select(F.col("doc_id").alias(key), F.col("row").alias(row), F.col("bitmap").alias(mark)), [key, row], "left")
    joined = marked.select(*(F.col(f"`{c}`") for c in docs.columns), mark)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else t if m is None else kept_text(t.encode(), m)[2].decode("utf-8", "replace") for t, m in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
