"""Compressed tables of tiles: chunks of positions and quantised numbers, read by region.

A chunk holds up to some thousand tiles of one chromosome in order: how far each
begins after the one before, how long it is, and each column in 16 bits between the
column's bounds.  Chunks are rows of a Parquet table with the chromosome and the
positions that they span, so that a region opens its chunks alone.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps between a column's bounds, and the number that stands for NULL.
LEVELS, NULL = 65534, 65535
CHUNK = "chr string, low int, high int, n int, columns string, payload binary"
_CHUNK = pa.schema([("chr", pa.string()), ("low", pa.int32()), ("high", pa.int32()), ("n", pa.int32()), ("columns", pa.string()), ("payload", pa.binary())])


def quantised(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Whole steps from the lower bound; NaN is NULL."""
    step = LEVELS * (np.nan_to_num(x, nan=low) - low) / (high - low) if high > low else np.zeros(len(x))
    return np.where(np.isnan(x), NULL, np.clip(step, 0, LEVELS)).astype("<u2")


def restored(q: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.where(q == NULL, np.nan, q / LEVELS * (high - low) + low)


def packed(start: np.ndarray, end: np.ndarray, values: Sequence[np.ndarray], bounds: Sequence[tuple[float, float]]) -> bytes:
    parts = [np.diff(start, prepend=0).astype("<i4").tobytes(), (end - start).astype("<i4").tobytes()]
    # the two bytes of a number apart: the upper ones of neighbours are much alike
    parts += [np.ascontiguousarray(quantised(v, *b).view(np.uint8).reshape(-1, 2).T).tobytes() for v, b in zip(values, bounds, strict=True)]
    return zlib.compress(b"".join(parts), 6)


def unpacked(payload: bytes, n: int, bounds: Sequence[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    data = zlib.decompress(payload)
    start = np.cumsum(np.frombuffer(data, "<i4", n))
    end = start + np.frombuffer(data, "<i4", n, 4 * n)
    codes = [np.ascontiguousarray(np.frombuffer(data, np.uint8, 2 * n, 8 * n + 2 * n * k).reshape(2, n).T).view("<u2").ravel() for k in range(len(bounds))]
    return start, end, [restored(q, *b) for q, b in zip(codes, bounds, strict=True)]


def compress(tiles: DataFrame, columns: Sequence[str], rows: int = 4096) -> DataFrame:
    """Chunks (chr, low, high, n, columns, payload) of tiles (chr, start, end_, ..); of the columns NULL and NaN are one.

    Tiles are ranged and sorted by chromosome and start; a column's bounds are its
    least and greatest number, found in one pass.  A number comes back within one step below.
    Tiles without a chromosome, start or end are an error.
    """
    columns = list(columns)
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    found = tiles.agg(*[f(number(c)).alias(f"{n}_{k}") for k, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max))]).first() if columns else None
    bounds = [(found[f"low_{k}"] or 0.0, found[f"high_{k}"] or 0.0) for k in range(len(columns))]
    told = json.dumps([[c, *b] for c, b in zip(columns, bounds, strict=True)])

    def chunk(name: str, part: list[np.ndarray]) -> pa.RecordBatch:
        start, end, *values = part
        row = {"chr": name, "low": int(start[0]), "high": int(end.max()), "n": len(start), "columns": told, "payload": packed(start, end, values, bounds)}
        return pa.RecordBatch.from_pylist([row], _CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        for batch in batches:
            names = batch.column(0).to_pylist()
            data = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64 if k < 3 else np.float64) for k in range(1, batch.num_columns)]
            cuts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True):
                if held is not None and names[a] != name:
                    yield chunk(name, held)
                    held = None
                name = names[a]
                own = [d[a:b] for d in data]
                held = own if held is None else [np.concatenate([x, y]) for x, y in zip(held, own, strict=True)]
                while len(held[0]) > rows:
                    yield chunk(name, [x[:rows] for x in held])
                    held = [x[rows:] for x in held]
        if held is not None:
            yield chunk(name, held)

    needed = lambda c: F.coalesce(F.col(c).cast("int"), F.raise_error(F.lit(f"a tile without {c}")).cast("int")).alias(c)
    own = tiles.select(F.coalesce("chr", F.raise_error(F.lit("a tile without chr"))).alias("chr"), needed("start"), needed("end_"), *[F.coalesce(number(c), F.lit(float("nan"))).alias(f"_{k}") for k, c in enumerate(columns)])
    return own.repartitionByRange("chr", "start").sortWithinPartitions("chr", "start", "end_").mapInArrow(run, CHUNK)


def decompress(chunks: DataFrame, columns: Sequence[str], region: tuple[str, int, int] | None = None) -> DataFrame:
    """(chr, start, end_, columns) of all tiles, or of those that reach into a region; the region's chunks alone are opened."""
    columns = list(columns)
    if region:
        chunks = chunks.where((F.col("chr") == region[0]) & (F.col("low") <= region[2]) & (F.col("high") >= region[1]))
    schema = ", ".join(["chr string, start int, end_ int", *(f"`{c}` double" for c in columns)])
    target = pa.schema([("chr", pa.string()), ("start", pa.int32()), ("end_", pa.int32()), *((c, pa.float64()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                told = json.loads(row["columns"])
                start, end, values = unpacked(row["payload"], row["n"], [(low, high) for _, low, high in told])
                by_name = {c[0]: v for c, v in zip(told, values, strict=True)}
                fine = np.ones(len(start), bool) if region is None else (start <= region[2]) & (end >= region[1])
                arrays = [pa.array([row["chr"]] * int(fine.sum()), pa.string()), pa.array(start[fine], pa.int32()), pa.array(end[fine], pa.int32())]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(by_name[c][fine], pa.float64(), from_pandas=True) for c in columns)], schema=target)

    return chunks.select("chr", "n", "columns", "payload").mapInArrow(run, schema)
