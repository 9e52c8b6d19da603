"""What the operators share: tables written to the cluster's folder, joins of uneven keys, and batches of results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import drop, forget, mark, new_path, shared_folder, written

__all__ = ["binary_rows", "drop", "filtered", "forget", "mark", "new_path", "rows", "shared_folder", "spread_join", "unused", "written"]

#: A key with more than one row in so many is dealt over several tasks; there are no more such keys than this.
HEAVY = 2048


def spread_join(big: DataFrame, small: DataFrame, keys: Sequence[str], counts: DataFrame, salt: Sequence[str], how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` by keys that may be very uneven in ``big``; ``counts`` are its rows by key (keys, n).

    Rows of a key that holds more than 1 / HEAVY of them are dealt over parts by a hash of the columns ``salt``, and the
    rows of ``small`` go to all parts.  The heavy keys, HEAVY at most, are broadcast.
    """
    keys = list(keys)
    total = counts.agg(F.sum("n").alias("t")).scalar()
    heavy = counts.where(F.col("n") * HEAVY > total).select(*keys, F.ceil(F.col("n") * HEAVY / total).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = big.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*salt), parts).cast("int")).drop("_parts")
    copied = small.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")


def unused(df: DataFrame, name: str) -> str:
    """A column name like this that the table doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def filtered(docs: DataFrame, text_col: str, keep: Callable) -> DataFrame:
    """The rows for which ``keep``, given a chunk's bytes and offsets, says so; all columns, where they lie."""
    from . import textbatch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in textbatch.chunks(batches, text_col):
            yield batch.filter(pa.array(keep(data, offsets)))

    return docs.mapInArrow(run, docs.schema)


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def binary_rows(data, offsets) -> pa.Array:
    """A binary column of the parts of a buffer."""
    import numpy as np

    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
