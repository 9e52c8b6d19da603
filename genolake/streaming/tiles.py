"""An extension: counts of a stream of positioned events by tile and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_counts(events: DataFrame, *, width: int = 100_000, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, chr, start, n) of a stream or table (chr, pos, time); events later than ``late`` are left out of a stream."""
    start = (F.floor((F.col("pos") - 1) / width) * width + 1).cast("int").alias("start")
    return events.withWatermark(time, late).groupBy(F.window(time, window), "chr", start).agg(F.count("*").alias("n"))
