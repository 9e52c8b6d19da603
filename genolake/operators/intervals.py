"""Interval sets: chr, start, end_, 1-based and inclusive."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks


def parse_regions(df: DataFrame, column: str = "region") -> DataFrame:
    """chr:start-end as columns."""
    parts = F.regexp_extract
    return df.select(parts(column, r"^([^:]+):(\d+)-(\d+)$", 1).alias("chr"), parts(column, r"^([^:]+):(\d+)-(\d+)$", 2).cast("int").alias("start"), parts(column, r"^([^:]+):(\d+)-(\d+)$", 3).cast("int").alias("end_"))


def fixed_tiles(contigs: DataFrame, width: int) -> DataFrame:
    """Tiles of (chr, length); the last of each chromosome is cut."""
    at = contigs.select("chr", "length", F.explode(F.sequence(F.lit(1).cast("long"), F.col("length").cast("long"), F.lit(width).cast("long"))).alias("start"))
    return at.select("chr", F.col("start").cast("int").alias("start"), F.least(F.col("start") + width - 1, F.col("length")).cast("int").alias("end_"))


def equal_tiles(regions: DataFrame, width: int) -> DataFrame:
    """Splits each region in the fewest nearly equal tiles of at most ``width``."""
    size = F.col("end_") - F.col("start") + 1
    n = F.ceil(size / width).cast("long")
    split = regions.select("chr", "start", size.cast("long").alias("size"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    edge = lambda i: F.floor(i * F.col("size") / F.col("n")).cast("long")
    return split.select("chr", (F.col("start") + edge(F.col("i"))).cast("int").alias("start"), (F.col("start") + edge(F.col("i") + 1) - 1).cast("int").alias("end_"))


def merge(intervals: DataFrame, width: int = blocks.WIDTH) -> DataFrame:
    """The union of overlapping and adjacent intervals.

    An interval that begins past all before it in its block begins an island, unless
    an earlier block reaches it.  Of those of a block the last tells whether any does:
    it is the furthest.  So an island is known by where it begins, over blocks as well.
    """
    order = blocks.inside(["chr"], "start", "end_")
    reach = F.max("end_").over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = blocks.passed(
        intervals.select("chr", "start", "end_"), ["chr"], [{"_reach": reach}, {"_new": F.when(F.col("_reach").isNull() | (F.col("_reach") < F.col("start") - 1), F.col("start"))}],
        {"_end": F.max("end_"), "_newest": F.max("_new")},
        lambda earlier, later: [{"_before": F.max("_end").over(earlier)}, {"_begun": F.when(F.col("_before").isNull() | (F.col("_before") < F.col("_newest") - 1), F.col("_newest"))}, {"_open": blocks.last("_begun").over(earlier)}], pos="start", width=width)
    begins = F.when(F.col("_new").isNotNull() & (F.col("_before").isNull() | (F.col("_before") < F.col("_new") - 1)), F.col("_new"))
    island = F.coalesce(F.max(begins).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("_open"))
    return df.withColumn("_island", island).groupBy("chr", "_island").agg(F.min("start").alias("start"), F.max("end_").alias("end_")).drop("_island")


def runs(positions: DataFrame, width: int = blocks.WIDTH) -> DataFrame:
    """Maximal runs of adjacent positions of distinct (chr, pos)."""
    at = positions.select("chr", F.col("pos").alias("start"), F.col("pos").alias("end_")).distinct()
    return merge(at, width)


def extend(intervals: DataFrame, contigs: DataFrame, flank: int) -> DataFrame:
    """Widened by flank, cut at the ends of the chromosome; contigs are a row for each chromosome."""
    joined = intervals.join(F.broadcast(contigs.select("chr", "length")), "chr")
    return joined.select("chr", F.greatest(F.col("start") - flank, F.lit(1)).cast("int").alias("start"), F.least(F.col("end_") + flank, F.col("length")).cast("int").alias("end_"))


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long")))


def overlap_counts(intervals: DataFrame, sites: DataFrame, counts: Mapping[str, Column], width: int = 1 << 16) -> DataFrame:
    """For each interval the number of sites (chr, pos) inside for which each condition holds; an equi-join by bins of ``width``."""
    wide = intervals.select("chr", "start", "end_", _bins(F.col("start"), F.col("end_"), width).alias("_bin"))
    points = sites.select("chr", "pos", F.floor(F.col("pos") / width).cast("long").alias("_bin"), *[c.cast("int").alias(n) for n, c in counts.items()])
    hits = wide.join(points, ["chr", "_bin"]).where("pos between start and end_").groupBy("chr", "start", "end_").agg(*[F.sum(n).alias(n) for n in counts])
    return intervals.select("chr", "start", "end_").distinct().join(hits, ["chr", "start", "end_"], "left").select("chr", "start", "end_", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts])


def not_contained(inner: DataFrame, outer: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Intervals that lie within no interval of ``outer``: candidates by the bin of their start."""
    a = inner.select("chr", "start", "end_", F.floor(F.col("start") / width).cast("long").alias("_bin"))
    b = outer.select(F.col("chr").alias("c"), F.col("start").alias("s"), F.col("end_").alias("e"), _bins(F.col("start"), F.col("end_"), width).alias("b"))
    return a.join(b, (a.chr == b.c) & (a._bin == b.b) & (a.start >= b.s) & (a.end_ <= b.e), "left_anti").drop("_bin")


def chunk_of(tiles: DataFrame, chunks: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Adds chunk_start of the chunk that contains each tile's start; chunks don't overlap."""
    a = tiles.withColumn("_bin", F.floor(F.col("start") / width).cast("long"))
    b = chunks.select(F.col("chr").alias("c"), F.col("start").alias("chunk_start"), F.col("end_").alias("e"), _bins(F.col("start"), F.col("end_"), width).alias("b"))
    return a.join(b, (a.chr == b.c) & (a._bin == b.b) & (a.start >= b.chunk_start) & (a.start <= b.e), "left").select(*tiles.columns, "chunk_start")


def within(sites: DataFrame, regions: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Sites (chr, pos) that lie in a region."""
    a = sites.withColumn("_bin", F.floor(F.col("pos") / width).cast("long"))
    b = regions.select(F.col("chr").alias("c"), F.col("start").alias("s"), F.col("end_").alias("e"), _bins(F.col("start"), F.col("end_"), width).alias("b"))
    return a.join(b, (a.chr == b.c) & (a._bin == b.b) & (a.pos >= b.s) & (a.pos <= b.e), "left_semi").drop("_bin")


def near(sites: DataFrame, anchors: DataFrame, flank: int) -> DataFrame:
    """Sites within [pos - flank, pos + flank - 1] of an anchor; bins of the flank's width, so that an anchor meets three at most."""
    width = max(1, flank)
    a = sites.withColumn("_bin", F.floor(F.col("pos") / width).cast("long"))
    b = anchors.select(F.col("chr").alias("c"), F.col("pos").alias("p")).distinct().select("c", "p", _bins(F.col("p") - flank, F.col("p") + flank - 1, width).alias("b"))
    return a.join(b, (a.chr == b.c) & (a._bin == b.b) & (a.pos >= b.p - flank) & (a.pos <= b.p + flank - 1), "left_semi").drop("_bin")


def tile_depth(depth: DataFrame, tiles: DataFrame, width: int, column: str, cutoffs: Mapping[str, int]) -> DataFrame:
    """Mean depth over fixed tiles (bases without a row count 0) and the number of bases at each cutoff or above."""
    start = (F.floor((F.col("pos") - 1) / width) * width + 1).cast("int")
    got = depth.groupBy("chr", start.alias("start")).agg(F.sum(column).alias("_sum"), *[F.count_if(F.col(column) >= least).alias(n) for n, least in cutoffs.items()])
    out = tiles.join(got, ["chr", "start"], "left")
    return out.select("chr", "start", "end_", (F.coalesce("_sum", F.lit(0)) / (F.col("end_") - F.col("start") + 1)).alias("mean_dp"), *[F.coalesce(n, F.lit(0)).alias(n) for n in cutoffs])


def contigs(spark: SparkSession, rows: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "chr string, length int")
