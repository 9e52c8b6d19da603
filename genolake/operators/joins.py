"""Joins of a site table with side tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import stored
from . import blocks


def update_join(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], last_by: Sequence[str | Column]) -> DataFrame:
    """Adds columns of right; of several matches the last in the order wins and no left row multiplies."""
    order = F.struct(*last_by)
    one = right.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in columns])
    return left.join(one, list(keys), "left")


def existing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_semi")


def missing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def classify_shared(one: DataFrame, two: DataFrame, keys: Sequence[str], min_alt: int = 3) -> DataFrame:
    """Full outer join of two cells' (keys, scalt, dp, pass): shared, private to one, indeterminate or none.

    Shared: called in one and at least ``min_alt`` reads in both.  Private: called
    in one, and the other has depth there but no read.  Indeterminate: called in one otherwise.
    """
    a = one.select(*keys, F.col("scalt").alias("alt_1"), F.col("dp").alias("dp_1"), F.col("pass").alias("pass_1"))
    b = two.select(*keys, F.col("scalt").alias("alt_2"), F.col("dp").alias("dp_2"), F.col("pass").alias("pass_2"))
    p1, p2 = F.coalesce("pass_1", F.lit(False)), F.coalesce("pass_2", F.lit(False))
    a1, a2 = F.coalesce("alt_1", F.lit(0)), F.coalesce("alt_2", F.lit(0))
    kind = (
        F.when((p1 | p2) & (a1 >= min_alt) & (a2 >= min_alt), "shared")
        .when((p1 & (F.coalesce("dp_2", F.lit(0)) > 0) & (a2 == 0)) | (p2 & (F.coalesce("dp_1", F.lit(0)) > 0) & (a1 == 0)), "private")
        .when(p1 | p2, "indeterminate")
        .otherwise("none")
    )
    return a.join(b, list(keys), "full").withColumn("kind", kind)


def shared_pairs(calls: DataFrame, keys: Sequence[str], min_alt: int = 3) -> DataFrame:
    """Sites that two samples share, from one long table (keys, sample, scalt, pass): one join for all pairs of samples."""
    enough = calls.where(F.col("scalt") >= min_alt)
    a = enough.select(*keys, F.col("sample").alias("sample_1"), F.col("pass").alias("pass_1"))
    b = enough.select(*keys, F.col("sample").alias("sample_2"), F.col("pass").alias("pass_2"))
    return a.join(b, list(keys)).where((F.col("sample_1") < F.col("sample_2")) & (F.col("pass_1") | F.col("pass_2"))).select(*keys, F.concat_ws("&", "sample_1", "sample_2").alias("samples"))


def nearest(left: DataFrame, right: DataFrame, *, by: str = "chr", pos: str = "pos", right_edge: str = "null", width: int = blocks.WIDTH) -> DataFrame:
    """Adds ``nearest``, the position of right nearest to each row of left; ties to the left.

    Rows at or after the last position of right get NULL, or with
    ``right_edge="nearest"`` that position; rows before the first get the first.
    """
    points = stored.dealt(right.select(by, pos), by, pos).distinct().select(by, pos, F.col(pos).alias("_at"))
    rows = left.withColumn("_at", F.lit(None).cast(right.schema[pos].dataType)).withColumn("_row", F.lit(True))
    both = rows.unionByName(points.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    upto = blocks.inside([by], pos).rangeBetween(Window.unboundedPreceding, 0)
    above = blocks.inside([by], F.desc(pos)).rangeBetween(Window.unboundedPreceding, -1)  # from the far end: frames that grow, not frames that shrink
    both = blocks.passed(
        both, [by], [{"_l": F.max("_at").over(upto), "_r": F.min("_at").over(above)}], {"_least": F.min("_at"), "_most": F.max("_at")},
        lambda earlier, later: [{"_last": F.max("_most").over(earlier), "_next": F.min("_least").over(later)}], pos=pos, width=width)
    both = both.where("_row").withColumn("_l", F.coalesce("_l", "_last")).withColumn("_r", F.coalesce("_r", "_next"))
    at_edge = F.col("_l") if right_edge == "nearest" else F.lit(None)
    found = F.when(F.col("_r").isNull(), at_edge).when(F.col("_l").isNull(), F.col("_r")).when(F.col(pos) - F.col("_l") <= F.col("_r") - F.col(pos), F.col("_l")).otherwise(F.col("_r"))
    return both.withColumn("nearest", found).select(*left.columns, "nearest")


def lookup(sites: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joins a table with a row for each depth and bin, a few thousand at most."""
    return sites.join(F.broadcast(table), list(keys), "left")


def parameter_grid(spark, **values: Sequence) -> DataFrame:
    """All combinations of a few literal lists."""
    grid = spark.range(1).select()
    for name, options in values.items():
        grid = grid.select("*", F.explode(F.lit(list(options))).alias(name))
    return grid
