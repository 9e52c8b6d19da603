"""Order-dependent operators along positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks


def nearest_gap(sites: DataFrame, by: Sequence[str] = ("sample", "chr"), pos: str = "pos", tie: Sequence[str] = (), width: int = blocks.WIDTH) -> DataFrame:
    """Adds prev_gap, next_gap and nearest, the smaller; NULL where there is no neighbour."""
    order = blocks.inside(by, pos, *tie)
    df = blocks.passed(
        sites, list(by), [{"_prev": F.lag(pos).over(order), "_next": F.lead(pos).over(order)}], {"_least": F.min(pos), "_most": F.max(pos)},
        lambda earlier, later: [{"_before": F.max("_most").over(earlier), "_after": F.min("_least").over(later)}], pos=pos, width=width)
    df = df.withColumn("prev_gap", F.col(pos) - F.coalesce("_prev", "_before")).withColumn("next_gap", F.coalesce("_next", "_after") - F.col(pos))
    return df.withColumn("nearest", F.least("prev_gap", "next_gap")).drop("_prev", "_next", "_before", "_after", blocks.BLOCK)


def rolling_sum(tiles: DataFrame, column: str, n: int, by: Sequence[str] = ("chr",), order: Sequence[str] = ("start",), name: str = "nbhd") -> DataFrame:
    """The sum from n - 1 rows before to n rows after; NULL unless all 2n rows are there.  Tiles are of a fixed width: a genome has few."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), n)
    return tiles.withColumn(name, F.when(F.count(F.lit(1)).over(w) == 2 * n, F.sum(column).over(w)))


def islands(df: DataFrame, starts: Column, by: Sequence[str], order: Sequence[str], pos: str = "pos", width: int = blocks.WIDTH) -> DataFrame:
    """Adds ``island``: the number of rows up to here, in order, for which ``starts`` holds."""
    upto = blocks.inside(by, *order).rowsBetween(Window.unboundedPreceding, 0)
    df = blocks.passed(
        df, list(by), [{"_starts": starts.cast("int")}, {"_upto": F.sum("_starts").over(upto)}], {"_all": F.sum("_starts")},
        lambda earlier, later: [{"_done": F.sum("_all").over(earlier)}], pos=pos, width=width)
    return df.withColumn("island", F.coalesce("_done", F.lit(0)) + F.col("_upto")).drop("_done", "_upto", "_starts", blocks.BLOCK)


def merge_neighbours(calls: DataFrame, by: Sequence[str] = ("sample", "chr"), max_read_diff: int = 2) -> DataFrame:
    """Runs of adjacent positions of (.., pos, refnt, altnt, scalt, scref) as one call each, if their reads agree; dnv for two, mnv for more."""
    gaps = nearest_gap(calls, by).where("nearest = 1")
    runs = islands(gaps, F.coalesce(F.col("prev_gap") != 1, F.lit(True)), by, ["pos"])
    part = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]), "")
    spread = lambda c: F.max(c) - F.min(c)
    one = runs.groupBy(*by, "island").agg(
        F.min("pos").alias("pos"), part("refnt").alias("refnt"), part("altnt").alias("altnt"), F.count("*").alias("n"), spread("scalt").alias("alt_range"), spread("scref").alias("ref_range"))
    one = one.where((F.col("alt_range") <= max_read_diff) & (F.col("ref_range") <= max_read_diff))
    return one.withColumn("muttype", F.when(F.col("n") == 2, "dnv").otherwise("mnv")).drop("island")


def flip_phase(sites: DataFrame, cutoff: int = 10_000, by: Sequence[str] = ("chr",), tie: Sequence[str] = (), width: int = blocks.WIDTH) -> DataFrame:
    """Adds ``flipped_af``: af on the side of the run's first site.

    A run ends where the gap reaches the cutoff, or af here or before is NULL or
    a half; in a run, the recurrence "flip if that is nearer to the site before"
    puts all sites on the first one's side.  A block knows its runs but for the
    one that its first row may go on with: that is told from the last row before.
    """
    order = ["pos", *tie]
    w = blocks.inside(by, *order)
    here = F.struct(F.col("pos").alias("pos"), F.col("af").alias("af"))

    def goes_on(site: Column, before: Column) -> Column:
        return F.coalesce((site["pos"] - before["pos"] < cutoff) & site["af"].isNotNull() & before["af"].isNotNull() & (before["af"] != 0.5), F.lit(False))

    start = F.when(F.col("_lag").isNotNull() & ~goes_on(here, F.col("_lag")), F.struct("af"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*order)
    df = blocks.passed(
        sites, list(by), [{"_lag": F.lag(here).over(w)}, {"_start": start}, {"_run": blocks.last("_start").over(upto)}],
        {"_head": F.min_by(here, place), "_tail": F.max_by(here, place), "_own": F.max_by("_run", place)},
        lambda earlier, later: [
            {"_before": blocks.last("_tail").over(earlier)},
            {"_first": F.when(F.col("_before").isNull() | ~goes_on(F.col("_head"), F.col("_before")), F.struct(F.col("_head")["af"].alias("af")))},
            {"_known": F.coalesce("_own", "_first")}, {"_carried": blocks.last("_known").over(earlier)}], width=width)
    first = F.coalesce("_run", "_first", "_carried")["af"]
    flip = F.signum(F.col("af") - 0.5) * F.signum(first - 0.5) < 0
    return df.withColumn("flipped_af", F.when(flip, 1 - F.col("af")).otherwise(F.col("af"))).drop("_lag", "_start", "_run", "_before", "_first", "_known", "_carried", blocks.BLOCK)


def run_lengths(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = ("chr",), pos: str = "pos", width: int = blocks.WIDTH) -> DataFrame:
    """(by, island, value, n): runs of one value in order.

    Rows of a block's run are counted first; a run that goes on over blocks is put together from a row for each block.
    """
    w = blocks.inside(by, *order)
    here, place = F.struct(F.col(value).alias("v")), F.struct(*order)
    new = F.col("_lag").isNotNull() & ~F.col(value).eqNullSafe(F.col("_lag")["v"])
    df = blocks.passed(
        df, list(by), [{"_lag": F.lag(here).over(w)}, {"_new": new.cast("int")}, {"_upto": F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))}],
        {"_head": F.min_by(here, place), "_tail": F.max_by(here, place), "_all": F.sum("_new")},
        lambda earlier, later: [
            {"_before": blocks.last("_tail").over(earlier)},
            {"_first": (F.col("_before").isNull() | ~F.col("_head")["v"].eqNullSafe(F.col("_before")["v"])).cast("int")},
            {"_done": F.coalesce(F.sum(F.col("_all") + F.col("_first")).over(earlier), F.lit(0)) + F.col("_first")}], pos=pos, width=width)
    return df.withColumn("island", F.col("_done") + F.col("_upto")).groupBy(*by, "island", value).agg(F.count("*").alias("n"))


def share_cutoff(histogram: DataFrame, value: str, count: str, share: float) -> DataFrame:
    """The first value up to which the given share of the counts lies; over a histogram."""
    w = Window.orderBy(value)
    part = histogram.select(value, (F.sum(count).over(w) / F.sum(count).over(Window.partitionBy())).alias("part"))
    return part.where(F.col("part") >= share).agg(F.min(value).alias("cutoff"))


def adjust_p(tests: DataFrame, p: str = "p", by: Sequence[str] = ("muttype",), tie: Sequence[str] = ()) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg adjustment of a group's tests (one for each sample)."""
    w = Window.partitionBy(*by)
    up = w.orderBy(p, *tie)
    df = tests.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(up))
    df = df.withColumn("bonferroni", F.least(F.lit(1.0), F.col("_n") * F.col(p)))
    df = df.withColumn("holm", F.least(F.lit(1.0), F.max((F.col("_n") - F.col("_i") + 1) * F.col(p)).over(up.rowsBetween(Window.unboundedPreceding, 0))))
    down = w.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("bh", F.least(F.lit(1.0), F.min(F.col("_n") / F.col("_i") * F.col(p)).over(down)))
    return df.drop("_n", "_i")


def standardise(df: DataFrame, column: str, name: str) -> DataFrame:
    """(log10(x) - mean) / sd, 0 as NULL; the two numbers are a scalar subquery each."""
    log = F.when(F.col(column) > 0, F.log10(column))
    stats = df.agg(F.avg(log).alias("m"), F.stddev_samp(log).alias("s"))
    return df.withColumn(name, (log - stats.select("m").scalar()) / stats.select("s").scalar())
