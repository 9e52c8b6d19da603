"""Aggregations over sites, depths, bins, tiles and spectra."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs
from ..sources import stored


def rounded_histogram(df: DataFrame, column: str, digits: int = 3) -> DataFrame:
    """(value, n) of values rounded half to even."""
    return df.where(F.col(column).isNotNull()).groupBy(F.bround(column, digits).alias("value")).agg(F.count("*").alias("n"))


def vaf_histogram(df: DataFrame, by: Sequence[str], bins: int = 20) -> DataFrame:
    """(by, bin, mid, n) for every bin of each group, from af and dp."""
    got = df.groupBy(*by, exprs.vaf_bin(F.col("af"), F.col("dp"), bins).alias("bin")).agg(F.count("*").alias("n"))
    grid = got.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return grid.join(got, [*by, "bin"], "left").select(*by, "bin", ((F.col("bin") - 0.5) / bins).alias("mid"), F.coalesce("n", F.lit(0)).alias("n"))


def spectrum(calls: DataFrame, channels: DataFrame, by: Sequence[str] = (), eps: float = 0.0, fraction: bool = True) -> DataFrame:
    """(by, channel, n, share) for every channel of each group; share is (n + eps) over its sum, NULL for an empty group."""
    got = calls.groupBy(*by, "channel").agg(F.count("*").alias("n"))
    grid = calls.select(*by).distinct().join(F.broadcast(channels.select("channel"))) if by else channels.select("channel")
    out = grid.join(got, [*by, "channel"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if not fraction:
        return out
    whole = Window.partitionBy(*by)
    return out.withColumn("share", exprs.div(F.col("n") + F.lit(eps), F.sum(F.col("n") + F.lit(eps)).over(whole)))


def depth_table(depth: DataFrame, by: Sequence[str] = (), clamp: int = 500) -> DataFrame:
    """(by, sc_dp, bulk_dp, n) with both depths cut at ``clamp``."""
    return depth.groupBy(*by, F.least("sc_dp", F.lit(clamp)).alias("sc_dp"), F.least("bulk_dp", F.lit(clamp)).alias("bulk_dp")).agg(F.count("*").alias("n"))


def mean_coverage(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted means of both margins of a depth table."""
    mean = lambda c: exprs.div(F.sum(F.col(c) * F.col("n")).cast("double"), F.sum("n"))
    return table.groupBy(*by).agg(mean("sc_dp").alias("sc_mean"), mean("bulk_dp").alias("bulk_mean"))


def analyzable(table: DataFrame, cutoffs: Mapping[str, tuple[int, int]], by: Sequence[str] = ()) -> DataFrame:
    """Bases at or above the cell's and the bulk's least depth of each name, and with any bulk read."""
    columns = [F.coalesce(F.sum(F.when((F.col("sc_dp") >= sc) & (F.col("bulk_dp") >= bulk), F.col("n"))), F.lit(0)).alias(name) for name, (sc, bulk) in cutoffs.items()]
    return table.groupBy(*by).agg(*columns, F.coalesce(F.sum(F.when(F.col("bulk_dp") > 0, F.col("n"))), F.lit(0)).alias("bulk_accessible"))


def below_cutoffs(table: DataFrame, sc: int, bulk: int, by: Sequence[str] = ()) -> DataFrame:
    """The shares of bases below the cell's, the bulk's and either cutoff."""
    part = lambda c: exprs.div(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("double"), F.sum("n"))
    low_sc, low_bulk = F.col("sc_dp") < sc, F.col("bulk_dp") < bulk
    return table.groupBy(*by).agg(part(low_sc).alias("below_sc"), part(low_bulk).alias("below_bulk"), part(low_sc | low_bulk).alias("below_either"))


def collapse_bins(bins: DataFrame, n: int, by: str = "chr") -> DataFrame:
    """Groups of n bins in a row: first start, last end, sum of counts, mean GC; a shorter last group stays."""
    at = F.floor((F.row_number().over(Window.partitionBy(by).orderBy("start")) - 1) / n)
    grouped = bins.withColumn("grp", at).groupBy(by, "grp")
    return grouped.agg(F.min("start").alias("start"), F.max_by("end_", "start").alias("end_"), F.sum("cnt").alias("cnt"), F.avg("gc").alias("gc")).drop("grp")


def mapd(bins: DataFrame, ratio: str, by: str = "chr") -> DataFrame:
    """Median absolute difference of log2 ratios of bins in a row; NULL ratios and those not over 0 have no logarithm."""
    log = F.when(F.col(ratio) > 0, F.log2(ratio))
    step = F.abs(log - F.lag(log).over(Window.partitionBy(by).orderBy("start")))
    return bins.select(step.alias("step")).agg(F.median("step").alias("mapd"))


def mapd_curve(bins: DataFrame, widths: Sequence[int] = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512), by: str = "chr") -> DataFrame:
    """(n_bins, mapd) over coarser and coarser bins, each level from the last; ratios to the median count."""
    out, level, last = None, bins, 1
    for n in widths:
        level = level if n == last else collapse_bins(level, n // last, by)
        last = n
        middle = level.agg(F.median("cnt").alias("m")).scalar()
        one = mapd(level.withColumn("_r", (F.col("cnt") + 1) / middle), "_r", by).select(F.lit(n).alias("n_bins"), "mapd")
        out = one if out is None else out.unionByName(one)
    return out


def gc_groups(bins: DataFrame, value: str = "log_ratio", digits: int = 3, gap: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Mean value by rounded GC in order; groups whose next GC is ``gap`` or more away are left out.  At most 10^digits groups (in each of ``by``)."""
    got = bins.where(F.col("gc").isNotNull()).groupBy(*by, F.bround("gc", digits).alias("gc")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return got.withColumn("_next", F.lead("gc").over(Window.partitionBy(*by).orderBy("gc"))).where((F.coalesce(F.col("_next") - F.col("gc"), F.lit(0.0))) < gap).drop("_next")


def strata(tiles: DataFrame, prediction: str = "pred", hits: str = "hits", total: str = "total", digits: int = 2) -> DataFrame:
    """Sums and rate by rounded prediction."""
    got = tiles.where(F.col(prediction).isNotNull()).groupBy(F.bround(prediction, digits).alias("stratum"))
    return got.agg(F.sum(hits).alias("hits"), F.sum(total).alias("total"), F.count("*").alias("n")).withColumn("rate", exprs.div(F.col("hits").cast("double"), F.col("total")))


def by_covariate(tiles: DataFrame, covariate: Column, digits: int = 2) -> DataFrame:
    """Measured rate and mean prediction by a rounded transform of a covariate."""
    got = tiles.withColumn("_c", F.bround(covariate, digits)).where("_c is not null").groupBy(F.col("_c").alias("covariate"))
    return got.agg(exprs.div(F.sum("hits").cast("double"), F.sum("total")).alias("rate"), F.avg("pred").alias("mean_pred"), F.count("*").alias("n"))


def sensitivity(tiles: DataFrame, by: Sequence[str] = ("muttype", "allele"), keep_zeros: bool = False) -> DataFrame:
    """Pooled rate, and mean, deviation and quartiles of predictions, over tiles with a prediction."""
    fine = tiles.where("pred is not null" + ("" if keep_zeros else " and total > 0"))
    return fine.groupBy(*by).agg(
        exprs.div(F.sum("hits").cast("double"), F.sum("total")).alias("pooled"), F.avg("pred").alias("mean"), F.stddev_samp("pred").alias("sd"),
        F.percentile("pred", 0.25).alias("q25"), F.percentile("pred", 0.75).alias("q75"))


def mean_burden(strata_: DataFrame, sensitivity_: str = "stratum") -> DataFrame:
    """Calls over the sum of tiles times sensitivity."""
    return strata_.agg(exprs.div(F.sum("hits").cast("double"), F.sum(F.col("n") * F.col(sensitivity_))).alias("burden"))


def mutation_burden(sites: DataFrame, depth: DataFrame, *, min_bulk_dp: int, gbp: float, copies: int = 2, least: int = 100) -> DataFrame:
    """Burden by strata 1, 2 (the middle half) and 4 of the training sites' depth quartiles.

    sites: dp, bulk_dp, training_site, training_pass, pass, read once for the
    quartiles (one row, written) and once for the strata; depth: sc_dp, bulk_dp, n.  Fewer
    than ``least`` training sites or quartiles that coincide give NULL and the reason.
    """
    edges = sites.where("training_site").agg(F.count("dp").alias("rows"), F.percentile("dp", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"))
    flat = F.exists(F.sequence(F.lit(1), F.lit(4)), lambda k: F.get("q", k - 1) >= F.get("q", k))
    reason = F.when(F.col("rows") < least, "few germline sites").when(flat, "quartiles coincide")
    one = stored.written(edges.agg(F.first(F.struct(reason.alias("reason"), "q")).alias("e")), "quartiles").scalar()  # many expressions name it

    def strata_of(df: DataFrame, dp: str) -> DataFrame:
        d, q = F.col(dp), lambda k: F.get("_e.q", F.lit(k))
        inner = F.when(d <= q(1), 1).when(d <= q(3), 2).otherwise(4)
        return df.withColumn("_e", one).withColumn("stratum", F.when((d >= q(0)) & (d <= q(4)), inner)).drop("_e")

    deep = F.coalesce(F.col("bulk_dp") >= min_bulk_dp, F.lit(False))
    got = strata_of(sites, "dp").groupBy("stratum").agg(
        F.avg(F.when(F.col("training_site") & deep, F.coalesce("training_pass", F.lit(False)).cast("double"))).alias("sens"), F.count_if(~F.col("training_site") & F.col("pass")).alias("ncalls"))
    bases = strata_of(depth.where(F.col("bulk_dp") >= min_bulk_dp), "sc_dp").groupBy("stratum").agg(F.sum("n").alias("callable_bp"))
    out = sites.sparkSession.range(1).select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("stratum"), one["reason"].alias("reason"))
    out = out.join(got, "stratum", "left").join(bases, "stratum", "left")
    ok = F.col("reason").isNull()
    ncalls = F.coalesce("ncalls", F.lit(0))
    rate = exprs.div(exprs.div(ncalls.cast("double"), F.col("sens")), F.col("callable_bp"))
    return out.select("stratum", "reason", F.when(ok, ncalls).alias("ncalls"), F.when(ok, F.col("sens")).alias("sens"), F.when(ok, F.coalesce("callable_bp", F.lit(0))).alias("callable_bp"), F.when(ok, rate * 1e9 / copies * gbp).alias("burden"))


def reported_burden(strata_: DataFrame, muttype: str, panel: DataFrame | None = None) -> DataFrame:
    """(burden) of the middle stratum; NULL for indels if the panel (unique_donors, unique_cells) has two cells or one donor at most."""
    middle = strata_.where("stratum = 2").select("burden")
    if muttype == "snv" or panel is None:
        return middle
    few = panel.agg((F.coalesce(F.max("unique_cells") <= 2, F.lit(True)) | F.coalesce(F.max("unique_donors") <= 1, F.lit(True))).alias("x")).scalar()
    return middle.select(F.when(~few, F.col("burden")).alias("burden"))


def shared_ways(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of sites called in more than one sample, with the number and names of samples; one row for each member."""
    ways = calls.groupBy(*keys).agg(F.count("*").alias("n_way"), F.array_join(F.array_sort(F.collect_list("sample")), "&").alias("samples")).where("n_way > 1")
    return calls.join(ways, list(keys))


def call_statistics(calls: DataFrame, fpr_per_mb: Mapping[str, float]) -> DataFrame:
    """(sample, muttype, metric, value) from (sample, muttype, calls, bp): calls, expected false positives, their share."""
    rate = F.lit(None).cast("double")
    for muttype, fpr in fpr_per_mb.items():
        rate = F.when(F.col("muttype") == muttype, F.lit(fpr)).otherwise(rate)
    fps = F.least(F.col("calls").cast("double"), F.col("bp") / 1e6 * rate)
    wide = calls.select("sample", "muttype", F.col("calls").cast("double").alias("calls"), fps.alias("fps"), exprs.div(fps, F.col("calls")).alias("fdr"))
    return wide.unpivot(["sample", "muttype"], ["calls", "fps", "fdr"], "metric", "value")


def correlation_by_distance(pairs: DataFrame, breaks: Sequence[float]) -> DataFrame:
    """(chr, bin, n, n_complete, mean_dist, max_dist, r, mean_dp) of neighbours (chr, dist, af_1, af_2, dp_1, dp_2); bins are right-closed."""
    at = F.when(F.lit(False), 0)
    for k, (low, high) in enumerate(zip(breaks, breaks[1:], strict=False), 1):
        at = at.when((F.col("dist") > low) & (F.col("dist") <= high), k)
    both = F.col("af_1").isNotNull() & F.col("af_2").isNotNull()
    got = pairs.withColumn("bin", at).where("bin is not null").groupBy("chr", "bin").agg(
        F.count("*").alias("n"), F.count_if(both).alias("n_complete"), F.avg("dist").alias("mean_dist"), F.max("dist").alias("max_dist"),
        F.corr(F.when(both, F.col("af_1")), F.when(both, F.col("af_2"))).alias("r"), F.floor(F.avg((F.col("dp_1") + F.col("dp_2")) / 2)).cast("int").alias("mean_dp"))
    r = F.when(F.isnan("r"), None).otherwise(F.col("r"))
    return got.withColumn("r", F.when(F.col("n_complete") >= 3, F.greatest(F.least(r, F.lit(0.99)), F.lit(-0.99))))


def by_frequency(df: DataFrame, *columns: str) -> DataFrame:
    """(columns, n) of distinct values, the most frequent first."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def transitions(calls: DataFrame) -> DataFrame:
    """(refnt, altnt, n, share): shares of each reference base."""
    got = calls.groupBy("refnt", "altnt").agg(F.count("*").alias("n"))
    return got.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("refnt")))


def ploidy(segments: DataFrame, candidates: DataFrame) -> DataFrame:
    """The total ploidy whose multiples of the segments' means come nearest to whole numbers; the smallest of ties.

    segments: seg, value, n.  Each segment's median is scaled to mean 1 over bins; candidates: a few dozen rows.
    """
    mean = segments.agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("m")).scalar()
    x = F.col("value") / mean * F.col("ploidy")
    scored = segments.join(F.broadcast(candidates)).groupBy("ploidy").agg(F.round(F.sum(F.col("n") * (x - F.round(x)) * (x - F.round(x))), 9).alias("error"))
    return scored.agg(F.min_by("ploidy", F.struct("error", "ploidy")).alias("ploidy"), F.min("error").alias("error"))


def density(histogram: DataFrame, value: str = "value", count: str = "n", points: int = 512, bandwidth: float = 0.02) -> DataFrame:
    """A Gaussian kernel density on 0..1 of a rounded histogram (at most a thousand values), weighted by counts."""
    total = histogram.agg(F.sum(count).alias("t")).scalar()
    grid = histogram.select(value, count, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("x", F.col("i") / F.lit(points - 1.0))
    z = (F.col("x") - F.col(value)) / bandwidth
    return grid.groupBy("i", "x").agg((F.sum(F.col(count) * F.exp(-0.5 * z * z)) / (bandwidth * 2.5066282746310002)).alias("d")).select("x", (F.col("d") / total).alias("density")).orderBy("x")
