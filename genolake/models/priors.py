"""False-discovery priors: how many somatic mutations fit under the candidates' histogram, and the tables made of that.

Training sites tell how mutations spread over bins of the allele fraction at a
depth.  The largest number of mutations that still fits under the candidates of
that depth is taken as true; what is over is artifact.  A training site is judged
as if it were left out of the training sites and added to the candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs
from ..operators.filters import Params, by_type
from ..sources import stored

KEY = ["muttype", "dp_idx"]
EPS = 0.1


def fits_under(n: int, g: np.ndarray, s: np.ndarray) -> float:
    """P(multinomial(n, g) <= s in all bins), exactly.

    Counts are independent Poisson numbers given their sum: a convolution of their
    cut distributions, each over the values that have any weight to speak of.
    """
    if n <= 0:
        return 1.0
    parts = []
    for mean, most in zip((g / g.sum() * n).tolist(), s.astype(int).tolist(), strict=True):
        reach = 12 * math.sqrt(mean) + 30
        low, high = max(0, int(mean - reach)), min(most, n, int(mean + reach))
        if high < low:
            return 0.0
        parts.append((mean, low, high))
    least, greatest = sum(low for _, low, _ in parts), sum(high for _, _, high in parts)
    at, total = 0, np.ones(1)
    for mean, low, high in parts:
        k = np.arange(low, high + 1)
        first = low * math.log(mean) - mean - math.lgamma(low + 1) if mean > 0 else 0.0
        log = first + np.append(0.0, np.cumsum(np.log(mean / k[1:]))) if mean > 0 else np.where(k == 0, 0.0, -np.inf)
        total, at, least, greatest = np.convolve(total, np.exp(log)), at + low, least - low, greatest - high
        skip = max(0, n - greatest - at)  # sums that the bins to come can still bring to n
        total, at = total[skip : max(skip, n - least - at + 1)], at + skip
        if not len(total):
            return 0.0
    if n - at >= len(total):
        return 0.0
    return min(1.0, float(total[n - at]) / math.exp(n * math.log(n) - n - math.lgamma(n + 1)))


def sizes(total: int) -> np.ndarray:
    """The numbers of mutations that are tried: to 100 each, then up to 100 at equal steps; all below the number of candidates."""
    x = np.concatenate([np.arange(1.0, 101), np.linspace(101, total, min(total, 100))])
    return np.sort(x[x < total])


def burden(g: np.ndarray, s: np.ndarray, high: float = 0.995, low: float = 0.005) -> tuple[float, float]:
    """The largest numbers of mutations that fit with the two probabilities: the least and the most to be expected; 0 if none does."""
    tried = sizes(int(s.sum()))
    if not len(tried) or g.sum() == 0:
        return 0.0, 0.0

    def last(p: float) -> float:
        a, b = 0, len(tried)  # the probability falls with the number
        while a < b:
            m = (a + b + 1) // 2
            a, b = (m, b) if fits_under(int(tried[m - 1]), g, s) >= p else (a, m - 1)
        return float(tried[a - 1]) if a else 0.0

    return last(high), last(low)


def populations(params: dict[str, Params]) -> tuple[Column, Column]:
    """Which sites count as germline and which as candidates: enough reads and depth for their type; germline sites need the bulk's depth as well."""
    p = lambda value: by_type(params, value)
    enough = (F.col("scalt") >= p(lambda x: x.min_sc_alt)) & (F.col("dp") >= p(lambda x: x.min_sc_dp))
    no = F.lit(False)
    return F.coalesce(F.col("training_site") & enough & (F.col("bulk_dp") >= p(lambda x: x.min_bulk_dp)), no), F.coalesce(F.col("somatic_candidate") & enough, no)


def depth_bounds(sites: DataFrame, params: dict[str, Params], share: float = 0.8) -> DataFrame:
    """(muttype, max_dp): for each type the depth below which ``share`` of its germline sites lie; deeper sites are one group.  0 without such sites."""
    germline = populations(params)[0]
    types = sites.sparkSession.createDataFrame([(t,) for t in sorted(params)], "muttype string")
    found = sites.where(germline).groupBy("muttype").agg(F.floor(F.percentile("dp", share)).cast("int").alias("max_dp"))
    return types.join(found, "muttype", "left").select("muttype", F.coalesce("max_dp", F.lit(0)).alias("max_dp"))


def histograms(sites: DataFrame, bounds: DataFrame, params: dict[str, Params], bins: int = 20) -> DataFrame:
    """(muttype, dp_idx, bin, g, s): germline sites with reads of the allele and candidates, by depth and allele fraction."""
    germline, candidate = populations(params)
    rows = sites.select("muttype", "dp", "af", (germline & (F.col("af") > 0)).alias("_g"), (candidate & F.col("af").isNotNull()).alias("_s")).where("_g or _s").join(F.broadcast(bounds), "muttype")  # a row for each type: else all rows of a type meet in one task
    return rows.groupBy("muttype", exprs.depth_index(F.col("dp"), F.col("max_dp")).alias("dp_idx"), exprs.vaf_bin(F.col("af"), F.col("dp"), bins).alias("bin")).agg(F.count_if("_g").alias("g"), F.count_if("_s").alias("s"))


def burdens(histograms_: DataFrame) -> DataFrame:
    """(muttype, dp_idx, low, high) of ``burden``: a task's work for each depth."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        low, high = burden(part["g"].to_numpy(float), part["s"].to_numpy(float))
        return pd.DataFrame({"muttype": [part["muttype"].iloc[0]], "dp_idx": [part["dp_idx"].iloc[0]], "low": [low], "high": [high]})

    # small rows, much work: by a number, so that they aren't put together
    return histograms_.select(*KEY, "g", "s").repartition(4 * histograms_.sparkSession.sparkContext.defaultParallelism, *KEY).groupBy(*KEY).applyInPandas(run, "muttype string, dp_idx int, low double, high double")


def tables(histograms_: DataFrame, burdens_: DataFrame, bins: int = 20, eps: float = EPS) -> DataFrame:
    """(muttype, dp_idx, bin, g, s, b, nt, na, loo_nt, loo_na) for all bins of each depth, from (muttype, dp_idx, high).

    nt true mutations and na artifacts are at least ``eps`` each, and so much where
    a depth has no germline sites or no candidates.  With one site left out, the
    mutations are one more and so is its own bin of candidates.
    """
    each = histograms_.select(*KEY).distinct().select(*KEY, F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    dense = each.join(histograms_, [*KEY, "bin"], "left").select(*KEY, "bin", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("s", F.lit(0)).alias("s"))
    whole = Window.partitionBy(*KEY)
    dense = dense.join(burdens_.select(*KEY, F.col("high").alias("b")), KEY).withColumns({"_g": F.sum("g").over(whole), "_s": F.sum("s").over(whole)})
    least = lambda c: F.greatest(c, F.lit(eps))
    share = exprs.div(F.col("g").cast("double"), F.col("_g"))
    nt, more = least(F.col("b") * share), least((F.col("b") + 1) * share)
    none, flat = F.lit(eps), (F.col("_g") == 0) | (F.col("_s") == 0)
    return dense.select(
        *KEY, "bin", "g", "s", "b", F.when(flat, none).otherwise(nt).alias("nt"), F.when(flat, none).otherwise(least(F.col("s") - nt)).alias("na"),
        F.when(F.col("_g") == 0, none).otherwise(more).alias("loo_nt"), F.when(F.col("_g") == 0, none).otherwise(least(F.col("s") + 1 - more)).alias("loo_na"))


def priors(histograms_: DataFrame, eps: float = EPS) -> DataFrame:
    """``tables`` of histograms with their own burdens; a few hundred depths of 20 bins, written as they are read four times."""
    counted = stored.written(histograms_, "histograms")
    return tables(counted, burdens(counted), eps=eps)


def counts(sites: DataFrame, params: dict[str, Params], bins: int = 20) -> tuple[DataFrame, DataFrame]:
    """``depth_bounds`` and ``histograms`` of the sites, written."""
    bounds = stored.written(depth_bounds(sites, params), "depth-bounds")
    return bounds, stored.written(histograms(sites, bounds, params, bins), "prior-histograms")


def assign(sites: DataFrame, params: dict[str, Params], known: DataFrame | None = None, bins: int = 20, eps: float = EPS, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Adds nt and na by depth and allele fraction; training sites with enough reads of the allele have those of a site left out.

    ``known`` are burdens (muttype, dp_idx, high) of a run before, instead of those
    of the sites, ``counted`` what ``counts`` gives for the sites, if it is there already.  The sites' type, dp, af, scalt, bulk_dp, training_site and
    somatic_candidate are read; a depth or bin that no population has gets ``eps``
    (bins of a depth that has germline sites: as ``tables`` says), a site without
    a depth NULL.
    """
    bounds, histograms_ = counts(sites, params, bins) if counted is None else counted
    table = stored.written(tables(histograms_, burdens(histograms_) if known is None else known, bins, eps).select(*KEY, F.col("bin").alias("_bin"), "nt", "na", "loo_nt", "loo_na"), "priors")
    at = sites.drop("nt", "na").join(F.broadcast(bounds), "muttype", "left").withColumns({"dp_idx": exprs.depth_index(F.col("dp"), F.col("max_dp")), "_bin": exprs.vaf_bin(F.col("af"), F.col("dp"), bins)})
    left_out = F.coalesce(F.col("training_site") & (F.col("scalt") >= by_type(params, lambda x: x.min_sc_alt)), F.lit(False))
    pick = lambda c: F.when(F.col("dp_idx").isNotNull(), F.coalesce(F.when(left_out, F.col(f"loo_{c}")).otherwise(F.col(c)), F.lit(eps)))
    got = at.join(table, [*KEY, "_bin"], "left")
    return got.withColumns({"_nt": pick("nt"), "_na": pick("na")}).drop("nt", "na", "loo_nt", "loo_na", "max_dp", "dp_idx", "_bin").withColumnsRenamed({"_nt": "nt", "_na": "na"})
