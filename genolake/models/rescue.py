"""Rescue by signature over many cells at once: one spectrum of all cells' calls, then weights and rescued sites of every cell in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs
from ..operators import filters, windows
from ..sources import inputs, stored
from . import sampling

GROUP = ["sample", "muttype"]


def true_spectrum(calls: DataFrame, channels: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(muttype, channel, true_sig) over all channels of each type that has calls: shares of the calls (muttype, channel) of all cells and of ``extra`` ones."""
    own = calls.select("muttype", "channel")
    own = own if extra is None else own.unionByName(extra.select("muttype", "channel"))
    counts = own.where("channel is not null").groupBy("muttype", "channel").agg(F.count("*").alias("n"))
    dense = channels.select("muttype", "channel").join(counts, ["muttype", "channel"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = F.sum("n").over(Window.partitionBy("muttype"))
    return dense.select("muttype", "channel", exprs.div(F.col("n").cast("double"), whole).alias("true_sig")).where("true_sig is not null")


def homogeneity(calls: DataFrame, true: DataFrame) -> DataFrame:
    """(sample, muttype, p, bonferroni, holm, bh): whether a cell's calls go with the spectrum of all, adjusted over the cells of a type."""
    counts = calls.groupBy("sample", "muttype", "channel").agg(F.count("*").alias("n"))
    expected: dict[str, dict[str, float]] = {}
    for r in true.collect():  # a few hundred channels
        expected.setdefault(r["muttype"], {})[r["channel"]] = r["true_sig"]
    parts = [sampling.by_sample(counts.where(F.col("muttype") == t).select("sample", "channel", "n"), e).withColumn("muttype", F.lit(t)) for t, e in sorted(expected.items())]
    if not parts:
        return calls.sparkSession.createDataFrame([], "sample string, muttype string, p double, bonferroni double, holm double, bh double")
    return windows.adjust_p(reduce(DataFrame.unionByName, parts), tie=["sample"]).select("sample", "muttype", "p", "bonferroni", "holm", "bh")


def batch(cells: DataFrame, artifact: DataFrame, *, true: DataFrame | None = None, extra: DataFrame | None = None, target_fdr: float = 0.01, rescue_fdr: float = 0.01) -> dict[str, DataFrame]:
    """Rescue of all cells' sites: tables ``sites``, ``weights``, ``true`` and ``tests`` by name.

    cells: called sites of all cells with their sample, muttype, channel, tests,
    rates and priors (``filters.call``).  artifact: (muttype, channel,
    artifact_sig), all channels of each type.  The true signature is ``true``
    (muttype, channel, true_sig), or the spectrum of all cells' calls and of
    ``extra`` calls (muttype, channel); a type without calls is left alone.

    sites: the rows worth a second look with weight, rescue_fdr and rescue; each
    cell's candidates tell how much of either signature they have.  The table of
    all cells is read once; what it is reduced to is written.
    """
    reduced = stored.written(filters.reduced(cells), "reduced")
    calls = reduced.where("pass")
    signature = stored.written(true_spectrum(calls, artifact, extra) if true is None else inputs.signatures(true, artifact), "true-signature")
    counts = reduced.where(filters.only_early(target_fdr)).groupBy(*GROUP, "channel").agg(F.count("*").alias("n"))
    both = artifact.select("muttype", "channel", "artifact_sig").join(signature, ["muttype", "channel"])
    dense = counts.select(*GROUP).distinct().join(both, "muttype").join(counts, [*GROUP, "channel"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = exprs.div(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(*GROUP)))
    weights = stored.written(filters.rescue_weights(dense.withColumn("share", F.coalesce(share, F.lit(0.0))), GROUP), "weights")
    sites = filters.rescued(reduced, weights, target_fdr, rescue_fdr, GROUP)
    return {"sites": sites, "weights": weights, "true": signature, "tests": homogeneity(calls, signature)}
