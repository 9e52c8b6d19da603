"""Views of finished tables: what is shared between samples, calls with their neighbours put together, and coverage along positions or GC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggs, windows
from ..sources import stored

#: The columns that tables of several samples share.
SHARED = ("sample", "chr", "pos", "refnt", "altnt", "muttype", "mutsig", "af", "scalt", "dp", "abc_pv", "balt", "bulk_dp", "resampled_training_site", "pass", "rescue", "training_pass")
KEY = ("sample", "chr", "pos", "refnt", "altnt")


def shared_table(parts: Sequence[DataFrame], contigs: Sequence[str] = ()) -> DataFrame:
    """The shared columns of several tables, one row for each site of a sample: that of the first table that has it.

    Columns that a table lacks are NULL.  Rows are in the order of ``contigs``, other chromosomes after them by name, then by position and alleles.
    """
    out = None
    for k, part in enumerate(parts):
        kinds = {"af": "double", "abc_pv": "double", "scalt": "int", "dp": "int", "balt": "int", "bulk_dp": "int", "pos": "int", **dict.fromkeys(("resampled_training_site", "pass", "rescue", "training_pass"), "boolean")}
        own = part.select(F.lit(k).alias("_part"), *[(F.col(c) if c in part.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in SHARED])
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no tables")
    rest = [c for c in SHARED if c not in KEY]
    # of rows that a table repeats the smallest; rows are sorted once, and written, as an order over them looks at them twice
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("_part", *rest))
    one = stored.written(out.withColumn("_k", first).where("_k = 1").select(*SHARED), "shared")
    return one.orderBy(ordinal(F.col("chr"), contigs), "chr", "pos", "refnt", "altnt", "sample")


def ordinal(chromosome: Column, contigs: Sequence[str]) -> Column:
    """The place of a chromosome in a list, or one after all of it."""
    return F.coalesce(F.nullif(F.array_position(F.lit(list(contigs)).cast("array<string>"), chromosome), F.lit(0)), F.lit(len(contigs) + 1))


def binned_along(bins: DataFrame, value: str, along: str = "pos") -> DataFrame:
    """Coverage of one sample or several (with a ``sample`` column): (chr, pos, value) at the middle of each bin, or (gc, value), its mean at each rounded GC.

    Along GC, groups whose next one is 0.05 or more away are left out.
    """
    by = ["sample"] if "sample" in bins.columns else []
    if along == "pos":
        middle = F.floor((F.col("start").cast("long") + F.col("end_")) / 2).cast("int")
        return bins.select(*by, "chr", middle.alias("pos"), F.col(value).cast("double").alias("value"))
    if along != "gc":
        raise ValueError("along is pos or gc")
    if not by:
        return aggs.gc_groups(bins, value).select("gc", F.col("mean").alias("value"))
    return aggs.gc_groups(bins, value, by=by).select(*by, "gc", F.col("mean").alias("value"))


def combined_neighbours(calls: DataFrame, by: Sequence[str] = ("sample", "chr"), max_read_diff: int = 2) -> DataFrame:
    """Calls (.., pos, refnt, altnt, muttype, scalt, scref) with substitutions at adjacent positions as one row (``windows.merge_neighbours``) in their members' place.

    Other columns of such a row are NULL; ``n_combined`` is its number of members, else 1.
    """
    by = list(by)
    calls = stored.written(calls, "calls")
    single = calls.where("muttype = 'snv'")
    merged = windows.merge_neighbours(single, by, max_read_diff).select(*by, "pos", "refnt", "altnt", "muttype", F.col("n").cast("int").alias("n_combined"))
    merged = stored.written(merged, "neighbours")
    members = merged.select(*by, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n_combined") - 1)).alias("pos"))
    # merged: the neighbours' files may be so small that they would be sent whole to every task, where they take a hundred times as much
    rest = single.join(stored.dealt(members, *by, "pos", of=calls).hint("merge"), [*by, "pos"], "left_anti").unionByName(calls.where("muttype <> 'snv'")).withColumn("n_combined", F.lit(1))
    return rest.unionByName(merged, allowMissingColumns=True)
