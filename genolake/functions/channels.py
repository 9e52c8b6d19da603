"""Mutation channels: 96 substitutions and 83 insertions and deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exprs


def substitutions(spark: SparkSession) -> DataFrame:
    """(idx, channel) of the 96 substitutions."""
    names = [f"{a}{r}{b}:{r}>{t}" for r in "CT" for t in "ACGT" if t != r for a in "ACGT" for b in "ACGT"]
    return spark.createDataFrame(list(enumerate(names)), "idx int, channel string")


def indels(spark: SparkSession) -> DataFrame:
    """(idx, channel) of the 83: by length, base, repeats and microhomology."""
    names = [f"1:{kind}:{base}:{k}" for kind in ("Del", "Ins") for base in "CT" for k in range(6)]
    names += [f"{size}:{kind}:R:{k}" for kind in ("Del", "Ins") for size in range(2, 6) for k in range(6)]
    names += [f"{size}:Del:M:{k}" for size in range(2, 6) for k in range(1, min(size, 6))] + ["5:Del:M:5"]
    return spark.createDataFrame(list(enumerate(names)), "idx int, channel string")


def context(sites: DataFrame, reference: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Adds ctx, the three bases around pos, from reference chunks (chr, chunk_id, seq) that overlap by two bases.

    Chunk c holds positions c * chunk + 1 onward; a site meets the one chunk that has its neighbours.
    """
    cid = F.floor((F.col("pos") - 2) / chunk).cast("int")
    joined = sites.withColumn("chunk_id", cid).join(reference.select("chr", "chunk_id", "seq"), ["chr", "chunk_id"], "left")
    return joined.withColumn("ctx", F.when(F.col("pos") >= 2, F.expr(f"substring(seq, pos - 1 - chunk_id * {chunk}, 3)"))).drop("seq", "chunk_id")


def substitution(sites: DataFrame) -> DataFrame:
    """Adds channel to (ctx, altnt)."""
    return sites.withColumn("channel", exprs.substitution_channel(F.col("ctx"), F.col("altnt")))


def _repeats(unit: Column, right: Column, most: int) -> Column:
    """How often the unit follows itself in the sequence on the right."""
    out = F.lit(0)
    for k in range(1, most + 1):
        out = F.when(F.startswith(right, F.repeat(unit, F.lit(k))), k).otherwise(out)
    return out


def indel(ref: Column, alt: Column, right: Column, left: Column) -> Column:
    """The 83-channel name of an anchored insertion or deletion, given the sequences right of it and left up to its anchor.

    Length (5 for longer); for one base its pyrimidine; copies of the unit on the right (5 for more); for deletions
    of several bases without a copy, the longest microhomology on either side.
    """
    deleted = F.length(ref) > F.length(alt)
    unit = F.when(deleted, F.substr(ref, F.lit(2))).otherwise(F.substr(alt, F.lit(2)))
    size = F.least(F.length(unit), F.lit(5))
    copies = _repeats(unit, right, 5)
    base = F.when(unit.isin("A", "G"), exprs.reverse_complement(unit)).otherwise(unit)
    homology = F.lit(0)
    for k in range(1, 6):
        both = F.startswith(right, F.substring(unit, 1, k)) | F.endswith(left, F.substr(unit, F.length(unit) - k + 1))
        homology = F.when((F.length(unit) > k) & both, k).otherwise(homology)
    kind = F.when(deleted, "Del").otherwise("Ins")
    single = F.concat_ws(":", F.lit("1"), kind, base, copies.cast("string"))
    several = F.when(deleted & (copies == 0) & (homology > 0), F.concat_ws(":", size.cast("string"), kind, F.lit("M"), homology.cast("string"))).otherwise(F.concat_ws(":", size.cast("string"), kind, F.lit("R"), copies.cast("string")))
    return F.when(F.length(unit) == 1, single).when(F.length(unit) > 1, several)
