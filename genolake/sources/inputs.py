"""The tables that an analysis reads, with their columns and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from . import tabular

KEY = ("chr", "pos", "refnt", "altnt")
#: The columns of the integrated table before the samples' own.
INTEGRATED = (
    "chr string, pos int, dbsnp string, refnt string, altnt string, bulk_gt string, bref int, balt int, bulk_dp int, bulk_af double, bulk_binom_prob double, tref int, talt int, tcells int, muttype string, mutsig string, balt_lowmq int, "
    "phased_gt string, training_site boolean, nalleles int, unique_donors int, unique_cells int, unique_bulks int, max_out int, sum_out int, sum_bulk int, somatic_candidate boolean, resampled_training_site boolean"
)
PANEL = "chr string, pos int, nalleles int, unique_donors int, unique_cells int, unique_bulks int, max_out int, sum_out int, sum_bulk int"
FITS = "chr string, a double, b double, c double, d double, logp double"
GC = "chr string, start int, end_ int, gc double"
NULL_SITES = "muttype string, id_x double, id_y double, hs_x double, hs_y double, id_score double, hs_score double"


def once(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """The table, after a check that no key repeats."""
    if again := tabular.duplicates(df, keys).limit(1).collect():
        raise ValueError(f"repeated row: {', '.join(str(again[0][k]) for k in keys)}")
    return df


def integrated(spark: SparkSession, path: str, sample: str, region: tuple[str, int, int] | None = None) -> DataFrame:
    """The integrated table with the counts of one sample: dp, af and the reads of both haplotypes.  Only its three columns are read."""
    fixed = [c.split()[0] for c in INTEGRATED.split(", ")]
    samples = tabular.header(spark, path)[len(fixed) :: 3]
    if sample not in samples:
        raise ValueError(f"no sample {sample}; there are {', '.join(samples)}")
    wide = ", ".join([INTEGRATED] + [f"`gt_{k}` string, `ref_{k}` int, `alt_{k}` int" for k in range(len(samples))])
    k = samples.index(sample)
    df = tabular.read(spark, path, wide, region, [*fixed, f"gt_{k}", f"ref_{k}", f"alt_{k}"]).select(*fixed, F.col(f"gt_{k}").alias("gt"), F.col(f"ref_{k}").alias("scref"), F.col(f"alt_{k}").alias("scalt"))
    dp = F.col("scref") + F.col("scalt")
    one, two = exprs.haplotypes(F.col("phased_gt"), F.col("scref"), F.col("scalt"))
    return df.withColumns({"dp": dp, "af": exprs.div(F.col("scalt").cast("double"), dp), "hap1": one, "hap2": two})


def training(spark: SparkSession, path: str, sample: str, region=None) -> DataFrame:
    """The SNV training sites of the integrated table."""
    return integrated(spark, path, sample, region).where("training_site and muttype = 'snv'")


def depths(spark: SparkSession, path: str, cell: str, bulk: str, coordinates: bool = False, region=None) -> DataFrame:
    """(sc_dp, bulk_dp), with chr and pos if wanted, from a table of a depth column for each sample."""
    samples = tabular.header(spark, path)[2:]
    for name in (cell, bulk):
        if name not in samples:
            raise ValueError(f"no sample {name}; there are {', '.join(samples)}")
    wide = ", ".join(["chr string, pos int", *(f"`dp_{k}` int" for k in range(len(samples)))])
    df = tabular.read(spark, path, wide, region, list(dict.fromkeys(["chr", "pos", f"dp_{samples.index(cell)}", f"dp_{samples.index(bulk)}"])))
    own = [F.col(f"dp_{samples.index(cell)}").alias("sc_dp"), F.col(f"dp_{samples.index(bulk)}").alias("bulk_dp")]
    return df.select(*(["chr", "pos"] if coordinates else []), *own)


def phased_sites(hsnps: DataFrame, called: DataFrame) -> DataFrame:
    """Phased sites (chr, pos, dbsnp, refnt, altnt, phasedgt) that the bulk's calls have as well, with the fields of a call left blank.

    A site is looked up by all five of its fields; calls that repeat one don't
    multiply it.  Without calls there are no rows.
    """
    key = ["chr", "pos", "dbsnp", "refnt", "altnt"]
    for name, df in (("phased sites", hsnps), ("calls", called)):
        if lost := [c for c in key if c not in df.columns]:
            raise ValueError(f"{name} lack {', '.join(lost)}")
    blank = {"qual": ".", "filter": ".", "info": ".", "format": "GT"}
    return hsnps.join(called.select(*key), key, "left_semi").select(*key, *[F.lit(v).alias(c) for c, v in blank.items()], "phasedgt")


def fits(spark: SparkSession, path: str) -> DataFrame:
    """Parameters of the allele balance, a row for each chromosome: a Parquet table or text."""
    df = _stored(spark, path, FITS, ("chr", "a", "b", "c", "d"))
    return once(df, ["chr"])


DEPTHS = "sc_dp int, bulk_dp int, n long, chr_group string"


def depth_profile(spark: SparkSession, path: str, clamp: int = 500) -> DataFrame:
    """(sc_dp, bulk_dp, n, chr_group) of a stored depth table; depths over ``clamp``, negative counts or repeated pairs are an error."""
    df = _stored(spark, path, DEPTHS, ("sc_dp", "bulk_dp", "n"))
    if odd := df.where(f"not (sc_dp between 0 and {clamp} and bulk_dp between 0 and {clamp} and n >= 0)").limit(1).collect():
        raise ValueError(f"not a depth table: {odd[0]}")
    return once(df, ["chr_group", "sc_dp", "bulk_dp"])


def _stored(spark: SparkSession, path: str, schema: str, needed: Sequence[str]) -> DataFrame:
    """A Parquet table in the schema's columns and types, or tab-separated text by its header; columns that it may lack are NULL."""
    parts = [c.split() for c in schema.split(", ")]
    if path.endswith((".tab", ".tsv", ".txt", ".gz")):
        names = tabular.header(spark, path)
        df = tabular.read(spark, path, ", ".join(f"`{n}` {dict(parts).get(n, 'string')}" for n in names)) if names else None
    else:
        df = spark.read.parquet(path)
    if df is None or (lost := [c for c in needed if c not in df.columns]):
        raise ValueError(f"{path} lacks {', '.join(lost) if df is not None else 'a header'}")
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in parts])


def signatures(df: DataFrame, channels: DataFrame, name: str = "true_sig") -> DataFrame:
    """A signature or spectrum given by the user, (muttype, channel, <name>) over all channels of its types, after checks: known channels, each once, numbers of 0 or more that don't add up to 0."""
    if lost := [c for c in ("muttype", "channel", name) if c not in df.columns]:
        raise ValueError(f"a signature needs {', '.join(lost)}")
    once(df, ["muttype", "channel"])
    unknown = df.join(channels, ["muttype", "channel"], "left_anti").select("channel").limit(1).collect()
    low = df.where(f"{name} is null or {name} < 0 or isnan({name})").limit(1).collect()
    empty = df.groupBy("muttype").agg(F.sum(name).alias("s")).where("s = 0").limit(1).collect()
    if unknown or low or empty:
        raise ValueError(f"channel {unknown[0][0]} is not known" if unknown else f"channel {low[0]['channel']} has no share" if low else f"the signature of {empty[0]['muttype']} is empty")
    whole = channels.select("muttype", "channel").join(df.select("muttype").distinct(), "muttype", "left_semi")
    return whole.join(df.select("muttype", "channel", name), ["muttype", "channel"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def with_cigars(sites: DataFrame, cell: DataFrame, bulk: DataFrame) -> DataFrame:
    """Adds id_n, hs_n and cigar_dp of the cell, and those of the bulk, from two tables of ``tabular.CIGAR``."""
    out = sites
    for df, of in ((cell, ""), (bulk, "_bulk")):
        one = df.groupBy("chr", "pos").agg(F.max(F.struct("id", "hs", "dp")).alias("c"))
        out = out.join(one.select("chr", "pos", F.col("c.id").alias(f"id_n{of}"), F.col("c.hs").alias(f"hs_n{of}"), F.col("c.dp").alias(f"cigar_dp{of}")), ["chr", "pos"], "left")
    return out


def binned(spark: SparkSession, counts: str, gc: str) -> DataFrame:
    """(chr, start, end_, gc, cnt): every bin with GC, and its count or NULL."""
    return tabular.read(spark, gc, GC).join(tabular.read(spark, counts, tabular.BINS), ["chr", "start", "end_"], "left")


def precomputed(sites: DataFrame, scores: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """Adds columns computed before, after a check that both tables have the same sites."""
    scores = scores.select(*keys, *columns)
    lost = sites.join(scores, list(keys), "left_anti").select(*keys, F.lit("scores").alias("of")).unionByName(scores.join(sites, list(keys), "left_anti").select(*keys, F.lit("sites").alias("of")))
    if odd := lost.limit(1).collect():
        raise ValueError(f"{':'.join(str(odd[0][k]) for k in keys)} is not among the {odd[0]['of']}")
    return sites.join(once(scores, keys), list(keys))


def summaries(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A reduced table of all samples, written by ``pipeline.write_summaries``."""
    return spark.read.parquet(f"{folder}/{name}")


def together(parts: Sequence[DataFrame], same: Sequence[str] = ()) -> DataFrame:
    """The rows of several tables, after a check that each column of ``same`` has one value in all of them."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if same:
        row = out.agg(*[F.count_distinct(F.struct(c)).alias(c) for c in same]).first()
        if odd := [c for c in same if row[c] > 1]:
            raise ValueError(f"tables differ in {', '.join(odd)}")
    return out
