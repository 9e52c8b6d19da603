"""Tab-separated tables with a # header, the long form of sample counts, and Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import indexed

META = "chr string, pos int, dbsnp string, refnt string, altnt string"
CIGAR = "chr string, pos int, m int, id int, hs int, other int, dp int"
BINS = "chr string, start int, end_ int, cnt long"
COVARIATES = "chr string, start int, end_ int, gp_mu double, gp_sd double"


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names: the last line that begins with #; of an indexed file its first block is read alone."""
    if indexed.known(path):
        return indexed.Reader.header(path)
    lines = spark.read.text(path).where(F.col("value").startswith("#")).select("value", F.monotonically_increasing_id().alias("k"))
    last = lines.orderBy(F.desc("k")).limit(1).collect()
    return last[0]["value"].lstrip("#").split("\t") if last else []


def read(spark: SparkSession, path: str, schema: str | StructType, region: tuple[str, int, int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A typed scan, of some columns if they are named; NA is NULL.  A region keeps positions inside; one of an unknown chromosome has no rows.

    The schema names the columns in order.  A compressed file with an index is read
    by its blocks: in many tasks, and only those of the region; without one it is a single task's.
    """
    if indexed.known(path):
        full = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        wanted = full if columns is None else StructType([full[c] for c in columns])
        return indexed.read(spark, path, wanted, region, names=full.names)
    df = spark.read.csv(path, sep="\t", comment="#", schema=schema, nullValue="NA")
    if region:
        chr_, start, end = region
        df = df.where((F.col("chr") == chr_) & F.col("pos" if "pos" in df.columns else "start").between(start, end))
    return df if columns is None else df.select(*columns)


def read_wide(spark: SparkSession, path: str, meta: str = META, region=None) -> DataFrame:
    """A table of meta columns and a triplet (genotype, ref, alt) for each sample, in long form: sample, gt, ref_n, alt_n."""
    fixed = [c.split()[0] for c in meta.split(", ")]
    samples = header(spark, path)[len(fixed) :: 3]
    wide = ", ".join([meta] + [f"`gt_{k}` string, `ref_{k}` int, `alt_{k}` int" for k in range(len(samples))])
    df = read(spark, path, wide, region)
    each = F.array(*[F.struct(F.lit(s).alias("sample"), F.col(f"gt_{k}").alias("gt"), F.col(f"ref_{k}").alias("ref_n"), F.col(f"alt_{k}").alias("alt_n")) for k, s in enumerate(samples)])
    return df.select(*fixed, F.inline(each))


def one_sample(long: DataFrame, sample: str) -> DataFrame:
    """The counts of one cell with depth and allele fraction."""
    own = long.where(F.col("sample") == sample).drop("sample").withColumnsRenamed({"ref_n": "scref", "alt_n": "scalt"})
    dp = F.col("scref") + F.col("scalt")
    return own.withColumns({"dp": dp, "af": F.try_divide(F.col("scalt").cast("double"), dp)})


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the rows of each key the first in the order, and of equal ones the smallest; all columns in place."""
    own = F.struct(*order, *[c for c in df.columns if c not in order])
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.min(own).alias("_one"))
    return one.select(*keys, *[F.col(f"_one.{c}").alias(c) for c in rest]).select(*df.columns)


def write(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A Parquet table by chromosome, ranged and sorted by position; refuses to overwrite unless told."""
    df.repartitionByRange("chr", "pos").sortWithinPartitions("chr", "pos").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("chr").parquet(path)


def write_tabs(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A folder of tab-separated text with NA for NULL and a # before the header."""
    named = df.select(*[F.col(c).alias(f"#{c}" if k == 0 else c) for k, c in enumerate(df.columns)])
    named.write.mode("overwrite" if overwrite else "errorifexists").csv(path, sep="\t", header=True, nullValue="NA")
