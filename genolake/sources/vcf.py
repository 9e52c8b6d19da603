"""VCF text of one cell and its bulk."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..operators import filters

#: The names, numbers and types of the fields.
FORMATS = (
    ("GT", "1", "String", "Genotype"), ("AD", "R", "Integer", "Reads of each allele"), ("DP", "1", "Integer", "Depth"), ("AF", "A", "Float", "Allele fraction"),
    ("AB", "1", "Float", "Allele balance of the model; cell only"), ("ABSD", "1", "Float", "Deviation of the balance in logits; cell only"),
    ("ABC", "A", "Float", "-log10 p of fraction and balance; cell only"), ("PAA", "1", "Float", "-log10 rate of artifacts before amplification; cell only"),
    ("AA", "1", "Float", "-log10 rate of artifacts of amplification; cell only"), ("GQ", "1", "Float", "The smaller of PAA and AA; cell only"), ("SC", "A", "Integer", "Candidate of a somatic mutation; cell only"),
)
FORMAT = "GT:DP:AD:AF:AB:ABSD:ABC:PAA:AA:GQ:SC"
INFOS = (("DB", "0", "Flag", "In dbSNP"), ("MSC", "A", "String", "Mutation channel"), ("BALT_LOWMQ", "1", "Integer", "Variant reads in the bulk at low mapping quality"), ("TS", "0", "Flag", "Training site"))
FILTERS = ("PASS", "RESCUE", "pre.amplification.artifact", "amplification.artifact", "hard.filters", *filters.LABELS.values())


def contigs(spark: SparkSession, fai: str) -> list[tuple[str, int]]:
    """Names and lengths from the index of a FASTA file, in its order; a row for each chromosome."""
    rows = spark.read.csv(fai, sep="\t", schema="name string, length long, offset long, bases int, width int").withColumn("k", F.monotonically_increasing_id()).orderBy("k")
    return [(r["name"], r["length"]) for r in rows.collect()]


def header(contigs_: Sequence[tuple[str, int]], sample: str, bulk: str = "bulk", reference: str = ".", source: str = f"genolake {__version__}") -> list[str]:
    """The lines before the records."""
    lines = ["##fileformat=VCFv4.4", f"##fileDate={datetime.date.today()}", f"##source={source}"]
    lines += [f'##FILTER=<ID={name},Description="{name.replace(".", " ")}">' for name in FILTERS]
    lines += [f'##{kind}=<ID={i},Number={n},Type={t},Description="{d}">' for kind, fields in (("INFO", INFOS), ("FORMAT", FORMATS)) for i, n, t, d in fields]
    lines += ["##META=<ID=SampleType,Type=String,Number=.,Values=[SingleCell,Bulk]>", f"##SAMPLE=<ID={sample},SampleType=SingleCell>", f"##SAMPLE=<ID={bulk},SampleType=Bulk>", f"##PEDIGREE=<ID={sample},Original={bulk}>"]
    lines += [f"##reference={reference}", *(f"##contig=<ID={name},length={length}>" for name, length in contigs_)]
    return [*lines, "\t".join(("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample, bulk))]


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("."))


def _number(c: Column) -> Column:
    """Four digits; a dot for NULL."""
    infinite = F.abs(c) == F.lit(float("inf"))
    return F.when(c.isNull() | F.isnan(c), ".").when(infinite, F.when(c > 0, "Inf").otherwise("-Inf")).otherwise(F.format_string("%.4f", F.round(c, 4)))


def _score(c: str) -> Column:
    """-log10; infinite for 0."""
    return F.when(F.col(c) == 0, F.lit(float("inf"))).otherwise(-F.log10(c))


def info() -> Column:
    return F.concat(F.lit("MSC="), _text("mutsig"), F.lit(";BALT_LOWMQ="), _text("balt_lowmq"), F.when(F.col("dbsnp") != ".", ";DB").otherwise(""), F.when(F.col("training_site"), ";TS").otherwise(""))


def record(target_fdr: float = 0.01, rescue: bool = False, simple: bool = False) -> Column:
    """The line of a site: its reasons as filters, INFO, and the fields of the cell and the bulk; what is missing is a dot."""
    called = F.coalesce("pass", F.lit(False)) | (F.coalesce("rescue", F.lit(False)) if rescue else F.lit(False))
    reads = lambda ref, alt: F.concat(_text(ref), F.lit(","), _text(alt))
    both = F.when(F.col("lysis_fdr").isNotNull() & F.col("mda_fdr").isNotNull(), F.least(_score("lysis_fdr"), _score("mda_fdr")))
    # an array's elements share the code of one: written out for each, a line took twice the time
    numbers = F.transform(F.array(F.col("af"), F.col("ab"), F.col("gp_sd"), _score("abc_pv"), _score("lysis_fdr"), _score("mda_fdr"), both), _number)
    cell = [F.when(called, "0/1").otherwise("./."), _text("dp"), reads("scref", "scalt"), numbers, F.coalesce(F.col("somatic_candidate").cast("int"), F.lit(0)).cast("string")]
    bulk = [F.coalesce("phased_gt", "bulk_gt", F.lit("./.")), _text("bulk_dp"), reads("bref", "balt"), _number(F.col("bulk_af")), *[F.lit(".")] * 7]
    why = filters.first_reason(target_fdr, rescue) if simple else filters.reasons(target_fdr, rescue)
    why = F.when(F.coalesce(why, F.lit("")) == "", ".").otherwise(why)
    dot = F.lit(".")
    return F.concat_ws("\t", _text("chr"), _text("pos"), _text("dbsnp"), _text("refnt"), _text("altnt"), dot, why, info(), F.lit(FORMAT), F.concat_ws(":", *cell), F.concat_ws(":", *bulk))


def lines(sites: DataFrame, target_fdr: float = 0.01, **how) -> DataFrame:
    return sites.select(record(target_fdr, **how).alias("line"))


def write(sites: DataFrame, path: str, contigs_: Sequence[tuple[str, int]], sample: str, target_fdr: float = 0.01, **how) -> None:
    """A folder of VCF text, ranged by chromosome order and position; the header is the first line of the first file.  Refuses to overwrite."""
    spark = sites.sparkSession
    order = spark.createDataFrame([(name, k) for k, (name, _) in enumerate(contigs_)], "chr string, _ord int")  # a row for each chromosome
    text = sites.join(F.broadcast(order), "chr").select("_ord", F.col("pos").cast("long").alias("_pos"), record(target_fdr, **how).alias("line"))
    top = spark.createDataFrame([(-1, k, line) for k, line in enumerate(header(contigs_, sample))], "_ord int, _pos long, line string")
    top.unionByName(text).repartitionByRange("_ord", "_pos").sortWithinPartitions("_ord", "_pos", "line").select("line").write.text(path)
