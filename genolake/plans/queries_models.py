"""Queries of the numeric models: rows are checked by unit tests, not by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..config import Config
from ..models import allele_balance, gauss_hermite, priors, regression, sampling, segments
from ..operators import filters, intervals
from ..sources import stored
from . import pipeline
from .adapters import duck, scored, view
from .queries import _MERGED, SITE_KEY, query, r6


def _scored(spark, sf_dir):
    """The scored sites with positions of 64 bits: no SQL holds these queries to 32, which large tables go beyond."""
    return scored(spark, sf_dir, wide=True)


@query()
def model_pvalues(spark, sf_dir):
    """P-values and betas of the read-count models for all sites; equal inputs are computed once."""
    s = _scored(spark, sf_dir).withColumn("mu", (F.col("dp") % 7 - 3) / 5.0).withColumn("sd", 0.5 + F.col("bulk_dp") % 4 / 4.0)
    out = gauss_hermite.models(s.select(*SITE_KEY, "scalt", "dp", F.col("mu").cast("double").alias("mu"), F.col("sd").cast("double").alias("sd")))
    return out.select(*SITE_KEY, *[r6(c) for c in gauss_hermite.COLUMNS])


def _training(spark, sf_dir):
    s = _scored(spark, sf_dir).where("training_site and muttype = 'snv'")
    return s.select("chr", "pos", exprs.haplotypes(F.col("phased_gt"), F.col("scref"), F.col("scalt"))[0].alias("hap1"), "dp")


@query()
def ab_fit(spark, sf_dir):
    """Allele-balance parameters of each chromosome over up to 250 tiles of 100 sites, by a search that narrows more often and draws less than the default.

    Seven steps of 1,200 draws shrink the bounds as far as four of 20,000, at a tenth of the evaluations.
    """
    return allele_balance.fit(_training(spark, sf_dir), steps=7, samples=1200)


def _fits(spark):
    return spark.createDataFrame([(f"chr{k}", -1.0, 1000.0, -1.0, 20000.0) for k in range(1, 23)], "chr string, a double, b double, c double, d double")


def cell_sites(spark, sf_dir):
    """The site view as one cell's table: counts and panel alone, without the views' scores and rates."""
    s = _scored(spark, sf_dir).drop("abc_pv", "id_score", "hs_score", "lysis_pv", "lysis_beta", "mda_pv", "mda_beta", "nt", "na")
    one, two = exprs.haplotypes(F.col("phased_gt"), F.col("scref"), F.col("scalt"))
    return s.withColumns({"hap1": one, "hap2": two, "somatic_candidate": filters.candidate()})


@query()
def cell_burden(spark, sf_dir):
    """One cell from counts to burden in a row: allele balance, models, read-operation scores, filters, priors, rates, calls and strata."""
    results = pipeline.run_cell(stored.written(cell_sites(spark, sf_dir), "cell"), _fits(spark), view(spark, sf_dir, "depth"), Config("bulk", ("cell",)), 5.845001134)
    return results["burden"].select("muttype", "stratum", "reason", "ncalls", r6("sens"), "callable_bp", F.round("burden", 4).alias("burden"))


@query()
def gp_predict(spark, sf_dir):
    """Mean and deviation of the allele balance at all sites, with fixed parameters; a training site's own reads are left out."""
    s = _scored(spark, sf_dir)
    return allele_balance.estimates(s, _training(spark, sf_dir), _fits(spark))


@query()
def population_burden(spark, sf_dir):
    """Counts that fit under the candidates' histogram, and the tables made of them."""
    keys = ["muttype", "dp_idx", "bin"]
    s = _scored(spark, sf_dir).withColumn("dp_idx", exprs.depth_index(F.col("dp"), 40)).withColumn("bin", exprs.vaf_bin(F.col("af"), F.col("dp")))
    got = s.groupBy(*keys).agg(F.count_if("training_site").alias("g"), F.count_if(~F.col("training_site") & (F.col("balt") == 0)).alias("s"))
    return priors.priors(got)


@query()
def sensitivity_glm(spark, sf_dir):
    """Predicted sensitivity of tiles by a binomial model."""
    b = view(spark, sf_dir, "bins").select("chr", "start", "end_", F.col("gc").alias("x1"), F.col("cnt").cast("double").alias("x2"), (F.col("cnt") % 7).cast("int").alias("hits"), (F.col("cnt") % 7 + F.floor(F.col("start") / 3600) % 4 + 1).cast("int").alias("total"))
    return regression.sensitivity_model(b, ["x1", "x2"])[0]


@query()
def gc_correct(spark, sf_dir):
    """Coverage ratios without their trend over GC."""
    return regression.gc_correct(view(spark, sf_dir, "bins")).select("chr", "start", "end_", r6("ratio"), r6("ratio_gcnorm"))


@query()
def cbs_segments(spark, sf_dir):
    """Segments of corrected ratios."""
    corrected = regression.gc_correct(view(spark, sf_dir, "bins")).withColumn("lr", F.log2("ratio_gcnorm"))
    return segments.segment(corrected.where("lr is not null"), "lr")


SETS = 1000  # as the reference's desired.perms


CHUNK = 1 << 13


def _sequence(spark, sf_dir):
    """A sequence (chr, chunk_id, seq) as far as the callable intervals reach: 32 bases from a hash of each place, in chunks that overlap by 64."""
    reach = view(spark, sf_dir, "interval").groupBy("chr").agg(F.max("end_").alias("end_"))
    chunks = reach.select("chr", F.explode(F.sequence(F.lit(0), F.floor(F.col("end_") / CHUNK).cast("int"))).alias("chunk_id"))
    chunks = chunks.repartition(4 * spark.sparkContext.defaultParallelism, "chr", "chunk_id")  # small rows, much work: by a number, so that they aren't put together
    bases = lambda k: F.translate(F.md5(F.concat_ws(":", "chr", (F.col("chunk_id") * (CHUNK // 32) + k).cast("string")).cast("binary")), "0123456789abcdef", "ACGT" * 4)
    return chunks.select("chr", "chunk_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(CHUNK // 32 + 1)), bases), "").alias("seq"))


def _real_calls(spark, sf_dir, sequence):
    """Deep substitutions inside callable intervals, with the channel of their base between its neighbours in the sequence."""
    calls = intervals.within(_scored(spark, sf_dir).where("muttype = 'snv' and scalt >= 30 and pos > 1").select(*SITE_KEY), view(spark, sf_dir, "interval"))
    own = calls.withColumn("chunk_id", F.floor((F.col("pos") - 2) / CHUNK).cast("int")).join(sequence, ["chr", "chunk_id"])
    base = lambda k: F.substring("seq", (F.col("pos") - F.col("chunk_id") * CHUNK + k).cast("int"), F.lit(1))
    return own.select(*SITE_KEY, exprs.substitution_channel(F.concat(base(-1), F.col("refnt"), base(1)), F.col("altnt")).alias("channel"))


@query()
def permuted_sites(spark, sf_dir):
    """Sets of random substitutions inside callable intervals, made from the bases of a sequence, with the spectrum of the real ones."""
    sequence = stored.written(_sequence(spark, sf_dir), "sequence")
    calls = stored.written(_real_calls(spark, sf_dir, sequence), "calls")
    return sampling.substitution_sets(view(spark, sf_dir, "interval"), sequence, calls, SETS, seed=8, chunk=CHUNK)


@query()
def placed_sites(spark, sf_dir):
    """Sets of random positions inside callable intervals, each given a channel by the real spectrum alone."""
    spectrum = _scored(spark, sf_dir).where("muttype = 'snv' and scalt >= 30").groupBy("channel").agg(F.count("*").alias("n"))
    return sampling.placed_sets(view(spark, sf_dir, "interval"), [tuple(r) for r in spectrum.collect()], SETS, 8)  # a row for each channel


@query()
def resampled_training(spark, sf_dir):
    """Training sites resampled to the distances of other sites."""
    s = stored.written(_scored(spark, sf_dir).select(*SITE_KEY, "training_site", "scalt"), "sites")
    return sampling.resample(s.where("training_site").select(*SITE_KEY), s.where("scalt >= 20 and not training_site").select(*SITE_KEY))


@query()
def spectrum_homogeneity(spark, sf_dir):
    """Monte-Carlo test of each type's spectrum against the whole."""
    s = _scored(spark, sf_dir).where("muttype = 'snv'")
    expected = {r["channel"]: float(r["n"]) for r in s.groupBy("channel").agg(F.count("*").alias("n")).collect()}  # a row for each channel
    sample = s.where("scalt >= 25").withColumn("sample", F.concat(F.lit("s"), (F.col("pos") % 4).cast("string")))
    return sampling.by_sample(sample.groupBy("sample", "channel").agg(F.count("*").alias("n")), expected)


@query(f"WITH {duck('interval')}, {_MERGED} SELECT chr, (start + i * (end_ - start + 1) // n)::INT AS start, (start + (i + 1) * (end_ - start + 1) // n - 1)::INT AS end_ FROM (SELECT chr, start::BIGINT AS start, end_, ceil((end_ - start + 1) / 1000.0)::BIGINT AS n, unnest(range(0, ceil((end_ - start + 1) / 1000.0)::BIGINT)) AS i FROM merged) x")
def spread_intervals(spark, sf_dir):
    """Callable intervals after merging, extension and tiling."""
    return intervals.equal_tiles(intervals.merge(view(spark, sf_dir, "interval")), 1000)
