"""From raw counts to calls, burdens, summaries and sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import exprs
from .. import __version__
from ..models import allele_balance, gauss_hermite, priors, regression, segments, sensitivity, tails
from ..operators import aggs, filters, joins
from ..sources import stored
from . import accessors

KEY = ["chr", "pos", "refnt", "altnt"]


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fails early if a column is missing."""
    if lost := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def integrate(counts: DataFrame, config: Config, *, lowmq: DataFrame | None = None, phased: DataFrame | None = None, panel: DataFrame | None = None) -> DataFrame:
    """The site table: bulk and total counts of long sample counts, with low-quality bulk reads, phase and panel joined on, and candidates."""
    require(counts, [*KEY, "dbsnp", "sample", "gt", "ref_n", "alt_n"])
    bulk = F.col("sample") == config.bulk_sample
    own = lambda c: F.max(F.when(bulk, F.col(c)))
    cells = lambda c: F.coalesce(F.sum(F.when(~bulk, F.col(c))), F.lit(0))
    sites = counts.groupBy(*KEY).agg(
        F.min("dbsnp").alias("dbsnp"), own("gt").alias("bulk_gt"), own("ref_n").alias("bref"), own("alt_n").alias("balt"),
        cells("ref_n").alias("tref"), cells("alt_n").alias("talt"), F.count_if(~bulk & (F.col("alt_n") > 0)).alias("tcells"))
    dp = F.col("bref") + F.col("balt")
    sites = sites.withColumns({"bulk_dp": dp, "bulk_af": exprs.div(F.col("balt").cast("double"), dp), "bulk_binom_prob": exprs.binomial_half_cdf(F.col("balt"), dp), "muttype": exprs.muttype(F.col("refnt"), F.col("altnt"))})
    none = lambda kind: F.lit(None).cast(kind)
    sites = joins.update_join(sites, lowmq, KEY, ["balt_lowmq"], ["balt_lowmq"]) if lowmq is not None else sites.withColumn("balt_lowmq", none("int"))
    sites = joins.update_join(sites, phased, KEY, ["phased_gt"], ["phased_gt"]) if phased is not None else sites.withColumn("phased_gt", none("string"))
    if panel is not None:
        sites = joins.update_join(sites, panel, ["chr", "pos"], ["unique_donors", "unique_cells", "max_out"], ["max_out", "unique_donors", "unique_cells"])
    else:
        sites = sites.withColumns({c: F.lit(0) for c in ("unique_donors", "unique_cells", "max_out")})
    known = F.col("phased_gt").isNull() | F.col("phased_gt").isin("0|1", "1|0", "1|1", "./.")
    sites = sites.withColumn("phased_gt", F.when(known, F.col("phased_gt")).otherwise(F.raise_error(F.concat(F.lit("unknown genotype "), "phased_gt"))))
    haploid = F.col("chr").isin(*config.haploid()) if config.haploid() else F.lit(False)
    sites = sites.withColumn("training_site", filters.training_site(F.col("phased_gt"), F.col("bulk_gt"), haploid))
    return sites.withColumn("somatic_candidate", filters.candidate(config.params))


def for_cell(sites: DataFrame, counts: DataFrame, cell: str) -> DataFrame:
    """The site table with one cell's counts."""
    own = counts.where(F.col("sample") == cell).select(*KEY, F.col("ref_n").alias("scref"), F.col("alt_n").alias("scalt"))
    dp = F.col("scref") + F.col("scalt")
    joined = sites.join(own, KEY)
    one, two = exprs.haplotypes(F.col("phased_gt"), F.col("scref"), F.col("scalt"))
    return joined.withColumns({"dp": dp, "af": exprs.div(F.col("scalt").cast("double"), dp), "hap1": one, "hap2": two})


def analyse(cell: DataFrame, fits: DataFrame, config: Config, *, stages: Sequence[str] = ("ab", "models", "cigars", "filters", "fdr", "calls")) -> DataFrame:
    """Allele balance, models, read-operation scores, filters, rates and calls of one cell's sites; ``stages`` may stop earlier.

    Scores need the columns of ``tails.cigar_rates``; their null sites are the
    training sites, resampled ones where the table tells (resampled_training_site),
    and two cut-offs of each type come to the driver.  Priors (``priors.assign``) need
    all sites of a cell, so that a part of a genome can be taken up to "filters" only.
    What later stages read several times is written: balance, models and tested sites are worked out once.
    """
    out, cutoffs = cell, None
    if "ab" in stages:
        train = cell.where("training_site and muttype = 'snv'").select("chr", "pos", "hap1", "dp")
        out = out.join(stored.written(allele_balance.estimates(cell, train, fits), "balance"), ["chr", "pos"], "left").withColumn("ab", exprs.logistic(F.col("gp_mu")))
    if "models" in stages:
        # what the models read is few columns: sites are moved whole once, when they are given what these come to
        few, own = ["chr", "pos", "scalt", "dp", "af"], [c for c in out.columns if c not in cell.columns] if "ab" in stages else ["gp_mu", "gp_sd"]
        read = out.select(*few, *own).distinct()
        found = gauss_hermite.models(read.withColumn("mu", F.round(exprs.match_ab(F.col("af"), F.col("gp_mu")), 3)).withColumn("sd", F.round("gp_sd", 3)))
        if "ab" not in stages:
            few, own = [*few, *own], []
        found = stored.written(found.select(*[F.col(c).alias(f"_m_{c}") for c in few], *own, *gauss_hermite.COLUMNS), "models")
        same = F.lit(True)
        for c in few:
            same = same & F.col(c).eqNullSafe(F.col(f"_m_{c}"))
        out = cell.join(found, same, "left").drop(*[f"_m_{c}" for c in few])
    if "cigars" in stages and "cigar_dp" in cell.columns:
        null = tails.cigar_rates(cell.where("resampled_training_site" if "resampled_training_site" in cell.columns else "training_site"))
        null = stored.written(null.select("muttype", "id_x", "id_y", "hs_x", "hs_y"), "null-sites")
        cutoffs = tails.score_cutoffs(tails.excess_scores(null, null), {k: (v.cigar_id_quantile, v.cigar_hs_quantile) for k, v in config.params.items()})
        out = tails.excess_scores(tails.cigar_rates(out), null, asked=tails.cigar_rates(cell))
    if "filters" in stages:
        missing = {c: F.lit(None).cast(t) for c, t in (("id_score", "double"), ("hs_score", "double"), ("mutsig", "string")) if c not in out.columns}
        out = filters.static_tests(out.withColumns(missing), config.params, cutoffs)
    if "fdr" in stages:
        out = priors.assign(stored.written(out, "tested"), config.params)
        for kind in ("lysis", "mda"):
            out = out.withColumn(f"{kind}_fdr", filters.fdr(F.col(f"{kind}_pv"), F.col(f"{kind}_beta"), F.col("nt"), F.col("na")))
    return filters.call(out, config.target_fdr, panel=cell) if "calls" in stages else out


def burdens(called: DataFrame, depth: DataFrame, config: Config, gbp: float, copies: int = 2) -> DataFrame:
    """(muttype, stratum, ..) of ``aggs.mutation_burden`` for each type; depth: sc_dp, bulk_dp, n."""
    out = None
    for muttype, p in sorted(config.params.items()):
        one = aggs.mutation_burden(called.where(F.col("muttype") == muttype), depth, min_bulk_dp=p.min_bulk_dp, gbp=gbp, copies=copies)
        one = one.select(F.lit(muttype).alias("muttype"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def run_cell(cell: DataFrame, fits: DataFrame, depth: DataFrame, config: Config, gbp: float, *, bins: DataFrame | None = None, tiles: DataFrame | None = None, covariates: Sequence[str] = (), preset: str = "baslan") -> dict[str, DataFrame]:
    """All results of one cell by name: called sites (a written table, as the others read it), burden, depth, coverage and the
    summaries; with bins also corrected bins, mapd and segments, and with tiles their predicted sensitivity: by the named
    covariates, or without them by type and allele (``models.sensitivity``) from the tiles' balance and depth and the called sites."""
    called = stored.written(analyse(cell, fits, config), "called")
    table = aggs.depth_table(depth)
    out = {"called": called, "burden": burdens(called, table, config, gbp), **summaries(called, depth, config.params)}
    if bins is not None:
        corrected = regression.gc_correct(bins)
        out |= {"bins": corrected, "mapd": aggs.mapd(corrected, "ratio_gcnorm"), "segments": segments.segment(corrected.withColumn("lr", F.log2("ratio_gcnorm")).where("lr is not null"), "lr", preset)}
    if tiles is not None and not covariates:
        haploid = config.haploid()
        ready = stored.written(sensitivity.prepared(sensitivity.covariates(tiles, called), haploid), "tiles")
        out["sensitivity"], out["sensitivity_models"] = sensitivity.models(ready, haploid)
        out["sensitivity_strata"] = sensitivity.assessed(out["sensitivity"])
    elif tiles is not None:
        out["sensitivity"] = regression.sensitivity_model(tiles, covariates)[0]
    return out


def summaries(called: DataFrame, depth: DataFrame | None = None, params: dict[str, filters.Params] = filters.DEFAULTS) -> dict[str, DataFrame]:
    """The reduced tables of one analysis, by name."""
    out = {
        "calls": called.where(F.col("pass")),
        "counts": called.groupBy("muttype").agg(F.count("*").alias("sites"), F.count_if("somatic_candidate").alias("candidates"), F.count_if("training_site").alias("training"), F.count_if("pass").alias("calls")),
        "static_filters": called.groupBy("muttype", "static_filter").agg(F.count("*").alias("n")),
        "phase": called.groupBy("phased_gt").agg(F.count("*").alias("n")),
        "vaf": aggs.rounded_histogram(called.where("training_site"), "af"),
        "tests": called.agg(*[F.struct(F.count_if(F.col(t)).alias("yes"), F.count_if(~F.col(t)).alias("no"), F.count_if(F.col(t).isNull()).alias("unknown")).alias(t) for t in filters.TESTS]),
        "ab": aggs.rounded_histogram(called.where("training_site"), "ab") if "ab" in called.columns else called.select(F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("n")).limit(0),
        "changes": aggs.transitions(called.where(F.col("pass") & (F.col("muttype") == "snv"))),
        "models": _model_histograms(called),
        "cigars": called.where("training_site").groupBy("muttype", F.bround("id_score", 3).alias("id_score"), F.bround("hs_score", 3).alias("hs_score")).agg(F.count("*").alias("n")) if {"id_score", "hs_score"} <= set(called.columns) else called.select("muttype", F.lit(None).cast("double").alias("id_score"), F.lit(None).cast("double").alias("hs_score"), F.lit(0).cast("long").alias("n")).limit(0),
        "priors": called.where("nt is not null").groupBy("muttype", F.round("nt", 6).alias("nt"), F.round("na", 6).alias("na")).agg(F.count("*").alias("sites"), F.count_if("training_site").alias("training")),
        "sweep": filters.call_sweep(called, *sweep_grid(called, params), params),
        "reasons": called.groupBy(filters.first_reason().alias("reason")).agg(F.count("*").alias("n")),
    }
    if depth is not None:
        out["depth"] = aggs.depth_table(depth)
        out["coverage"] = aggs.mean_coverage(out["depth"])
        out["analyzable"] = aggs.analyzable(out["depth"], {k: (v.min_sc_dp, v.min_bulk_dp) for k, v in filters.DEFAULTS.items()})
    return out


def sweep_grid(called: DataFrame, params: dict[str, filters.Params]) -> tuple[list[int], list[int], list[float]]:
    """Thresholds that a summary tries: up to five depths between the types' own and the upper quartile of the training sites' depth, 0 to 3 bulk reads, twenty rates."""
    own = [p.min_sc_dp for p in params.values()]
    top = called.where("training_site").agg(F.percentile("dp", 0.75)).first()[0]
    low, high = min(own), max(min(own), int(top) if top is not None else 0)
    return sorted({max(own), *(int(low + (high - low) * k / 3) for k in range(4))}), [0, 1, 2, 3], [10 ** (-5 + 5 * k / 19) for k in range(20)]


def _model_histograms(called: DataFrame) -> DataFrame:
    """(muttype, test, value, n): rounded p-values of the three read-count models at training sites."""
    each = F.array(*[F.struct(F.lit(c).alias("test"), F.bround(c, 3).alias("value")) for c in ("abc_pv", "lysis_pv", "mda_pv")])
    return called.where("training_site").select("muttype", F.inline(each)).where("value is not null").groupBy("muttype", "test", "value").agg(F.count("*").alias("n"))


def all_calls(cells: dict[str, DataFrame], kind: str = "pass", muttypes: Sequence[str] = ("snv", "indel"), combine: bool = False) -> DataFrame:
    """The passing rows (``filters.passing``) of several cells' tables, with their sample; ``combine`` puts neighbouring substitutions together."""
    out = None
    for sample, df in sorted(cells.items()):
        own = df.where(filters.passing(kind, muttypes)).withColumn("sample", F.lit(sample))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no cells")
    return accessors.combined_neighbours(out) if combine else out


def write_summaries(tables: dict[str, DataFrame], folder: str, sample: str) -> None:
    """A Parquet table for each summary, by sample, with the version that made it."""
    for name, df in tables.items():
        df.withColumn("sample", F.lit(sample)).withColumn("version", F.lit(__version__)).write.mode("append").partitionBy("sample").parquet(f"{folder}/{name}")


def report(called: DataFrame) -> str:
    """A few lines of text from small aggregates."""
    rows = summaries(called)["counts"].orderBy("muttype").collect()  # a row for each type
    return "\n".join(f"{r['muttype']}: {r['sites']} sites, {r['candidates']} candidates, {r['training']} training sites, {r['calls']} calls" for r in rows)
