"""The decision layer: candidate sites, static filters, calls, reasons and rescue."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs

#: Insertion and deletion channels that amplification makes by itself.
AMPLIFICATION_INDELS = ("1:Ins:C:3", "1:Ins:C:4", "1:Ins:C:5", "1:Ins:T:3", "1:Ins:T:4", "1:Ins:T:5", "2:Ins:R:2", "2:Ins:R:3", "2:Ins:R:4", "2:Ins:R:5")


@dataclass(frozen=True)
class Params:
    """Thresholds of one mutation type."""

    min_sc_alt: int = 2
    min_sc_dp: int = 6
    max_bulk_alt: int = 0
    max_bulk_af: float = 1.0
    max_bulk_binom_prob: float = 1.0
    min_bulk_dp: int = 11
    exclude_dbsnp: bool = True
    cigar_id_quantile: float = 0.05
    cigar_hs_quantile: float = 0.05
    use_panel: bool = False
    panel_allow_missing: bool = True
    panel_max_donors: int = 1
    panel_max_out: int = 2

    def __post_init__(self) -> None:
        if self.min_sc_alt < 0 or self.min_sc_dp < 0 or self.min_bulk_dp < 0:
            raise ValueError("depths and reads can't be below 0")


DEFAULTS = {"snv": Params(), "indel": Params(use_panel=True)}


def by_type(params: dict[str, Params], value) -> Column:
    """A threshold of the row's own type; NULL for other types."""
    values = {muttype: value(p) for muttype, p in params.items()}
    if len(set(values.values())) == 1:  # the most: one branch, as long code is not compiled
        return F.when(F.col("muttype").isin(*values), F.lit(next(iter(values.values()))))
    out = F.lit(None)
    for muttype, v in values.items():
        out = F.when(F.col("muttype") == muttype, F.lit(v)).otherwise(out)
    return out


def training_site(phased: Column, bulk_gt: Column, haploid: Column) -> Column:
    """Phased heterozygous sites, on haploid chromosomes homozygous ones, with a bulk genotype."""
    return F.coalesce(F.when(haploid, phased == "1|1").otherwise(phased.isin("0|1", "1|0")) & (bulk_gt != "./."), F.lit(False))


def candidate(params: dict[str, Params] = DEFAULTS) -> Column:
    """Whether a row can be somatic, from muttype, bulk_dp, balt, bulk_af, bulk_binom_prob, balt_lowmq, bulk_gt, talt, dbsnp, training_site, phased_gt."""
    p = lambda value: by_type(params, value)
    no = F.lit(False)
    relaxed = p(lambda x: x.max_bulk_alt > 0 or 0 < x.max_bulk_af < 1 or 0 < x.max_bulk_binom_prob < 1)
    return F.coalesce(
        (F.col("bulk_dp") >= p(lambda x: x.min_bulk_dp)) & (F.col("balt") <= p(lambda x: x.max_bulk_alt))
        & F.coalesce(F.col("bulk_af") <= p(lambda x: x.max_bulk_af), no) & F.coalesce(F.col("bulk_binom_prob") <= p(lambda x: x.max_bulk_binom_prob), no)
        & F.coalesce(F.col("balt_lowmq") <= p(lambda x: x.max_bulk_alt), F.lit(True)) & (relaxed | (F.col("bulk_gt") == "0/0"))
        & (F.col("talt") >= 2) & (F.col("dbsnp") == ".") & ~F.col("training_site") & (F.coalesce("phased_gt", F.lit("./.")) == "./."), no)


def static_tests(df: DataFrame, params: dict[str, Params] = DEFAULTS, quantiles: dict[str, tuple[float, float]] | None = None, amplified: bool = True) -> DataFrame:
    """Adds the twelve tests and static_filter, all of them; NULL where a test has nothing to judge by.

    ``quantiles`` are the least scores of each type; without them the two score tests hold.
    """
    p = lambda value: by_type(params, value)
    yes = F.lit(True)
    id_cut, hs_cut = F.lit(None).cast("double"), F.lit(None).cast("double")
    for muttype, (low_id, low_hs) in (quantiles or {}).items():
        id_cut = F.when(F.col("muttype") == muttype, F.lit(low_id)).otherwise(id_cut)
        hs_cut = F.when(F.col("muttype") == muttype, F.lit(low_hs)).otherwise(hs_cut)
    donors = F.col("unique_donors")
    panel = ~p(lambda x: x.use_panel) | (donors.isNull() & p(lambda x: x.panel_allow_missing)) | (donors <= p(lambda x: x.panel_max_donors)) | (F.col("max_out") <= p(lambda x: x.panel_max_out))
    tests = {
        "id_test": F.col("id_score") >= id_cut if quantiles else yes,
        "hs_test": F.col("hs_score") >= hs_cut if quantiles else yes,
        "lowmq_test": F.coalesce(F.col("balt_lowmq") <= p(lambda x: x.max_bulk_alt), yes),
        "dp_test": (F.col("dp") >= p(lambda x: x.min_sc_dp)) & (F.col("bulk_dp") >= p(lambda x: x.min_bulk_dp)),
        "abc_test": F.col("abc_pv") > 0.05,
        "sc_alt_test": F.col("scalt") >= p(lambda x: x.min_sc_alt),
        "bulk_alt_test": F.col("balt") <= p(lambda x: x.max_bulk_alt),
        "bulk_af_test": p(lambda x: x.max_bulk_af).isNull() | (F.col("bulk_af") <= p(lambda x: x.max_bulk_af)),
        "bulk_binom_test": p(lambda x: x.max_bulk_binom_prob).isNull() | (F.col("bulk_binom_prob") <= p(lambda x: x.max_bulk_binom_prob)),
        "dbsnp_test": ~p(lambda x: x.exclude_dbsnp) | (F.col("dbsnp") == "."),
        "panel_test": panel,
        "artifact_test": ~F.coalesce(F.col("mutsig").isin(*AMPLIFICATION_INDELS), F.lit(False)) if amplified else yes,
    }
    every = yes
    for test in tests.values():
        every = every & test
    return df.withColumns(tests).withColumn("static_filter", every)


TESTS = ("id_test", "hs_test", "lowmq_test", "dp_test", "abc_test", "sc_alt_test", "bulk_alt_test", "bulk_af_test", "bulk_binom_test", "dbsnp_test", "panel_test", "artifact_test")
#: The labels of failed tests, in the order in which they are listed.
LABELS = {"abc_test": "abc", "id_test": "cigar.id", "hs_test": "cigar.hs", "lowmq_test": "bulk.lowmq", "dp_test": "min.dp", "sc_alt_test": "min.sc.alt", "bulk_alt_test": "max.bulk.alt", "bulk_af_test": "max.bulk.af", "bulk_binom_test": "max.bulk.binom.prob", "panel_test": "cross.sample.filter", "dbsnp_test": "dbsnp"}


def supported(panel: DataFrame) -> Column:
    """Whether the panel (unique_donors, unique_cells) lets a row's type be called: indels need more than two cells in all of it, and with one donor a site of one cell."""
    limits = panel.agg(F.struct(F.coalesce(F.max("unique_donors") == 1, F.lit(False)).alias("one_donor"), F.coalesce(F.max("unique_cells") <= 2, F.lit(True)).alias("few_cells")).alias("x")).scalar()
    return (F.col("muttype") == "snv") | (~limits["few_cells"] & (~limits["one_donor"] | (F.col("unique_cells") == 1)))


def call(df: DataFrame, target_fdr: float | Column = 0.01, panel: DataFrame | None = None) -> DataFrame:
    """Adds pass and training_pass.

    Indels need support in the panel: with two cells at most (bulks count) in the
    whole ``panel`` (unique_donors, unique_cells; the table itself by default) none is
    called, and with one donor only those of one cell.  The two maxima are one row.
    """
    target = target_fdr if isinstance(target_fdr, Column) else F.lit(target_fdr)
    low = (F.col("lysis_fdr") <= target) & (F.col("mda_fdr") <= target)
    called = F.col("somatic_candidate") & F.col("static_filter") & supported(df if panel is None else panel) & low
    trained = F.col("training_site") & F.col("sc_alt_test") & F.col("dp_test") & F.col("id_test") & F.col("hs_test") & F.col("abc_test") & low
    return df.withColumn("pass", F.coalesce(called, F.lit(False))).withColumn("training_pass", F.when(F.col("training_site"), F.coalesce(trained, F.lit(False))))


def fdr(pv: Column, beta: Column, nt: Column, na: Column) -> Column:
    """pv na / (pv na + beta nt)."""
    return exprs.div(pv * na, pv * na + beta * nt)


def reasons(target_fdr: float = 0.01, rescue: bool = False) -> Column:
    """PASS, the tests that a called row fails, and RESCUE, joined by ;.

    A NULL test has no label, but a NULL rate counts as too high.
    """
    high = lambda rate: ~F.coalesce(F.col(rate) <= target_fdr, F.lit(False))
    parts = [F.when(F.col("pass"), "PASS"), F.when(high("lysis_fdr"), "pre.amplification.artifact"), F.when(high("mda_fdr"), "amplification.artifact")]
    parts += [F.when(~F.col(test), label) for test, label in LABELS.items()]
    return F.concat_ws(";", *parts, *([F.when(F.col("rescue"), "RESCUE")] if rescue else []))


def first_reason(target_fdr: float = 0.01, rescue: bool = False) -> Column:
    """One label: PASS, RESCUE, cross.sample.filter, hard.filters (any other static test), pre.amplification.artifact, or amplification.artifact.

    NULL tests and a NULL first rate count as failed.  What is left is told from
    unknown by its second rate alone: amplification.artifact whatever that is, NULL without one.
    """
    no = F.lit(False)
    out = F.when(F.coalesce("pass", no), "PASS")
    if rescue:
        out = out.when(F.coalesce("rescue", no), "RESCUE")
    out = out.when(~F.coalesce("panel_test", no), "cross.sample.filter").when(~F.coalesce("static_filter", no), "hard.filters")
    return out.when(~F.coalesce(F.col("lysis_fdr") <= target_fdr, no), "pre.amplification.artifact").when(F.col("mda_fdr").isNotNull(), "amplification.artifact")


def reduced(df: DataFrame, most: float = 0.5) -> DataFrame:
    """Rows worth a second look: static filters hold and neither rate is over ``most``."""
    return df.where(F.col("static_filter") & (F.col("lysis_fdr") <= most) & (F.col("mda_fdr") <= most))


def rescue_weights(fractions: DataFrame, by: Sequence[str] = (), eps: float = 0.001) -> DataFrame:
    """(by, channel, weight) from (by, channel, share, true_sig, artifact_sig) of all channels: non-negative least squares of two columns in each group.

    The closed form needs five sums: the free optimum, or the better edge if a
    weight would be negative.  Both weights are raised by ``eps``, so that neither
    signature is ruled out.
    """
    by = list(by)
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    s = fractions.groupBy(*by).agg(dot("true_sig", "true_sig").alias("tt"), dot("artifact_sig", "artifact_sig").alias("aa"), dot("true_sig", "artifact_sig").alias("ta"), dot("true_sig", "share").alias("ts"), dot("artifact_sig", "share").alias("as_"))
    det = F.col("tt") * F.col("aa") - F.col("ta") * F.col("ta")
    w1, w2 = exprs.div(F.col("ts") * F.col("aa") - F.col("as_") * F.col("ta"), det), exprs.div(F.col("as_") * F.col("tt") - F.col("ts") * F.col("ta"), det)
    only_t, only_a = F.greatest(exprs.div(F.col("ts"), F.col("tt")), F.lit(0.0)), F.greatest(exprs.div(F.col("as_"), F.col("aa")), F.lit(0.0))
    t_better = only_t * F.col("ts") >= only_a * F.col("as_")
    inner = (w1 >= 0) & (w2 >= 0)
    w = s.select(*by, F.when(inner, w1).when(t_better, only_t).otherwise(0.0).alias("w1"), F.when(inner, w2).when(t_better, 0.0).otherwise(only_a).alias("w2"))
    one, two = F.col("w1"), F.col("w2")
    if by:
        fractions = fractions.join(w, by)
    else:
        one, two = w.select("w1").scalar(), w.select("w2").scalar()
    return fractions.select(*by, "channel", exprs.div(F.col("true_sig") * (one + eps), F.col("artifact_sig") * (two + eps)).alias("weight"))


def only_early(target_fdr: float) -> Column:
    """Rows whose only fault is the first rate."""
    return F.coalesce((reasons(target_fdr) == "pre.amplification.artifact") & ~F.col("pass"), F.lit(False))


def rescued(df: DataFrame, weights: DataFrame, target_fdr: float, rescue_fdr: float, by: Sequence[str] = ()) -> DataFrame:
    """Adds weight, rescue_fdr and rescue to rows whose only fault is the first rate, by the weight of their channel (in their group)."""
    joined = df.join(weights, [*by, "channel"], "left")
    rate = exprs.div(F.col("lysis_pv"), F.col("lysis_pv") + F.col("lysis_beta") * F.col("weight") * exprs.div(F.col("nt"), F.col("na")))
    only = only_early(target_fdr)
    return joined.withColumn("rescue_fdr", F.when(only, rate)).withColumn("rescue", F.coalesce(only & (rate <= rescue_fdr), F.lit(False)))


def potentially_shared(binom_limit: float = 1e-6, af_limit: float = 0.25, cells: int = 1) -> Column:
    """Candidates, and mosaic sites of low bulk probability and fraction, that more than one cell has; indels must pass the panel test."""
    mosaic = (F.col("bulk_binom_prob") <= binom_limit) & (F.col("bulk_af") < af_limit)
    return F.coalesce((F.col("somatic_candidate") | mosaic) & ((F.col("muttype") == "snv") | F.col("panel_test")) & (F.col("tcells") > cells), F.lit(False))


def passing(kind: str = "pass", muttypes: Sequence[str] = ("snv", "indel")) -> Column:
    """Rows called, rescued or either, of the given types."""
    chosen = {"pass": F.col("pass"), "rescue": F.col("rescue"), "any": F.col("pass") | F.col("rescue")}[kind]
    return chosen & F.col("muttype").isin(*muttypes)


def changed(params: dict[str, Params], **new) -> dict[str, Params]:
    """Parameters with some thresholds replaced, for all types."""
    return {k: replace(p, **new) for k, p in params.items()}


def sweep(df: DataFrame, values: Sequence, change: Callable[[DataFrame, object], DataFrame], name: str = "value") -> DataFrame:
    """The rows that ``change`` makes of the table for each of a few values, with the value, in ascending order without repeats."""
    out = None
    for value in sorted(set(values)):
        one = change(df, value).withColumn(name, F.lit(value))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no values to try")
    return out


def call_sweep(df: DataFrame, min_sc_dps: Sequence[int], max_bulk_alts: Sequence[int], targets: Sequence[float], params: dict[str, Params] = DEFAULTS, panel: DataFrame | None = None) -> DataFrame:
    """(muttype, min_sc_dp, max_bulk_alt, target_fdr, calls, training_passed) for all combinations of a few thresholds.

    The table (with tests and rates) is read once: a row is counted at the strictest
    combination that lets it pass, and a combination's numbers are sums over all at
    least as strict; what is added up is as small as the grid.  A combination without calls has 0.
    """
    deep, loose, low = sorted(set(min_sc_dps)), sorted(set(max_bulk_alts)), sorted(set(map(float, targets)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    every = F.lit(True)
    for test in TESTS:
        if test not in ("dp_test", "bulk_alt_test", "lowmq_test"):
            every = every & F.col(test)
    p = lambda value: by_type(params, value)
    strict = ~p(lambda x: 0 < x.max_bulk_af < 1 or 0 < x.max_bulk_binom_prob < 1) & ~yes(F.col("bulk_gt") == "0/0")  # such a bulk genotype is let pass with the first read allowed
    reads = F.greatest("balt", F.coalesce("balt_lowmq", F.lit(0)), F.when(strict, 1).otherwise(0))
    rate = F.when(F.col("lysis_fdr").isNotNull() & F.col("mda_fdr").isNotNull(), F.greatest("lysis_fdr", "mda_fdr"))
    shallow = F.col("bulk_dp") >= p(lambda x: x.min_bulk_dp)
    code = lambda c, steps, up: F.array_min(F.filter(F.lit(steps), lambda s: s >= c)) if up else F.array_max(F.filter(F.lit(steps), lambda s: s <= c))
    call_ = yes(candidate(changed(params, max_bulk_alt=1 << 30)) & every & supported(df if panel is None else panel) & shallow)
    trained = yes(F.col("training_site") & F.col("sc_alt_test") & F.col("id_test") & F.col("hs_test") & F.col("abc_test") & shallow)
    rows = df.select("muttype", call_.alias("_call"), trained.alias("_train"), code(F.col("dp"), deep, False).alias("_d"), code(reads, loose, True).alias("_a"), code(rate, low, True).alias("_t")).where("(_call or _train) and _d is not null and _t is not null")
    coded = rows.groupBy("muttype", "_d", "_a", "_t").agg(F.count_if("_call").alias("c"), F.count_if("_train").alias("t"))
    grid = df.sparkSession.createDataFrame([(m, d, a, t) for m in sorted(params) for d in deep for a in loose for t in low], "muttype string, min_sc_dp int, max_bulk_alt int, target_fdr double")
    fits = (F.col("_d") >= F.col("min_sc_dp")) & (F.col("_t") <= F.col("target_fdr"))
    joined = grid.join(coded, "muttype", "left")
    return joined.groupBy(*grid.columns).agg(F.coalesce(F.sum(F.when(fits & (F.col("_a") <= F.col("max_bulk_alt")), F.col("c"))), F.lit(0)).alias("calls"), F.coalesce(F.sum(F.when(fits, F.col("t"))), F.lit(0)).alias("training_passed"))


def by_type_and_allele(tiles: DataFrame, muttype: str, allele: str = "both") -> DataFrame:
    """(held_out, pred, npass, ntotal, ncalls) of tiles (.., pred_<type>_<allele>, <type>_npass_<allele>, ..); both alleles: the mean prediction and the sums."""
    if allele not in ("both", "maj", "min"):
        raise ValueError("allele is both, maj or min")
    parts = ("maj", "min") if allele == "both" else (allele,)
    mean = sum((F.col(f"pred_{muttype}_{a}") for a in parts), F.lit(0.0)) / len(parts)
    total = lambda c: sum((F.col(f"{muttype}_{c}_{a}") for a in parts), F.lit(0))
    return tiles.select("held_out", mean.alias("pred"), *[total(c).alias(c) for c in ("npass", "ntotal", "ncalls")])
