"""The registered queries over the supplied tables, each with the same computation in SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import aggs, filters, intervals, joins, windows
from ..sources import stored
from .adapters import duck, duck_scored, panel, scored, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SITE_KEY = ["chr", "pos", "refnt", "altnt"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: str | Column, name: str | None = None) -> Column:
    """Doubles are compared to six digits."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


# ---- projections and filters

PARAMS = filters.DEFAULTS


@query(f"""WITH {duck('sample_counts')}, s AS (
  SELECT chr, pos, coalesce(sum(ref_n) FILTER (sample = 'NO'), 0) AS bref, coalesce(sum(alt_n) FILTER (sample = 'NO'), 0) AS balt, coalesce(sum(ref_n) FILTER (sample <> 'NO'), 0) AS tref,
         coalesce(sum(alt_n) FILTER (sample <> 'NO'), 0) AS talt, count(*) FILTER (sample <> 'NO' AND alt_n > 0) AS tcells FROM sample_counts_v GROUP BY chr, pos)
SELECT chr, pos, bref::BIGINT AS bref, balt::BIGINT AS balt, (bref + balt)::BIGINT AS bulk_dp, round(balt / nullif((bref + balt)::DOUBLE, 0), 6) AS bulk_af,
  round(list_sum(list_transform(range(0, balt::BIGINT + 1), lambda i: exp(lgamma((bref + balt + 1)::DOUBLE) - (CASE WHEN i = 0 THEN 0 ELSE lgamma((i + 1)::DOUBLE) END) - (CASE WHEN bref + balt - i = 0 THEN 0 ELSE lgamma((bref + balt - i + 1)::DOUBLE) END) - (bref + balt) * ln(2)))), 6) AS bulk_binom_prob,
  tref::BIGINT AS tref, talt::BIGINT AS talt, tcells FROM s""")
def site_counts(spark, sf_dir):
    """Bulk counts with the binomial tail, and sums over the cells, from the long table of counts."""
    bulk = F.col("sample") == "NO"
    total = lambda c, who: F.coalesce(F.sum(F.when(who, F.col(c))), F.lit(0))
    s = view(spark, sf_dir, "sample_counts").groupBy("chr", "pos").agg(
        total("ref_n", bulk).alias("bref"), total("alt_n", bulk).alias("balt"), total("ref_n", ~bulk).alias("tref"), total("alt_n", ~bulk).alias("talt"), F.count_if(~bulk & (F.col("alt_n") > 0)).alias("tcells"))
    dp = F.col("bref") + F.col("balt")
    return s.select("chr", "pos", "bref", "balt", dp.alias("bulk_dp"), r6(exprs.div(F.col("balt").cast("double"), dp), "bulk_af"), r6(exprs.binomial_half_cdf(F.col("balt"), dp), "bulk_binom_prob"), "tref", "talt", "tcells")


@query(f"""WITH {duck('site')} SELECT chr, pos, refnt, altnt, CASE WHEN length(refnt) = 1 AND length(altnt) = 1 THEN 'snv' ELSE 'indel' END AS muttype, round(scalt / nullif(dp::DOUBLE, 0), 6) AS af,
  CASE WHEN phased_gt IS NOT NULL THEN CASE WHEN phased_gt = '0|1' THEN dp - scalt ELSE scalt END END AS hap1, CASE WHEN phased_gt IS NOT NULL THEN CASE WHEN phased_gt = '0|1' THEN scalt ELSE dp - scalt END END AS hap2,
  round(1 / (1 + exp(-((dp - 25) / 10.0::DOUBLE))), 6) AS ab, round(CASE WHEN scalt / nullif(dp::DOUBLE, 0) < 0.5 THEN -abs((dp - 25) / 10.0::DOUBLE) ELSE abs((dp - 25) / 10.0::DOUBLE) END, 6) AS mu FROM site_v""")
def site_derive(spark, sf_dir):
    """Mutation type, allele fraction, haplotype counts and allele balance of each site."""
    s = view(spark, sf_dir, "site")
    af, mu = exprs.div(F.col("scalt").cast("double"), F.col("dp")), (F.col("dp") - 25) / F.lit(10.0)
    one, two = exprs.haplotypes(F.col("phased_gt"), F.col("dp") - F.col("scalt"), F.col("scalt"))
    return s.select(*SITE_KEY, exprs.muttype(F.col("refnt"), F.col("altnt")).alias("muttype"), r6(af, "af"), one.alias("hap1"), two.alias("hap2"), r6(exprs.logistic(mu), "ab"), r6(exprs.match_ab(af, mu), "mu"))


_CANDIDATE = """coalesce(bulk_dp >= 11 AND balt <= 0 AND coalesce(bulk_af <= 1, false) AND coalesce(bulk_binom_prob <= 1, false) AND coalesce(balt_lowmq <= 0, true)
  AND bulk_gt = '0/0' AND talt >= 2 AND dbsnp = '.' AND NOT training_site AND coalesce(phased_gt, './.') = './.', false)"""


@query(f"WITH {duck_scored()} SELECT chr, pos, refnt, altnt, muttype, training_site, {_CANDIDATE} AS somatic_candidate FROM scored")
def candidate_filter(spark, sf_dir):
    """Training sites and candidates by the thresholds of each type."""
    s = scored(spark, sf_dir).withColumn("training_site", filters.training_site(F.col("phased_gt"), F.lit("0/1"), F.lit(False)))
    return s.select(*SITE_KEY, "muttype", "training_site", filters.candidate(PARAMS).alias("somatic_candidate"))


_TESTS_SQL = """id_score >= CASE muttype WHEN 'snv' THEN 0.05 ELSE 0.1 END AS id_test, hs_score >= CASE muttype WHEN 'snv' THEN 0.05 ELSE 0.1 END AS hs_test,
  coalesce(balt_lowmq <= 0, true) AS lowmq_test, dp >= 6 AND bulk_dp >= 11 AS dp_test, abc_pv > 0.05 AS abc_test, scalt >= 2 AS sc_alt_test, balt <= 0 AS bulk_alt_test, bulk_af <= 1 AS bulk_af_test,
  bulk_binom_prob <= 1 AS bulk_binom_test, dbsnp = '.' AS dbsnp_test, muttype = 'snv' OR unique_donors IS NULL OR unique_donors <= 1 OR max_out <= 2 AS panel_test,
  coalesce(mutsig NOT IN ('1:Ins:C:3', '1:Ins:C:4', '1:Ins:C:5', '1:Ins:T:3', '1:Ins:T:4', '1:Ins:T:5', '2:Ins:R:2', '2:Ins:R:3', '2:Ins:R:4', '2:Ins:R:5'), true) AS artifact_test"""
_ALL_TESTS = " AND ".join(filters.TESTS)
_FDR_SQL = "lysis_pv * na / nullif(lysis_pv * na + lysis_beta * nt, 0) AS lysis_fdr, mda_pv * na / nullif(mda_pv * na + mda_beta * nt, 0) AS mda_fdr"
_CALLED = f"""{duck_scored()}, tested AS (SELECT *, {_TESTS_SQL}, {_FDR_SQL}, {_CANDIDATE} AS somatic_candidate FROM scored),
 filtered AS (SELECT *, {_ALL_TESTS} AS static_filter FROM tested),
 limits AS (SELECT coalesce(max(unique_donors) = 1, false) AS one_donor, coalesce(max(unique_cells) <= 2, true) AS few_cells FROM filtered),
 called AS (SELECT filtered.*, coalesce(somatic_candidate AND static_filter AND (muttype = 'snv' OR (NOT few_cells AND (NOT one_donor OR unique_cells = 1))) AND lysis_fdr <= 0.01 AND mda_fdr <= 0.01, false) AS pass,
   CASE WHEN training_site THEN coalesce(sc_alt_test AND dp_test AND id_test AND hs_test AND abc_test AND lysis_fdr <= 0.01 AND mda_fdr <= 0.01, false) END AS training_pass FROM filtered, limits)"""
QUANTILES = {"snv": (0.05, 0.05), "indel": (0.1, 0.1)}


#: What tests, candidates, rates and calls read of the scored sites, and what is told of them.
JUDGED = [
    *SITE_KEY, "muttype", "channel", "mutsig", "dp", "scalt", "scref", "af", "bulk_dp", "balt", "bref", "bulk_af", "bulk_binom_prob", "balt_lowmq", "bulk_gt", "talt", "tcells", "dbsnp", "phased_gt", "training_site", "unique_donors", "unique_cells",
    "max_out", "abc_pv", "id_score", "hs_score", "lysis_pv", "lysis_beta", "mda_pv", "mda_beta", "nt", "na"]


def tested(spark, sf_dir) -> DataFrame:
    """Scored sites with their tests and rates.

    The scored sites are written: judged as they are grouped, with the views' arithmetic in
    place of each column, they make methods that are too long for the JVM to compile.
    """
    s = stored.written(scored(spark, sf_dir).select(*JUDGED), "scored")
    s = filters.static_tests(s, PARAMS, QUANTILES).withColumn("somatic_candidate", filters.candidate(PARAMS))
    rate = lambda kind: filters.fdr(F.col(f"{kind}_pv"), F.col(f"{kind}_beta"), F.col("nt"), F.col("na"))
    return s.withColumn("lysis_fdr", rate("lysis")).withColumn("mda_fdr", rate("mda"))


def called_sites(spark, sf_dir) -> DataFrame:
    return filters.call(tested(spark, sf_dir), panel=panel(spark, sf_dir))


@query(f"WITH {_CALLED} SELECT chr, pos, refnt, altnt, {', '.join(filters.TESTS)}, static_filter FROM filtered")
def static_filters(spark, sf_dir):
    """The twelve static tests and their conjunction."""
    return tested(spark, sf_dir).select(*SITE_KEY, *filters.TESTS, "static_filter")


@query(f"WITH {_CALLED} SELECT chr, pos, refnt, altnt, muttype, round(lysis_fdr, 6) AS lysis_fdr, round(mda_fdr, 6) AS mda_fdr, pass, training_pass FROM called")
def call_pass(spark, sf_dir):
    """False-discovery rates, calls, and training sites that would be called."""
    return called_sites(spark, sf_dir).select(*SITE_KEY, "muttype", r6("lysis_fdr"), r6("mda_fdr"), "pass", "training_pass")


_REASONS = """CASE WHEN pass THEN 'PASS' END, CASE WHEN lysis_fdr IS NOT NULL AND lysis_fdr <= 0.01 THEN NULL ELSE 'pre.amplification.artifact' END, CASE WHEN mda_fdr IS NOT NULL AND mda_fdr <= 0.01 THEN NULL ELSE 'amplification.artifact' END,
  CASE WHEN NOT abc_test THEN 'abc' END, CASE WHEN NOT id_test THEN 'cigar.id' END, CASE WHEN NOT hs_test THEN 'cigar.hs' END, CASE WHEN NOT lowmq_test THEN 'bulk.lowmq' END, CASE WHEN NOT dp_test THEN 'min.dp' END,
  CASE WHEN NOT sc_alt_test THEN 'min.sc.alt' END, CASE WHEN NOT bulk_alt_test THEN 'max.bulk.alt' END, CASE WHEN NOT bulk_af_test THEN 'max.bulk.af' END, CASE WHEN NOT bulk_binom_test THEN 'max.bulk.binom.prob' END,
  CASE WHEN NOT panel_test THEN 'cross.sample.filter' END, CASE WHEN NOT dbsnp_test THEN 'dbsnp' END"""


@query(f"WITH {_CALLED} SELECT chr, pos, refnt, altnt, concat_ws(';', {_REASONS}) AS reasons FROM called")
def filter_reasons_full(spark, sf_dir):
    """PASS or all failed tests of each site as one string."""
    return called_sites(spark, sf_dir).select(*SITE_KEY, filters.reasons().alias("reasons"))


@query(f"""WITH {_CALLED} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN pass THEN 'PASS' WHEN panel_test IS NULL OR NOT panel_test THEN 'cross.sample.filter' WHEN static_filter IS NULL OR NOT static_filter THEN 'hard.filters'
  WHEN lysis_fdr IS NULL OR lysis_fdr > 0.01 THEN 'pre.amplification.artifact' WHEN mda_fdr IS NOT NULL THEN 'amplification.artifact' END AS reason FROM called) x GROUP BY reason""")
def filter_reasons_simple(spark, sf_dir):
    """Sites by their first reason."""
    return called_sites(spark, sf_dir).groupBy(filters.first_reason().alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_CALLED} SELECT muttype, static_filter, count(*) AS n FROM called GROUP BY muttype, static_filter")
def static_filter_summary(spark, sf_dir):
    """TRUE, FALSE and NULL static filters by type."""
    return tested(spark, sf_dir).groupBy("muttype", "static_filter").agg(F.count("*").alias("n"))


@query(f"WITH {_CALLED} SELECT chr, pos, refnt, altnt FROM called WHERE coalesce((somatic_candidate OR (bulk_binom_prob <= 0.1 AND bulk_af < 0.25)) AND (muttype = 'snv' OR panel_test) AND tcells > 1, false)")
def potentially_shared(spark, sf_dir):
    """Sites that several cells may share."""
    return tested(spark, sf_dir).where(filters.potentially_shared(0.1)).select(*SITE_KEY)


@query(f"WITH {_CALLED} SELECT chr, pos, refnt, altnt, muttype, phased_gt FROM called WHERE training_site AND muttype = 'snv'")
def training_sites(spark, sf_dir):
    """Training sites of one type."""
    return tested(spark, sf_dir).where(F.col("training_site") & F.col("muttype").isin("snv")).select(*SITE_KEY, "muttype", "phased_gt")


# ---- joins and set operations


@query(f"""WITH {duck('site', 'sample_counts')}, one AS (SELECT chr, pos, arg_max(alt_n, sample) AS alt_n FROM (SELECT chr, pos * 100 AS pos, sample, alt_n FROM sample_counts_v) x GROUP BY chr, pos)
SELECT s.chr, s.pos, refnt, altnt, alt_n FROM site_v s LEFT JOIN one ON s.chr = one.chr AND s.pos - s.pos % 100 = one.pos""")
def partial_key_join(spark, sf_dir):
    """All alleles of a position take the counts of one side row; side rows that repeat don't multiply sites."""
    side = view(spark, sf_dir, "sample_counts").select("chr", (F.col("pos") * 100).alias("at"), "sample", "alt_n")
    sites = view(spark, sf_dir, "site").withColumn("at", F.col("pos") - F.col("pos") % 100)
    return joins.update_join(sites, side, ["chr", "at"], ["alt_n"], ["sample"]).select(*SITE_KEY, "alt_n")


@query(f"WITH {duck('bins')} SELECT b.chr, b.start, b.end_, c.cnt, round(b.gc, 6) AS gc FROM bins_v b LEFT JOIN (SELECT chr, start, end_, cnt FROM bins_v WHERE cnt > 2) c ON b.chr = c.chr AND b.start = c.start AND b.end_ = c.end_")
def right_outer_bins(spark, sf_dir):
    """Counts of every GC bin, NULL where none."""
    b = view(spark, sf_dir, "bins")
    return b.select("chr", "start", "end_", r6("gc")).join(b.where("cnt > 2").select("chr", "start", "end_", "cnt"), ["chr", "start", "end_"], "left")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_phased(spark, sf_dir):
    """Rows that have a partner, once each."""
    keys = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.existing(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), keys, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_merged(spark, sf_dir):
    """Rows without a partner."""
    keys = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.missing(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), keys, ["o_orderkey"])


_CELLS = f"{duck('sample_counts')}, cell AS (SELECT chr, pos, sample, alt_n AS scalt, ref_n + alt_n AS dp, alt_n >= 10 AS pass FROM sample_counts_v)"


def _cells(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "sample_counts").select("chr", "pos", "sample", F.col("alt_n").alias("scalt"), (F.col("ref_n") + F.col("alt_n")).alias("dp"), (F.col("alt_n") >= 10).alias("pass"))


@query(f"WITH {_CELLS}, called AS (SELECT * FROM cell WHERE pass) SELECT c.chr, c.pos, c.sample, w.n_way, w.samples FROM called c JOIN (SELECT chr, pos, count(*) AS n_way, string_agg(sample, '&' ORDER BY sample) AS samples FROM called GROUP BY chr, pos HAVING count(*) > 1) w ON c.chr = w.chr AND c.pos = w.pos")
def shared_nway(spark, sf_dir):
    """Calls of several samples at one site."""
    return aggs.shared_ways(_cells(spark, sf_dir).where("pass"), ["chr", "pos"]).select("chr", "pos", "sample", "n_way", "samples")


@query(f"""WITH {_CELLS}, a AS (SELECT * FROM cell WHERE sample = 'RF'), b AS (SELECT * FROM cell WHERE sample = 'AF'),
 j AS (SELECT coalesce(a.chr, b.chr) AS chr, coalesce(a.pos, b.pos) AS pos, coalesce(a.scalt, 0) AS a1, coalesce(b.scalt, 0) AS a2, coalesce(a.pass, false) AS p1, coalesce(b.pass, false) AS p2, coalesce(a.dp, 0) AS d1, coalesce(b.dp, 0) AS d2 FROM a FULL JOIN b ON a.chr = b.chr AND a.pos = b.pos)
SELECT chr, pos, CASE WHEN (p1 OR p2) AND a1 >= 3 AND a2 >= 3 THEN 'shared' WHEN (p1 AND d2 > 0 AND a2 = 0) OR (p2 AND d1 > 0 AND a1 = 0) THEN 'private' WHEN p1 OR p2 THEN 'indeterminate' ELSE 'none' END AS kind FROM j""")
def shared_classifier(spark, sf_dir):
    """Two cells' sites: shared, private, indeterminate or none."""
    c = _cells(spark, sf_dir)
    return joins.classify_shared(c.where("sample = 'RF'"), c.where("sample = 'AF'"), ["chr", "pos"]).select("chr", "pos", "kind")


@query(f"WITH {_CELLS} SELECT a.chr, a.pos, concat(a.sample, '&', b.sample) AS samples FROM cell a JOIN cell b ON a.chr = b.chr AND a.pos = b.pos AND a.sample < b.sample WHERE a.scalt >= 3 AND b.scalt >= 3 AND (a.pass OR b.pass)")
def shared_all_pairs(spark, sf_dir):
    """Shared sites of all pairs of samples, by one join."""
    return joins.shared_pairs(_cells(spark, sf_dir), ["chr", "pos"])


@query("SELECT 'union' AS op, count(*) AS n FROM (SELECT l_orderkey FROM lineitem UNION SELECT o_orderkey FROM orders) a UNION ALL SELECT 'intersect', count(*) FROM (SELECT l_orderkey FROM lineitem INTERSECT SELECT o_orderkey FROM orders) b UNION ALL SELECT 'except', count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) c")
def set_ops(spark, sf_dir):
    """Union, intersection and difference of keys."""
    a, b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    count = lambda df, op: df.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
    return count(a.union(b).distinct(), "union").unionByName(count(a.intersect(b), "intersect")).unionByName(count(b.subtract(a), "except"))


# ---- false-discovery priors


@query(f"""WITH {duck_scored()}, h AS (SELECT muttype, least(dp, 41) + 1 AS dp_idx, CASE WHEN dp = 0 OR af IS NULL OR af = 0 THEN 1 ELSE ceil(af * 20)::INT END AS bin, count(*) AS n FROM scored WHERE training_site GROUP BY ALL),
 grid AS (SELECT muttype, dp_idx, unnest(range(1, 21))::INT AS bin FROM (SELECT DISTINCT muttype, dp_idx FROM h) g)
SELECT muttype, dp_idx, bin, round((bin - 0.5) / 20, 6) AS mid, coalesce(n, 0) AS n FROM grid LEFT JOIN h USING (muttype, dp_idx, bin)""")
def fdr_prior_hist(spark, sf_dir):
    """Allele-fraction histograms of training sites for each depth, all bins."""
    s = scored(spark, sf_dir).where("training_site").withColumn("dp_idx", exprs.depth_index(F.col("dp"), 40))
    return aggs.vaf_histogram(s, ["muttype", "dp_idx"]).select("muttype", "dp_idx", "bin", r6("mid"), "n")


@query(f"""WITH {duck_scored()}, b AS (SELECT *, least(dp, 41) + 1 AS dp_idx, CASE WHEN dp = 0 OR af IS NULL OR af = 0 THEN 1 ELSE ceil(af * 20)::INT END AS bin FROM scored),
 t AS (SELECT muttype, dp_idx, bin, count(*) FILTER (training_site) AS g, count(*) FILTER (NOT training_site) AS s FROM b GROUP BY ALL)
SELECT chr, pos, refnt, altnt, g, s, round(lysis_pv * greatest(s - g, 0.1) / nullif(lysis_pv * greatest(s - g, 0.1) + lysis_beta * greatest(g, 0.1), 0), 6) AS fdr FROM b JOIN t USING (muttype, dp_idx, bin)""")
def fdr_lookup(spark, sf_dir):
    """Rates by a table of depth and bin."""
    s = scored(spark, sf_dir).withColumn("dp_idx", exprs.depth_index(F.col("dp"), 40)).withColumn("bin", exprs.vaf_bin(F.col("af"), F.col("dp")))
    keys = ["muttype", "dp_idx", "bin"]
    prior = s.groupBy(*keys).agg(F.count_if("training_site").alias("g"), F.count_if(~F.col("training_site")).alias("s"))
    rate = filters.fdr(F.col("lysis_pv"), F.col("lysis_beta"), F.greatest(F.col("g"), F.lit(0.1)), F.greatest(F.col("s") - F.col("g"), F.lit(0.1)))
    return joins.lookup(s, prior, keys).select(*SITE_KEY, "g", "s", r6(rate, "fdr"))


# ---- positions and intervals

_CONTIGS = [(f"chr{k}", 7_000_000 - 100_000 * k) for k in range(1, 23)]
_CONTIG_SQL = "contig AS (SELECT 'chr' || k AS chr, 7000000 - 100000 * k AS length FROM range(1, 23) t(k))"


@query(f"""WITH {duck_scored()}, g AS (SELECT DISTINCT chr, pos AS at FROM scored WHERE training_site), q AS (SELECT * FROM scored WHERE NOT training_site),
 l AS (SELECT q.chr, q.pos, q.refnt, q.altnt, g.at AS l FROM q ASOF LEFT JOIN g ON q.chr = g.chr AND q.pos >= g.at),
 r AS (SELECT q.chr, q.pos, q.refnt, q.altnt, g.at AS r FROM q ASOF LEFT JOIN g ON q.chr = g.chr AND q.pos < g.at)
SELECT chr, pos, refnt, altnt, CASE WHEN r IS NULL THEN NULL WHEN l IS NULL THEN r WHEN pos - l <= r - pos THEN l ELSE r END AS nearest FROM l JOIN r USING (chr, pos, refnt, altnt)""")
def nearest_both(spark, sf_dir):
    """The nearest training position of each other site, ties to the left, NULL right of the last."""
    s = stored.written(scored(spark, sf_dir).select(*SITE_KEY, "training_site"), "sites")  # read three times
    return joins.nearest(s.where("not training_site").select(*SITE_KEY), s.where("training_site"))


_TILES = f"{_CONTIG_SQL}, tile AS (SELECT chr, s::INT AS start, least(s + 99999, length)::INT AS end_ FROM (SELECT chr, length, unnest(range(1, length + 1, 100000)) AS s FROM contig) x)"


@query(f"WITH {duck('site')}, far AS (SELECT chr, max(pos) AS length FROM site_v GROUP BY chr) SELECT chr, s::INT AS start, least(s + 9999, length)::INT AS end_ FROM (SELECT chr, length, unnest(range(1, length + 1, 10000)) AS s FROM far) x")
def fixed_tiles(spark, sf_dir):
    """Tiles of 10 kb over the chromosomes, as far as there are sites."""
    reach = view(spark, sf_dir, "site").groupBy("chr").agg(F.max("pos").alias("length"))
    return intervals.fixed_tiles(reach, 10_000)


@query(f"WITH {duck('interval')} SELECT chr, (start + i * (end_ - start + 1) // n)::INT AS start, (start + (i + 1) * (end_ - start + 1) // n - 1)::INT AS end_ FROM (SELECT chr, start::BIGINT AS start, end_, ceil((end_ - start + 1) / 100.0)::BIGINT AS n, unnest(range(0, ceil((end_ - start + 1) / 100.0)::BIGINT)) AS i FROM interval_v) x")
def equal_tiles(spark, sf_dir):
    """Intervals in nearly equal parts of at most 100."""
    return intervals.equal_tiles(view(spark, sf_dir, "interval"), 100)


_MERGED = """i AS (SELECT chr, start, end_, max(end_) OVER (PARTITION BY chr ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM interval_v),
 m AS (SELECT *, sum(CASE WHEN reach >= start - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY start, end_ ROWS UNBOUNDED PRECEDING) AS island FROM i),
 merged AS (SELECT chr, min(start) AS start, max(end_) AS end_ FROM m GROUP BY chr, island)"""


@query(f"WITH {duck('interval')}, {_MERGED} SELECT * FROM merged")
def interval_merge(spark, sf_dir):
    """The union of overlapping and adjacent intervals."""
    return intervals.merge(view(spark, sf_dir, "interval"))


@query(f"WITH {duck('interval')}, {_CONTIG_SQL} SELECT chr, greatest(start - 500, 1)::INT AS start, least(end_ + 500, length)::INT AS end_ FROM interval_v JOIN contig USING (chr)")
def extend_trim(spark, sf_dir):
    """Intervals widened by 500, cut at the chromosome's ends."""
    return intervals.extend(view(spark, sf_dir, "interval"), intervals.contigs(spark, _CONTIGS), 500)


@query("SELECT chr, min(pos) AS start, max(pos) AS end_ FROM (SELECT chr, pos, pos - row_number() OVER (PARTITION BY chr ORDER BY pos) AS g FROM (SELECT DISTINCT 'chr' || (l_suppkey % 3) AS chr, l_orderkey::INT AS pos FROM lineitem WHERE l_quantity >= 6 AND l_partkey % 40 >= 11) a) b GROUP BY chr, g")
def callable_runs(spark, sf_dir):
    """Runs of adjacent positions that pass both depths."""
    deep = table(spark, sf_dir, "lineitem").where("l_quantity >= 6 and l_partkey % 40 >= 11")
    return intervals.runs(deep.select(F.concat(F.lit("chr"), (F.col("l_suppkey") % 3).cast("string")).alias("chr"), F.col("l_orderkey").cast("int").alias("pos")))


@query(f"WITH {duck('site')}, {_TILES} SELECT t.chr, start, end_, count(pos) AS n, count(pos) FILTER (scalt * 2 >= dp) AS n_major FROM tile t LEFT JOIN site_v s ON t.chr = s.chr AND s.pos BETWEEN start AND end_ GROUP BY t.chr, start, end_")
def overlap_counts(spark, sf_dir):
    """Sites in each tile, all and those mostly of the variant."""
    tiles = intervals.fixed_tiles(intervals.contigs(spark, _CONTIGS), 100_000)
    return intervals.overlap_counts(tiles, view(spark, sf_dir, "site"), {"n": F.lit(True), "n_major": F.col("scalt") * 2 >= F.col("dp")})


@query(f"WITH {duck('interval')}, {_TILES} SELECT i.chr, i.start, i.end_ FROM interval_v i WHERE NOT EXISTS (SELECT 1 FROM tile t WHERE t.chr = i.chr AND i.start >= t.start AND i.end_ <= t.end_)")
def contained_in(spark, sf_dir):
    """Intervals that no tile contains."""
    tiles = intervals.fixed_tiles(intervals.contigs(spark, _CONTIGS), 100_000)
    return intervals.not_contained(view(spark, sf_dir, "interval"), tiles)


@query(f"WITH {duck('interval')}, {_CONTIG_SQL}, chunk AS (SELECT chr, s::INT AS chunk_start, least(s + 999999, length)::INT AS e FROM (SELECT chr, length, unnest(range(1, length + 1, 1000000)) AS s FROM contig) x) SELECT i.chr, i.start, i.end_, chunk_start FROM interval_v i LEFT JOIN chunk c ON c.chr = i.chr AND i.start BETWEEN chunk_start AND e")
def chunk_assignment(spark, sf_dir):
    """Each interval's chunk, by its start."""
    chunks = intervals.fixed_tiles(intervals.contigs(spark, _CONTIGS), 1_000_000)
    return intervals.chunk_of(view(spark, sf_dir, "interval"), chunks)


@query(f"WITH {duck_scored()}, a AS (SELECT DISTINCT chr, pos FROM scored WHERE scalt >= 20 AND NOT training_site) SELECT s.chr, s.pos, refnt, altnt FROM scored s WHERE training_site AND EXISTS (SELECT 1 FROM a WHERE a.chr = s.chr AND s.pos BETWEEN a.pos - 2500 AND a.pos + 2499)")
def flank_semi(spark, sf_dir):
    """Training sites near a site of interest."""
    s = scored(spark, sf_dir)
    return intervals.near(s.where("training_site").select(*SITE_KEY), s.where("scalt >= 20 and not training_site"), 2500)


@query(f"WITH {duck('site')}, {_TILES}, d AS (SELECT chr, ((pos - 1) // 100000 * 100000 + 1)::INT AS start, sum(dp) AS s, count(*) FILTER (dp >= 6) AS ge6, count(*) FILTER (dp >= 30) AS ge30 FROM site_v GROUP BY 1, 2) SELECT t.chr, t.start, end_, round(coalesce(s, 0) / (end_ - t.start + 1)::DOUBLE, 6) AS mean_dp, coalesce(ge6, 0) AS ge6, coalesce(ge30, 0) AS ge30 FROM tile t LEFT JOIN d ON t.chr = d.chr AND t.start = d.start")
def tile_depth(spark, sf_dir):
    """Mean depth and bases at cutoffs of each tile."""
    tiles = intervals.fixed_tiles(intervals.contigs(spark, _CONTIGS), 100_000)
    return intervals.tile_depth(view(spark, sf_dir, "site"), tiles, 100_000, "dp", {"ge6": 6, "ge30": 30}).withColumn("mean_dp", F.round("mean_dp", 6))


@query("SELECT split_part(region, ':', 1) AS chr, split_part(split_part(region, ':', 2), '-', 1)::INT AS start, split_part(region, '-', 2)::INT AS end_ FROM (SELECT 'chr' || (o_custkey % 22 + 1) || ':' || o_orderkey || '-' || (o_orderkey + 10) AS region FROM orders) x")
def parse_regions(spark, sf_dir):
    """chr:start-end strings as columns."""
    o = table(spark, sf_dir, "orders")
    return intervals.parse_regions(o.select(F.format_string("chr%s:%s-%s", (F.col("o_custkey") % 22 + 1).cast("string"), F.col("o_orderkey").cast("string"), (F.col("o_orderkey") + 10).cast("string")).alias("region")))


# ---- depth


_DEPTH2 = f"{duck('depth')}, d2 AS (SELECT chr_group, least(sc_dp, 30) AS sc_dp, least(bulk_dp, 30) AS bulk_dp, count(*) AS n FROM depth_v GROUP BY ALL)"


def _depth2(spark, sf_dir) -> DataFrame:
    return aggs.depth_table(view(spark, sf_dir, "depth"), ["chr_group"], 30)


@query(f"WITH {_DEPTH2} SELECT * FROM d2")
def depth2_hist(spark, sf_dir):
    """The table of both depths for each group."""
    return _depth2(spark, sf_dir)


@query(f"WITH {_DEPTH2} SELECT chr_group, round(sum(sc_dp * n) / sum(n)::DOUBLE, 6) AS sc_mean, round(sum(bulk_dp * n) / sum(n)::DOUBLE, 6) AS bulk_mean FROM d2 GROUP BY chr_group")
def mean_coverage(spark, sf_dir):
    """Mean depths from the table."""
    return aggs.mean_coverage(_depth2(spark, sf_dir), ["chr_group"]).select("chr_group", r6("sc_mean"), r6("bulk_mean"))


@query(f"WITH {_DEPTH2} SELECT chr_group, sum(n) FILTER (sc_dp >= 6 AND bulk_dp >= 11)::BIGINT AS snv, sum(n) FILTER (sc_dp >= 10 AND bulk_dp >= 11)::BIGINT AS indel, sum(n) FILTER (bulk_dp > 0)::BIGINT AS bulk_accessible FROM d2 GROUP BY chr_group")
def analyzable_bp(spark, sf_dir):
    """Bases with enough depth for each type."""
    return aggs.analyzable(_depth2(spark, sf_dir), {"snv": (6, 11), "indel": (10, 11)}, ["chr_group"])


@query(f"WITH {_DEPTH2} SELECT sc_dp, sum(n)::BIGINT AS n FROM d2 GROUP BY sc_dp")
def depth_margin(spark, sf_dir):
    """The cell's margin of the depth table."""
    return _depth2(spark, sf_dir).groupBy("sc_dp").agg(F.sum("n").alias("n"))


@query(f"WITH {_DEPTH2} SELECT chr_group, round(sum(CASE WHEN sc_dp < 6 THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS below_sc, round(sum(CASE WHEN bulk_dp < 11 THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS below_bulk, round(sum(CASE WHEN sc_dp < 6 OR bulk_dp < 11 THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS below_either FROM d2 GROUP BY chr_group")
def depth_cutoffs(spark, sf_dir):
    """Shares of bases below the cutoffs."""
    return aggs.below_cutoffs(_depth2(spark, sf_dir), 6, 11, ["chr_group"]).select("chr_group", r6("below_sc"), r6("below_bulk"), r6("below_either"))


# ---- spectra and rescue

_CHANNELS = [f"{a}>{b}" for a in "ACGT" for b in ("A", "C", "G", "T", "AT", "CT", "GT", "TT") if a != b]
_CHANNEL_SQL = "channels AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in _CHANNELS) + "]) AS channel)"


def _channels(spark) -> DataFrame:
    return spark.createDataFrame([(c,) for c in _CHANNELS], "channel string")


@query(f"WITH {duck_scored()}, {_CHANNEL_SQL}, c AS (SELECT channel, count(*) AS n FROM scored GROUP BY channel) SELECT channel, coalesce(n, 0) AS n FROM channels LEFT JOIN c USING (channel)")
def spectrum_counts(spark, sf_dir):
    """Counts of all channels."""
    return aggs.spectrum(scored(spark, sf_dir), _channels(spark), fraction=False)


@query(f"WITH {duck_scored()}, {_CHANNEL_SQL}, g AS (SELECT muttype, channels.channel FROM (SELECT DISTINCT muttype FROM scored) m CROSS JOIN channels), c AS (SELECT muttype, channel, count(*) AS n FROM scored GROUP BY ALL) SELECT muttype, channel, coalesce(n, 0) AS n, round((coalesce(n, 0) + 0.1) / sum(coalesce(n, 0) + 0.1) OVER (PARTITION BY muttype), 6) AS share FROM g LEFT JOIN c USING (muttype, channel)")
def spectrum_fraction(spark, sf_dir):
    """Shares of all channels by group."""
    return aggs.spectrum(scored(spark, sf_dir), _channels(spark), ["muttype"], 0.1).withColumn("share", F.round("share", 6))


_FRACTIONS = f"""{_CALLED}, {_CHANNEL_SQL}, c AS (SELECT channel, count(*) AS n FROM called WHERE lysis_fdr <= 0.05 GROUP BY channel),
 f AS (SELECT channel, (coalesce(n, 0) + 0.001) / sum(coalesce(n, 0) + 0.001) OVER () AS share, (1 + ascii(channel) % 5) / 100.0::DOUBLE AS true_sig, (1 + length(channel) * 2) / 100.0::DOUBLE AS artifact_sig FROM channels LEFT JOIN c USING (channel)),
 s AS (SELECT sum(true_sig * true_sig) AS tt, sum(artifact_sig * artifact_sig) AS aa, sum(true_sig * artifact_sig) AS ta, sum(true_sig * share) AS ts, sum(artifact_sig * share) AS sa FROM f),
 o AS (SELECT *, (ts * aa - sa * ta) / nullif(tt * aa - ta * ta, 0) AS x, (sa * tt - ts * ta) / nullif(tt * aa - ta * ta, 0) AS y, greatest(ts / tt, 0) AS xo, greatest(sa / aa, 0) AS yo FROM s),
 w AS (SELECT CASE WHEN x >= 0 AND y >= 0 THEN x WHEN xo * ts >= yo * sa THEN xo ELSE 0 END AS w1, CASE WHEN x >= 0 AND y >= 0 THEN y WHEN xo * ts >= yo * sa THEN 0 ELSE yo END AS w2 FROM o),
 weights AS (SELECT channel, true_sig * (w1 + 0.001) / nullif(artifact_sig * (w2 + 0.001), 0) AS weight FROM f, w)"""


def _weights(spark, calls: DataFrame) -> DataFrame:
    calls = calls.where("lysis_fdr <= 0.05")
    f = aggs.spectrum(calls, _channels(spark), (), 0.001)
    return filters.rescue_weights(f.select("channel", "share", ((1 + F.ascii("channel") % 5) / 100.0).alias("true_sig"), ((1 + F.length("channel") * 2) / 100.0).alias("artifact_sig")))


@query(f"WITH {_FRACTIONS} SELECT channel, round(weight, 6) AS weight FROM weights")
def sig_nnls(spark, sf_dir):
    """Weights of channels by non-negative least squares on two signatures."""
    return _weights(spark, tested(spark, sf_dir)).select("channel", r6("weight"))


RESCUE_COLUMNS = [*SITE_KEY, "channel", "dp", "af", "lysis_pv", "lysis_beta", "nt", "na", "lysis_fdr", "mda_fdr", "static_filter", "pass", *filters.LABELS]


@query(f"WITH {_FRACTIONS}, r AS (SELECT called.*, weight, concat_ws(';', {_REASONS}) = 'pre.amplification.artifact' AND NOT pass AS only_pre, lysis_pv / nullif(lysis_pv + lysis_beta * weight * (nt / na), 0) AS rate FROM called LEFT JOIN weights USING (channel)) SELECT chr, pos, refnt, altnt, CASE WHEN only_pre THEN round(rate, 6) END AS rescue_fdr, coalesce(only_pre AND rate <= 0.05, false) AS rescue FROM r WHERE static_filter AND lysis_fdr <= 0.5 AND mda_fdr <= 0.5")
def rescue_fdr(spark, sf_dir):
    """Rescue of sites whose only fault is the first rate."""
    sites = stored.written(called_sites(spark, sf_dir).select(*RESCUE_COLUMNS), "called")  # read for weights and sites
    return filters.rescued(filters.reduced(sites), _weights(spark, sites), 0.01, 0.05).select(*SITE_KEY, r6("rescue_fdr"), "rescue")


@query(f"WITH {duck_scored()} SELECT refnt, altnt, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY refnt), 6) AS share FROM scored WHERE muttype = 'snv' GROUP BY refnt, altnt")
def base_transitions(spark, sf_dir):
    """Shares of alternative bases for each reference base."""
    return aggs.transitions(scored(spark, sf_dir).where("muttype = 'snv'")).select("refnt", "altnt", "n", r6("share"))
