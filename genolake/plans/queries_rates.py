"""Queries of the prior tables and of what is judged by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import priors, rescue, sensitivity
from ..operators import filters, intervals
from ..sources import indexed, spatial, stored
from . import accessors
from .adapters import duck, duck_scored, panel, scored, view
from .queries import _CALLED, _CANDIDATE, _CHANNEL_SQL, _CONTIGS, _REASONS, _TILES, PARAMS, RESCUE_COLUMNS, SITE_KEY, _channels, called_sites, query, r6, tested
from .queries_more import _CALLS, adjacent_calls

_HISTOGRAMS = f"""{duck_scored()},
 pop AS (SELECT *, coalesce(training_site AND scalt >= 2 AND dp >= 6 AND bulk_dp >= 11, false) AS germ, coalesce({_CANDIDATE} AND scalt >= 2 AND dp >= 6, false) AS cand,
   CASE WHEN dp = 0 OR af IS NULL OR af = 0 THEN 1 ELSE ceil(af * 20)::INT END AS bin FROM scored),
 bound AS (SELECT muttype, coalesce(floor(quantile_cont(dp, 0.8) FILTER (germ))::INT, 0) AS max_dp FROM pop GROUP BY muttype),
 placed AS (SELECT pop.*, least(dp, max_dp + 1) + 1 AS dp_idx FROM pop JOIN bound USING (muttype)),
 hist AS (SELECT muttype, dp_idx, bin, count(*) FILTER (germ AND af > 0) AS g, count(*) FILTER (cand AND af IS NOT NULL) AS s FROM placed WHERE (germ AND af > 0) OR (cand AND af IS NOT NULL) GROUP BY ALL)"""


def _candidates(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("somatic_candidate", filters.candidate(PARAMS))


@query(f"WITH {_HISTOGRAMS} SELECT * FROM hist")
def prior_histograms(spark, sf_dir):
    """Germline sites and candidates by type, depth (up to its own bound, deeper ones together) and bin of the allele fraction."""
    s = stored.written(_candidates(spark, sf_dir).select("muttype", "dp", "af", "scalt", "bulk_dp", "training_site", "somatic_candidate"), "sites")
    return priors.histograms(s, priors.depth_bounds(s, PARAMS), PARAMS)


@query(f"""WITH {_HISTOGRAMS},
 deep AS (SELECT muttype, dp_idx, sum(g) AS gs, sum(s) AS ss, floor(sum(s) / 3) AS b FROM hist GROUP BY ALL),
 dense AS (SELECT deep.*, n.bin, coalesce(hist.g, 0) AS g, coalesce(hist.s, 0) AS s FROM deep CROSS JOIN (SELECT unnest(range(1, 21)) AS bin) n LEFT JOIN hist ON deep.muttype = hist.muttype AND deep.dp_idx = hist.dp_idx AND n.bin = hist.bin),
 tab AS (SELECT *, CASE WHEN gs = 0 OR ss = 0 THEN 0.1 ELSE greatest(b * g / gs, 0.1) END AS nt, CASE WHEN gs = 0 THEN 0.1 ELSE greatest((b + 1) * g / gs, 0.1) END AS loo_nt FROM dense),
 full_tab AS (SELECT *, CASE WHEN gs = 0 OR ss = 0 THEN 0.1 ELSE greatest(s - nt, 0.1) END AS na, CASE WHEN gs = 0 THEN 0.1 ELSE greatest(s + 1 - loo_nt, 0.1) END AS loo_na FROM tab)
SELECT chr, pos, refnt, altnt, round(nt2, 6) AS nt, round(na2, 6) AS na, round(lysis_pv * na2 / nullif(lysis_pv * na2 + lysis_beta * nt2, 0), 6) AS lysis_fdr
FROM (SELECT p.* EXCLUDE (nt, na), coalesce(CASE WHEN training_site AND scalt >= 2 THEN loo_nt ELSE t.nt END, 0.1)::DOUBLE AS nt2, coalesce(CASE WHEN training_site AND scalt >= 2 THEN loo_na ELSE t.na END, 0.1)::DOUBLE AS na2
  FROM placed p LEFT JOIN full_tab t ON p.muttype = t.muttype AND p.dp_idx = t.dp_idx AND p.bin = t.bin) x""")
def prior_rates(spark, sf_dir):
    """Prior counts and rates of all sites for burdens known before (a third of the candidates of a depth); training sites as left out."""
    s = stored.written(_candidates(spark, sf_dir).select(*SITE_KEY, "muttype", "dp", "af", "scalt", "bulk_dp", "training_site", "somatic_candidate", "lysis_pv", "lysis_beta"), "sites")
    counted = priors.counts(s, PARAMS)
    known = counted[1].groupBy("muttype", "dp_idx").agg(F.floor(F.sum("s") / 3).cast("double").alias("high"))
    rated = priors.assign(s, PARAMS, known, counted=counted)
    return rated.select(*SITE_KEY, r6("nt"), r6("na"), r6(filters.fdr(F.col("lysis_pv"), F.col("lysis_beta"), F.col("nt"), F.col("na")), "lysis_fdr"))


@query(f"WITH {duck('sample_counts')} SELECT chr, pos, sample, ref_n, alt_n FROM sample_counts_v WHERE chr = 'chr7' AND pos BETWEEN 1000 AND 40000")
def region_scan(spark, sf_dir):
    """All counts written as indexed, block-compressed text, and one region read back through the index."""
    path = stored.new_path(spark, "indexed")
    indexed.write(view(spark, sf_dir, "sample_counts"), path)
    return indexed.read(spark, path, "chr string, pos int, sample string, ref_n int, alt_n int", "chr7:1000-40000")


_RESCUE = f"""{_CALLED}, {_CHANNEL_SQL},
 smp AS (SELECT *, 's' || pos % 6 AS sample, concat_ws(';', {_REASONS}) = 'pre.amplification.artifact' AND NOT pass AS only_pre FROM called WHERE static_filter AND lysis_fdr <= 0.5 AND mda_fdr <= 0.5),
 ch AS (SELECT channel, CASE WHEN length(channel) = 3 THEN 'snv' ELSE 'indel' END AS muttype, (1 + ascii(right(channel, 1)) % 7)::DOUBLE / 60 AS artifact_sig FROM channels),
 tr AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY muttype), 0)::DOUBLE AS true_sig FROM (SELECT ch.muttype, ch.channel, any_value(artifact_sig) AS artifact_sig, count(pos) AS n FROM ch LEFT JOIN (SELECT * FROM smp WHERE pass) p ON ch.muttype = p.muttype AND ch.channel = p.channel GROUP BY ALL)),
 g AS (SELECT sample, muttype, channel, count(*) AS n FROM smp WHERE only_pre GROUP BY ALL),
 f AS (SELECT *, m / sum(m) OVER (PARTITION BY sample, muttype)::DOUBLE AS share FROM (SELECT d.sample, tr.muttype, tr.channel, true_sig, artifact_sig, coalesce(g.n, 0) AS m FROM (SELECT DISTINCT sample, muttype FROM g) d JOIN tr ON d.muttype = tr.muttype AND true_sig IS NOT NULL LEFT JOIN g ON g.sample = d.sample AND g.muttype = tr.muttype AND g.channel = tr.channel)),
 s AS (SELECT sample, muttype, sum(true_sig * true_sig) AS tt, sum(artifact_sig * artifact_sig) AS aa, sum(true_sig * artifact_sig) AS ta, sum(true_sig * share) AS ts, sum(artifact_sig * share) AS sa FROM f GROUP BY ALL),
 o AS (SELECT *, (ts * aa - sa * ta) / nullif(tt * aa - ta * ta, 0) AS x, (sa * tt - ts * ta) / nullif(tt * aa - ta * ta, 0) AS y, greatest(ts / tt, 0) AS xo, greatest(sa / aa, 0) AS yo FROM s),
 w AS (SELECT sample, muttype, CASE WHEN x >= 0 AND y >= 0 THEN x WHEN xo * ts >= yo * sa THEN xo ELSE 0 END AS w1, CASE WHEN x >= 0 AND y >= 0 THEN y WHEN xo * ts >= yo * sa THEN 0 ELSE yo END AS w2 FROM o),
 weights AS (SELECT f.sample, f.muttype, channel, true_sig * (w1 + 0.001) / (artifact_sig * (w2 + 0.001)) AS weight FROM f JOIN w ON f.sample = w.sample AND f.muttype = w.muttype)"""


@query(f"""WITH {_RESCUE} SELECT smp.sample, chr, pos, refnt, altnt, CASE WHEN only_pre THEN round(lysis_pv / nullif(lysis_pv + lysis_beta * weight * (nt / na), 0), 6) END AS rescue_fdr,
  coalesce(only_pre AND lysis_pv / nullif(lysis_pv + lysis_beta * weight * (nt / na), 0) <= 0.05, false) AS rescue
FROM smp LEFT JOIN weights w ON smp.sample = w.sample AND smp.muttype = w.muttype AND smp.channel = w.channel""")
def rescue_batch(spark, sf_dir):
    """Rescue over six cells: the spectrum of all cells' calls, each cell's own weights, and its rescued sites."""
    cells = called_sites(spark, sf_dir).select(*RESCUE_COLUMNS, "muttype", F.concat(F.lit("s"), (F.col("pos") % 6).cast("string")).alias("sample"))
    artifact = _channels(spark).select(F.when(F.length("channel") == 3, "snv").otherwise("indel").alias("muttype"), "channel", ((1 + F.ascii(F.expr("right(channel, 1)")) % 7) / F.lit(60.0)).alias("artifact_sig"))
    return rescue.batch(cells, artifact, target_fdr=0.01, rescue_fdr=0.05)["sites"].select("sample", *SITE_KEY, r6("rescue_fdr"), "rescue")


def _covariate_tiles(spark, sf_dir):
    """The bins as tiles with the covariates of the four models and their training sites, by arithmetic."""
    cnt, k = F.col("cnt"), F.floor(F.col("start") / 3600)
    tiles = view(spark, sf_dir, "bins").select("chr", "start", "end_", ((k * 37 % 101 - 50) / 25.0).alias("gp_mu"), (0.3 + cnt * 17 % 23 / 20.0).alias("gp_sd"), (cnt * 1.7 + k % 13).alias("mean_sc_dp"), *[
        c for t, m in (("snv", 3), ("indel", 5)) for c in ((k * m % 97 * 10).alias(f"bases_gt_{t}_sc_min_dp"), (cnt * m % 89 * 10).alias(f"bases_gt_{t}_bulk_min_dp"), (k * m * m % 31).alias(f"{t}_nbhd"),
            *[e for a, j in (("maj", 2), ("min", 7)) for e in ((k * j % 5 + 1).alias(f"{t}_ntotal_{a}"), F.least(k * j % 5 + 1, (cnt * j + k) % 6).alias(f"{t}_npass_{a}"))])])
    return sensitivity.prepared(tiles, ["view"])


@query()
def sensitivity_models(spark, sf_dir):
    """Predicted sensitivity of tiles by type and allele: four models fitted in the same passes."""
    tiles = stored.written(_covariate_tiles(spark, sf_dir), "tiles")
    return sensitivity.models(tiles, ["view"])[0].select("chr", "start", "held_out", *[r6(f"pred_{g}") for g in sensitivity.GROUPS])


_BACK = "CASE WHEN {c} IS NULL THEN NULL ELSE round(trunc(65534 * ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())) / 65534 * (max({c}) OVER () - min({c}) OVER ()) + min({c}) OVER (), 6) END AS {c}"


@query(f"WITH {duck('bins')}, t AS (SELECT chr, start, end_, gc, CASE WHEN cnt % 5 > 0 THEN cnt / 7.0::DOUBLE END AS depth FROM bins_v), q AS (SELECT chr, start, end_, {_BACK.format(c='gc')}, {_BACK.format(c='depth')} FROM t) SELECT * FROM q WHERE start <= 900000 AND end_ >= 100000 AND chr = 'click'")
def spatial_region(spark, sf_dir):
    """Tiles written as compressed chunks, and those of one region read back, within a step of what they were."""
    tiles = view(spark, sf_dir, "bins").select("chr", "start", "end_", "gc", F.when(F.col("cnt") % 5 > 0, F.col("cnt") / F.lit(7.0)).alias("depth"))
    chunks = stored.written(spatial.compress(stored.written(tiles, "tiles"), ["gc", "depth"], 256), "chunks")
    return spatial.decompress(chunks, ["gc", "depth"], ("click", 100_000, 900_000)).select("chr", "start", "end_", r6("gc"), r6("depth"))


_SITE_COUNTS = ", ".join(f"count(s.pos) FILTER (muttype = '{t}' AND {has}{on}) AS {t}_{k}{a}" for t in ("snv", "indel") for k, has in (("ntotal", "training_site"), ("npass", "training_site AND training_pass"), ("ncalls", "pass")) for a, on in (("", ""), ("_maj", " AND af >= 0.5"), ("_min", " AND af < 0.5")))
_NEAR = "CASE WHEN count(*) OVER w = 4 THEN sum({c}) OVER w END::BIGINT AS {n}"


@query(f"""WITH {_CALLED}, {_TILES}, c AS (SELECT t.chr, start, end_, {_SITE_COUNTS} FROM tile t LEFT JOIN called s ON t.chr = s.chr AND s.pos BETWEEN start AND end_ GROUP BY ALL)
SELECT *, {', '.join(_NEAR.format(c=f'{t}_{c}', n=f'{t}_{n}') for t in ('snv', 'indel') for c, n in (('ntotal', 'nbhd'), ('ncalls', 'calls_nbhd')))} FROM c WINDOW w AS (PARTITION BY chr ORDER BY start ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)""")
def sensitivity_covariates(spark, sf_dir):
    """Training sites, those that would be called, and calls of each tile, by type and allele, and in its neighbourhood."""
    called = called_sites(spark, sf_dir).select("chr", "pos", "muttype", "af", "training_site", "training_pass", "pass")
    called = stored.written(called, "called")  # a filter and eighteen counts name what many tests tell
    return sensitivity.covariates(intervals.fixed_tiles(intervals.contigs(spark, _CONTIGS), 100_000), called, 2)


@query(f"""WITH {_CALLED} SELECT 's' || (pos % 3) AS sample, chr, pos, refnt, altnt, muttype, mutsig, round(af, 6) AS af, scalt, dp, round(abc_pv, 6) AS abc_pv, balt, bulk_dp,
  CASE WHEN dp % 2 = 0 THEN training_site END AS resampled_training_site, pass, NULL::BOOLEAN AS rescue, training_pass FROM called WHERE pass OR dp % 2 = 0""")
def shared_columns(spark, sf_dir):
    """The columns that tables of several samples share, of calls and of another part of the sites that overlaps them."""
    called = called_sites(spark, sf_dir).withColumn("sample", F.concat(F.lit("s"), (F.col("pos") % 3).cast("string"))).where("pass or dp % 2 = 0")
    s = stored.written(called.select("training_site", *[c for c in accessors.SHARED if c in called.columns]), "called")
    even = s.where("dp % 2 = 0").withColumn("resampled_training_site", F.col("training_site"))
    return accessors.shared_table([even, s.where("pass")], [f"chr{k}" for k in range(1, 23)]).withColumns({"af": F.round("af", 6), "abc_pv": F.round("abc_pv", 6)})


@query(f"WITH {duck('bins')}, g AS (SELECT round_even(gc, 3) AS gc, avg(cnt) AS value FROM bins_v WHERE gc IS NOT NULL GROUP BY 1), n AS (SELECT *, lead(gc) OVER (ORDER BY gc) - gc AS gap FROM g) SELECT gc, round(value, 6) AS value FROM n WHERE coalesce(gap, 0) < 0.05")
def coverage_along_gc(spark, sf_dir):
    """Mean counts of bins along GC."""
    return accessors.binned_along(view(spark, sf_dir, "bins"), "cnt", "gc").select("gc", r6("value"))


@query(f"WITH {duck('bins')} SELECT chr, ((start::BIGINT + end_) // 2)::INT AS pos, cnt::DOUBLE AS value FROM bins_v")
def coverage_along_positions(spark, sf_dir):
    """Counts at the middle of each bin."""
    return accessors.binned_along(view(spark, sf_dir, "bins"), "cnt")


@query(f"""WITH {_CALLS}, t AS (SELECT *, CASE WHEN pos % 9 = 0 THEN 'indel' ELSE 'snv' END AS muttype FROM c), v AS (SELECT * FROM t WHERE muttype = 'snv'),
 g AS (SELECT *, pos - lag(pos) OVER w AS a, lead(pos) OVER w - pos AS b FROM v WINDOW w AS (PARTITION BY sample, chr ORDER BY pos)),
 n AS (SELECT *, sum(CASE WHEN a = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY sample, chr ORDER BY pos) AS island FROM g WHERE least(a, b) = 1),
 m AS (SELECT sample, chr, island, min(pos) AS pos, string_agg(refnt, '' ORDER BY pos) AS refnt, string_agg(altnt, '' ORDER BY pos) AS altnt, count(*) AS n FROM n GROUP BY ALL HAVING max(scalt) - min(scalt) <= 2 AND max(scref) - min(scref) <= 2)
SELECT sample, chr, pos, refnt, altnt, CASE WHEN n = 2 THEN 'dnv' ELSE 'mnv' END AS muttype, n::INT AS n_combined FROM m
UNION ALL SELECT sample, chr, pos, refnt, altnt, muttype, 1 FROM t WHERE muttype = 'indel' OR NOT EXISTS (SELECT 1 FROM m WHERE m.sample = t.sample AND m.chr = t.chr AND t.pos BETWEEN m.pos AND m.pos + m.n - 1)""")
def combined_calls(spark, sf_dir):
    """All calls, substitutions at adjacent positions as one."""
    calls = adjacent_calls(spark, sf_dir).withColumn("muttype", F.when(F.col("pos") % 9 == 0, "indel").otherwise("snv"))
    return accessors.combined_neighbours(calls).select("sample", "chr", "pos", "refnt", "altnt", "muttype", "n_combined")


_OTHER_TESTS = " AND ".join(t for t in filters.TESTS if t not in ("dp_test", "bulk_alt_test", "lowmq_test"))
SWEEP = ([6, 10, 20, 30], [0, 1, 2, 3], [1e-5, 1e-3, 0.01, 0.1, 0.25, 0.5, 1.0])


@query(f"""WITH {_CALLED}, grid AS (SELECT m AS muttype, d::INT AS min_sc_dp, a::INT AS max_bulk_alt, t AS target_fdr FROM (SELECT unnest(['snv', 'indel']) AS m) x1, (SELECT unnest({SWEEP[0]}) AS d) x2, (SELECT unnest({SWEEP[1]}) AS a) x3, (SELECT unnest({SWEEP[2]}::DOUBLE[]) AS t) x4),
 rows AS (SELECT called.*, one_donor, few_cells FROM called, limits WHERE muttype = 'snv' OR (NOT few_cells AND (NOT one_donor OR unique_cells = 1)) OR training_site)
SELECT grid.muttype, min_sc_dp, max_bulk_alt, target_fdr,
  count(*) FILTER (bulk_dp >= 11 AND balt <= max_bulk_alt AND bulk_af <= 1 AND bulk_binom_prob <= 1 AND coalesce(balt_lowmq <= max_bulk_alt, true) AND (max_bulk_alt > 0 OR bulk_gt = '0/0') AND talt >= 2 AND dbsnp = '.' AND NOT training_site
    AND coalesce(phased_gt, './.') = './.' AND {_OTHER_TESTS} AND dp >= min_sc_dp AND (grid.muttype = 'snv' OR (NOT few_cells AND (NOT one_donor OR unique_cells = 1)))) AS calls,
  count(*) FILTER (training_site AND sc_alt_test AND id_test AND hs_test AND abc_test AND bulk_dp >= 11 AND dp >= min_sc_dp) AS training_passed
FROM grid LEFT JOIN rows ON grid.muttype = rows.muttype AND lysis_fdr <= target_fdr AND mda_fdr <= target_fdr GROUP BY ALL""")
def call_sweep(spark, sf_dir):
    """Calls and training sites that would be called over depths, bulk reads and target rates, in one pass over the sites."""
    s = tested(spark, sf_dir)
    return filters.call_sweep(s, *SWEEP, PARAMS, panel(spark, sf_dir))
