"""More registered queries: coverage bins, order-dependent operators, strata, burdens, sweeps and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..models import allele_balance, tails
from ..operators import aggs, blocks, filters, joins, windows
from ..sources import stored, vcf
from .adapters import duck, duck_scored, scored, table, view
from .queries import _CALLED, _REASONS, SITE_KEY, called_sites, query, r6, tested

# ---- coverage bins


@query(f"WITH {duck('bins')}, n AS (SELECT *, (row_number() OVER (PARTITION BY chr ORDER BY start) - 1) // 7 AS g FROM bins_v) SELECT chr, min(start) AS start, arg_max(end_, start) AS end_, sum(cnt)::BIGINT AS cnt, round(avg(gc), 6) AS gc FROM n GROUP BY chr, g")
def bins_collapse(spark, sf_dir):
    """Seven bins in a row as one; a shorter rest stays."""
    return aggs.collapse_bins(view(spark, sf_dir, "bins"), 7).withColumn("gc", F.round("gc", 6))


_RATIO = f"{duck('bins')}, ratio AS (SELECT *, (cnt + 1) / (SELECT median(cnt) FROM bins_v) AS r FROM bins_v)"


def _ratios(spark, sf_dir):
    b = view(spark, sf_dir, "bins")
    return b.withColumn("r", (F.col("cnt") + 1) / b.agg(F.median("cnt").alias("m")).scalar())


@query(f"WITH {_RATIO} SELECT round(median(step), 6) AS mapd FROM (SELECT abs(log2(r) - lag(log2(r)) OVER (PARTITION BY chr ORDER BY start)) AS step FROM ratio) x")
def mapd(spark, sf_dir):
    """Median absolute difference of neighbouring log ratios."""
    return aggs.mapd(_ratios(spark, sf_dir), "r").select(r6("mapd"))


@query(f"""WITH {duck('bins')}, n AS (SELECT unnest([1, 2, 4, 8, 16])::INT AS n_bins), b AS (SELECT chr, cnt, row_number() OVER (PARTITION BY chr ORDER BY start) - 1 AS i FROM bins_v), l AS (SELECT n_bins, chr, i // n_bins AS g, sum(cnt) AS cnt FROM b, n GROUP BY ALL),
 r AS (SELECT n_bins, chr, g, (cnt + 1) / median(cnt) OVER (PARTITION BY n_bins) AS r FROM l), s AS (SELECT n_bins, abs(log2(r) - lag(log2(r)) OVER (PARTITION BY n_bins, chr ORDER BY g)) AS step FROM r) SELECT n_bins, round(median(step), 6) AS mapd FROM s GROUP BY n_bins""")
def mapd_curve(spark, sf_dir):
    """The same over bins of 1, 2, 4, 8 and 16, each from the last."""
    return aggs.mapd_curve(view(spark, sf_dir, "bins"), (1, 2, 4, 8, 16)).select("n_bins", r6("mapd"))


@query(f"WITH {_RATIO}, g AS (SELECT round_even(gc, 3) AS gc, avg(log2(r)) AS mean, count(*) AS n FROM ratio GROUP BY 1) SELECT round(gc, 6) AS gc, round(mean, 6) AS mean, n FROM (SELECT *, lead(gc) OVER (ORDER BY gc) AS nx FROM g) x WHERE coalesce(nx - gc, 0) < 0.05")
def gc_group(spark, sf_dir):
    """Mean log ratio by GC."""
    b = _ratios(spark, sf_dir).withColumn("log_ratio", F.log2("r"))
    return aggs.gc_groups(b).select(r6("gc"), r6("mean"), "n")


@query(f"WITH {duck('bins')}, s AS (SELECT chr AS seg, median(cnt)::DOUBLE AS value, count(*) AS n FROM bins_v GROUP BY chr), m AS (SELECT sum(value * n) / sum(n) AS m FROM s), e AS (SELECT p / 20.0::DOUBLE AS ploidy, sum(n * pow(value / m * (p / 20.0::DOUBLE) - round(value / m * (p / 20.0::DOUBLE)), 2)) AS error FROM s, m, range(30, 121) t(p) GROUP BY p) SELECT round(ploidy, 6) AS ploidy, round(error, 6) AS error FROM e ORDER BY round(error, 9), ploidy LIMIT 1")
def ginkgo_ploidy(spark, sf_dir):
    """The ploidy of least distance to whole copy numbers."""
    segments = view(spark, sf_dir, "bins").groupBy(F.col("chr").alias("seg")).agg(F.median("cnt").alias("value"), F.count("*").alias("n"))
    options = spark.range(30, 121).select((F.col("id") / 20.0).alias("ploidy"))
    return aggs.ploidy(segments, options).select(r6("ploidy"), r6("error"))


# ---- order-dependent operators

_SAMPLED = f"{duck('sample_counts')}, x AS (SELECT chr, pos, sample FROM sample_counts_v)"


@query(f"WITH {_SAMPLED}, g AS (SELECT *, pos - lag(pos) OVER w AS a, lead(pos) OVER w - pos AS b FROM x WINDOW w AS (PARTITION BY sample, chr ORDER BY pos)) SELECT chr, pos, sample, least(a, b) AS nearest FROM g")
def nearest_gap(spark, sf_dir):
    """The distance to the nearer neighbour of each call in its sample."""
    x = view(spark, sf_dir, "sample_counts").select("chr", "pos", "sample")
    return windows.nearest_gap(x, width=1 << 12).select("chr", "pos", "sample", "nearest")


@query(f"WITH {duck('bins')} SELECT chr, start, CASE WHEN count(*) OVER w = 20 THEN sum(cnt) OVER w END::BIGINT AS nbhd FROM bins_v WINDOW w AS (PARTITION BY chr ORDER BY start ROWS BETWEEN 9 PRECEDING AND 10 FOLLOWING)")
def rolling_nbhd(spark, sf_dir):
    """Sums over 20 bins around each, NULL at the edges."""
    return windows.rolling_sum(view(spark, sf_dir, "bins"), "cnt", 10).select("chr", "start", "nbhd")


@query(f"""WITH {duck_scored()}, t AS (SELECT chr, pos, refnt, altnt, af FROM scored WHERE training_site), l AS (SELECT *, lag(pos) OVER w AS bp, lag(af) OVER w AS ba FROM t WINDOW w AS (PARTITION BY chr ORDER BY pos, refnt, altnt)),
 i AS (SELECT *, sum(CASE WHEN coalesce(pos - bp < 10000 AND af IS NOT NULL AND ba IS NOT NULL AND ba <> 0.5, false) THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY pos, refnt, altnt ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT chr, pos, refnt, altnt, round(CASE WHEN sign(af - 0.5) * sign(first_value(af) OVER (PARTITION BY chr, island ORDER BY pos, refnt, altnt) - 0.5) < 0 THEN 1 - af ELSE af END, 6) AS flipped_af FROM i""")
def phase_flip(spark, sf_dir):
    """Allele fractions of each run on the side of its first site."""
    t = scored(spark, sf_dir).where("training_site").select(*SITE_KEY, "af")
    return windows.flip_phase(t, tie=["refnt", "altnt"]).select(*SITE_KEY, r6("flipped_af"))


_CALLS = "c AS (SELECT DISTINCT 's' || (l_suppkey % 4) AS sample, 'chr' || (l_suppkey % 3) AS chr, l_orderkey::INT AS pos, substr('ACGT', (l_orderkey % 4 + 1)::INT, 1) AS refnt, substr('CGTA', (l_orderkey % 4 + 1)::INT, 1) AS altnt, (l_orderkey % 5)::INT AS scalt, (l_orderkey % 3 + 10)::INT AS scref FROM lineitem)"


@query(f"""WITH {_CALLS}, g AS (SELECT *, pos - lag(pos) OVER w AS a, lead(pos) OVER w - pos AS b FROM c WINDOW w AS (PARTITION BY sample, chr ORDER BY pos)),
 n AS (SELECT *, sum(CASE WHEN a = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY sample, chr ORDER BY pos) AS island FROM g WHERE least(a, b) = 1)
SELECT sample, chr, min(pos) AS pos, string_agg(refnt, '' ORDER BY pos) AS refnt, string_agg(altnt, '' ORDER BY pos) AS altnt, count(*) AS n, CASE WHEN count(*) = 2 THEN 'dnv' ELSE 'mnv' END AS muttype
FROM n GROUP BY sample, chr, island HAVING max(scalt) - min(scalt) <= 2 AND max(scref) - min(scref) <= 2""")
def mnv_islands(spark, sf_dir):
    """Calls at adjacent positions as one."""
    return windows.merge_neighbours(adjacent_calls(spark, sf_dir)).select("sample", "chr", "pos", "refnt", "altnt", "n", "muttype")


def adjacent_calls(spark, sf_dir):
    """Calls of four samples, many at adjacent positions."""
    key = F.col("l_orderkey")
    base = lambda s: F.substring(F.lit(s), (key % 4 + 1).cast("int"), F.lit(1))
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("sample"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 3).cast("string")).alias("chr"), key.cast("int").alias("pos"),
        base("ACGT").alias("refnt"), base("CGTA").alias("altnt"), (key % 5).cast("int").alias("scalt"), (key % 3 + 10).cast("int").alias("scref"))
    return stored.dealt(rows, "sample", "chr", "pos").distinct()


@query(f"WITH {duck('track')}, f AS (SELECT chr, pos, event_id, user_id % 2 AS v FROM track_v), n AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS s FROM f WINDOW w AS (PARTITION BY chr ORDER BY pos, event_id)), i AS (SELECT chr, v, sum(s) OVER (PARTITION BY chr ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT chr, island::BIGINT AS island, v, count(*) AS n FROM i GROUP BY chr, island, v")
def rle(spark, sf_dir):
    """Runs of one value along each chromosome."""
    t = view(spark, sf_dir, "track").select("chr", "pos", "event_id", (F.col("user_id") % 2).alias("v"))
    return windows.run_lengths(t, "v", ["pos", "event_id"]).select("chr", F.col("island").cast("long").alias("island"), "v", "n")


@query("SELECT min(q) AS cutoff FROM (SELECT q, sum(n) OVER (ORDER BY q) / sum(n) OVER () AS part FROM (SELECT l_quantity::INT AS q, count(*) AS n FROM lineitem GROUP BY 1) h) x WHERE part >= 0.9")
def cum_share(spark, sf_dir):
    """The depth below which nine tenths lie."""
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("q")).agg(F.count("*").alias("n"))
    return windows.share_cutoff(h, "q", "n", 0.9)


_PV = "t AS (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'snv' ELSE 'indel' END AS muttype, (c_custkey * 37 % 1009 + 1) / 1010.0::DOUBLE / 20 AS p FROM customer)"


@query(f"""WITH {_PV}, n AS (SELECT *, count(*) OVER (PARTITION BY muttype) AS n, row_number() OVER (PARTITION BY muttype ORDER BY p, c_custkey) AS i FROM t)
SELECT c_custkey, muttype, round(least(1, n * p), 6) AS bonferroni, round(least(1, max((n - i + 1) * p) OVER (PARTITION BY muttype ORDER BY i ROWS UNBOUNDED PRECEDING)), 6) AS holm,
 round(least(1, min(n / i * p) OVER (PARTITION BY muttype ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh FROM n""")
def padjust(spark, sf_dir):
    """Adjusted p-values of three kinds."""
    t = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, "snv").otherwise("indel").alias("muttype"), ((F.col("c_custkey") * 37 % 1009 + 1) / 1010.0 / 20).alias("p"))
    return windows.adjust_p(t, tie=["c_custkey"]).select("c_custkey", "muttype", r6("bonferroni"), r6("holm"), r6("bh"))


@query("SELECT c_custkey, round((log10(x) - avg(log10(x)) OVER ()) / stddev_samp(log10(x)) OVER (), 6) AS z FROM (SELECT c_custkey, nullif((c_custkey % 50)::DOUBLE, 0) AS x FROM customer) t")
def standardise(spark, sf_dir):
    """z-scores of logarithms, zeros left out."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 50).cast("double").alias("x"))
    return windows.standardise(c, "x", "z").select("c_custkey", r6("z"))


@query(f"""WITH {duck_scored()}, t AS (SELECT chr, pos, af, dp, lead(pos) OVER w - pos AS dist, lead(af) OVER w AS af2, lead(dp) OVER w AS dp2 FROM scored WHERE training_site WINDOW w AS (PARTITION BY chr ORDER BY pos, refnt, altnt)),
 b AS (SELECT *, CASE WHEN dist > 1 AND dist <= 100 THEN 1 WHEN dist > 100 AND dist <= 1000 THEN 2 WHEN dist > 1000 AND dist <= 10000 THEN 3 WHEN dist > 10000 AND dist <= 100000 THEN 4 END AS bin FROM t)
SELECT chr, bin, count(*) AS n, round(avg(dist), 6) AS mean_dist, max(dist) AS max_dist, round(CASE WHEN count(*) FILTER (af IS NOT NULL AND af2 IS NOT NULL) >= 3 THEN greatest(least(CASE WHEN isnan(corr(af, af2)) THEN NULL ELSE corr(af, af2) END, 0.99), -0.99) END, 5) AS r, floor(avg((dp + dp2) / 2.0))::INT AS mean_dp FROM b WHERE bin IS NOT NULL GROUP BY chr, bin""")
def adjacent_cor(spark, sf_dir):
    """Correlation of neighbouring allele fractions by distance."""
    t = scored(spark, sf_dir).where("training_site").select(*SITE_KEY, "af", "dp")
    # the next site of a chromosome, through blocks
    here = F.struct("pos", "refnt", "altnt", "af", "dp")
    df = blocks.passed(t, ["chr"], [{"_lead": F.lead(here).over(blocks.inside(["chr"], "pos", "refnt", "altnt"))}], {"_head": F.min(here)}, lambda earlier, later: [{"_after": blocks.first("_head").over(later)}])
    pairs = df.withColumn("_n", F.coalesce("_lead", "_after")).select("chr", (F.col("_n.pos") - F.col("pos")).alias("dist"), F.col("af").alias("af_1"), F.col("_n.af").alias("af_2"), F.col("dp").alias("dp_1"), F.col("_n.dp").alias("dp_2")).where("dist is not null")
    return aggs.correlation_by_distance(pairs, [1, 100, 1000, 10000, 100000]).select("chr", "bin", "n", r6("mean_dist"), "max_dist", F.round("r", 5).alias("r"), "mean_dp")


# ---- strata, sensitivity and burden

_TILE = "tile AS (SELECT chr, start, end_, CASE WHEN cnt % 2 = 0 THEN 'snv' ELSE 'indel' END AS muttype, CASE WHEN cnt % 3 = 0 THEN 'major' ELSE 'minor' END AS allele, gc AS x, (cnt % 7)::INT AS hits, (cnt % 7 + start // 3600 % 4)::INT AS total, (cnt * 37 + start // 3600) % 100 / 100.0::DOUBLE AS pred FROM bins_v)"


def _tiles(spark, sf_dir):
    b = view(spark, sf_dir, "bins")
    k = F.floor(F.col("start") / 3600)
    return b.select(
        "chr", "start", "end_", F.when(F.col("cnt") % 2 == 0, "snv").otherwise("indel").alias("muttype"), F.when(F.col("cnt") % 3 == 0, "major").otherwise("minor").alias("allele"), F.col("gc").alias("x"),
        (F.col("cnt") % 7).cast("int").alias("hits"), (F.col("cnt") % 7 + k % 4).cast("int").alias("total"), ((F.col("cnt") * 37 + k) % 100 / 100.0).alias("pred"))


@query(f"WITH {duck('bins')}, {_TILE} SELECT round(round_even(pred, 2), 6) AS stratum, sum(hits)::BIGINT AS hits, sum(total)::BIGINT AS total, count(*) AS n, round(sum(hits) / nullif(sum(total)::DOUBLE, 0), 6) AS rate FROM tile GROUP BY 1")
def tile_strata(spark, sf_dir):
    """Rates by rounded prediction."""
    return aggs.strata(_tiles(spark, sf_dir)).select(r6("stratum"), "hits", "total", "n", r6("rate"))


@query(f"WITH {duck('bins')}, {_TILE} SELECT round(round_even(x, 1), 6) AS covariate, round(sum(hits) / nullif(sum(total)::DOUBLE, 0), 6) AS rate, round(avg(pred), 6) AS mean_pred, count(*) AS n FROM tile WHERE x IS NOT NULL GROUP BY 1")
def covariate_bins(spark, sf_dir):
    """Measured rate and mean prediction by a covariate."""
    return aggs.by_covariate(_tiles(spark, sf_dir), F.col("x"), 1).select(r6("covariate"), r6("rate"), r6("mean_pred"), "n")


@query(f"WITH {duck('bins')}, {_TILE} SELECT muttype, allele, round(sum(hits) / nullif(sum(total)::DOUBLE, 0), 6) AS pooled, round(avg(pred), 6) AS mean, round(stddev_samp(pred), 6) AS sd, round(quantile_cont(pred, 0.25), 6) AS q25, round(quantile_cont(pred, 0.75), 6) AS q75 FROM tile WHERE total > 0 GROUP BY muttype, allele")
def sensitivity_summary(spark, sf_dir):
    """Sensitivity by type and allele."""
    return aggs.sensitivity(_tiles(spark, sf_dir)).select("muttype", "allele", *[r6(c) for c in ("pooled", "mean", "sd", "q25", "q75")])


@query(f"WITH {duck('bins')}, {_TILE}, s AS (SELECT round_even(pred, 2) AS stratum, sum(hits) AS hits, count(*) AS n FROM tile GROUP BY 1) SELECT round(sum(hits) / nullif(sum(n * stratum), 0), 6) AS burden FROM s")
def burden_mean(spark, sf_dir):
    """Calls over expected sensitive tiles."""
    return aggs.mean_burden(aggs.strata(_tiles(spark, sf_dir))).select(r6("burden"))


@query(f"""WITH {_CALLED}, {duck('depth')}, d2 AS (SELECT least(sc_dp, 500) AS sc_dp, least(bulk_dp, 500) AS bulk_dp, count(*) AS n FROM depth_v GROUP BY ALL),
 g AS (SELECT * FROM called WHERE training_site), e AS (SELECT quantile_cont(dp, 0.0) AS q0, quantile_cont(dp, 0.25) AS q1, quantile_cont(dp, 0.5) AS q2, quantile_cont(dp, 0.75) AS q3, quantile_cont(dp, 1.0) AS q4 FROM g),
 st AS (SELECT unnest([1, 2, 4])::INT AS stratum),
 gs AS (SELECT CASE WHEN dp < q0 OR dp > q4 THEN NULL WHEN dp <= q1 THEN 1 WHEN dp <= q3 THEN 2 ELSE 4 END AS stratum, avg(coalesce(training_pass, false)::INT) FILTER (bulk_dp >= 11) AS sens FROM g, e GROUP BY 1),
 cs AS (SELECT CASE WHEN dp < q0 OR dp > q4 THEN NULL WHEN dp <= q1 THEN 1 WHEN dp <= q3 THEN 2 ELSE 4 END AS stratum, count(*) FILTER (pass) AS ncalls FROM called, e WHERE NOT training_site GROUP BY 1),
 bs AS (SELECT CASE WHEN sc_dp < q0 OR sc_dp > q4 THEN NULL WHEN sc_dp <= q1 THEN 1 WHEN sc_dp <= q3 THEN 2 ELSE 4 END AS stratum, sum(n) AS bp FROM d2, e WHERE bulk_dp >= 11 GROUP BY 1)
SELECT st.stratum, coalesce(ncalls, 0) AS ncalls, round(sens, 6) AS sens, coalesce(bp, 0)::BIGINT AS callable_bp, round(coalesce(ncalls, 0) / nullif(sens, 0) / nullif(bp, 0) * 1e9 / 2 * 5.845001134, 4) AS burden
FROM st LEFT JOIN gs ON gs.stratum = st.stratum LEFT JOIN cs ON cs.stratum = st.stratum LEFT JOIN bs ON bs.stratum = st.stratum""")
def mutburden(spark, sf_dir):
    """Mutation burden by depth strata."""
    called = stored.written(called_sites(spark, sf_dir).select("dp", "bulk_dp", "training_site", "training_pass", "pass"), "called")  # for quartiles and strata
    depth = aggs.depth_table(view(spark, sf_dir, "depth"))
    out = aggs.mutation_burden(called, depth, min_bulk_dp=11, gbp=5.845001134)
    return out.select("stratum", "ncalls", r6("sens"), "callable_bp", F.round("burden", 4).alias("burden"))


# ---- sweeps and statistics

TARGETS = [0.001, 0.01, 0.05, 0.1, 0.2]


@query(f"WITH {_CALLED}, t AS (SELECT unnest([0.001, 0.01, 0.05, 0.1, 0.2])::DOUBLE AS target) SELECT target, muttype, count(*) FILTER (somatic_candidate AND static_filter AND lysis_fdr <= target AND mda_fdr <= target) AS n_pass FROM called, t GROUP BY target, muttype")
def fdr_sweep(spark, sf_dir):
    """Calls at several target rates, in one pass over the sites."""
    ok = F.col("somatic_candidate") & F.col("static_filter")
    each = tested(spark, sf_dir).groupBy("muttype").agg(*[F.count_if(ok & (F.col("lysis_fdr") <= t) & (F.col("mda_fdr") <= t)).alias(str(k)) for k, t in enumerate(TARGETS)])
    long = each.select("muttype", F.posexplode(F.array(*[F.col(str(k)) for k in range(len(TARGETS))])).alias("k", "n_pass"))
    return long.select(F.element_at(F.lit(TARGETS), F.col("k") + 1).alias("target"), "muttype", "n_pass")


@query(f"WITH {_CALLED}, g AS (SELECT a.a::INT AS min_sc_dp, b.b::INT AS max_bulk_alt FROM (SELECT unnest([6, 10, 20]) AS a) a, (SELECT unnest([0, 1, 2]) AS b) b) SELECT min_sc_dp, max_bulk_alt, count(*) FILTER (dp >= min_sc_dp AND balt <= max_bulk_alt) AS n FROM called, g GROUP BY min_sc_dp, max_bulk_alt")
def param_grid(spark, sf_dir):
    """Sites that pass two thresholds, over the grid of their values: counted by the two columns first."""
    small = tested(spark, sf_dir).groupBy("dp", "balt").agg(F.count("*").alias("m"))
    grid = joins.parameter_grid(spark, min_sc_dp=[6, 10, 20], max_bulk_alt=[0, 1, 2])
    passed = F.when((F.col("dp") >= F.col("min_sc_dp")) & (F.col("balt") <= F.col("max_bulk_alt")), F.col("m")).otherwise(0)
    return small.join(F.broadcast(grid)).groupBy("min_sc_dp", "max_bulk_alt").agg(F.sum(passed).alias("n"))


@query("WITH c AS (SELECT concat(l_returnflag, l_linestatus) AS sample, CASE WHEN l_linenumber % 2 = 0 THEN 'snv' ELSE 'indel' END AS muttype, count(*)::DOUBLE AS calls, sum(l_quantity) * 1e5 AS bp FROM lineitem GROUP BY 1, 2), w AS (SELECT *, least(calls, bp / 1e6 * CASE muttype WHEN 'snv' THEN 0.01313788 ELSE 0.0007298824 END) AS fps FROM c) SELECT sample, muttype, 'calls' AS metric, round(calls, 6) AS value FROM w UNION ALL SELECT sample, muttype, 'fps', round(fps, 6) FROM w UNION ALL SELECT sample, muttype, 'fdr', round(fps / nullif(calls, 0), 6) FROM w")
def callstats_long(spark, sf_dir):
    """Calls and expected false positives of each sample, one metric a row."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("sample"), F.when(F.col("l_linenumber") % 2 == 0, "snv").otherwise("indel").alias("muttype")).agg(F.count("*").alias("calls"), (F.sum("l_quantity").cast("double") * 1e5).alias("bp"))
    return aggs.call_statistics(c, {"snv": 0.01313788, "indel": 0.0007298824}).withColumn("value", F.round("value", 6))


@query("WITH v AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS x FROM lineitem) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, trunc(254 * (x - 900) / 110000.0::DOUBLE)::INT AS q, round(trunc(254 * (x - 900) / 110000.0::DOUBLE) / 254 * 110000.0::DOUBLE + 900, 4) AS back FROM v")
def quantize_roundtrip(spark, sf_dir):
    """A number in one byte and back."""
    x = F.col("l_extendedprice").cast("double")
    q = exprs.quantise(x, 900.0, 110900.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", q.alias("q"), F.round(exprs.unquantise(q, 900.0, 110900.0), 4).alias("back"))


@query(f"WITH {duck_scored()} SELECT round(round_even(af, 3), 6) AS value, count(*) AS n FROM scored WHERE af IS NOT NULL GROUP BY 1")
def approx_hist(spark, sf_dir):
    """A histogram of rounded allele fractions."""
    return aggs.rounded_histogram(scored(spark, sf_dir), "af").select(r6("value"), "n")


@query(f"WITH {duck_scored()}, h AS (SELECT round_even(af, 3) AS v, count(*) AS n FROM scored WHERE af IS NOT NULL GROUP BY 1) SELECT round(i / 63.0::DOUBLE, 6) AS x, round(sum(n * exp(-0.5 * pow((i / 63.0::DOUBLE - v) / 0.02, 2))) / (0.02 * 2.5066282746310002) / (SELECT sum(n) FROM h), 6) AS density FROM h, range(0, 64) t(i) GROUP BY i")
def kde_grid(spark, sf_dir):
    """A kernel density of allele fractions from their histogram."""
    h = aggs.rounded_histogram(scored(spark, sf_dir), "af")
    return aggs.density(h, points=64).select(r6("x"), r6("density"))


@query("SELECT min(o_totalprice)::DOUBLE AS low, max(o_totalprice)::DOUBLE AS high, min(o_custkey) AS low_key, max(o_custkey) AS high_key FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) x")
def topk_bounds(spark, sf_dir):
    """Bounds of the 50 best rows: a top-k report."""
    best = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
    return best.agg(F.min("o_totalprice").cast("double").alias("low"), F.max("o_totalprice").cast("double").alias("high"), F.min("o_custkey").alias("low_key"), F.max("o_custkey").alias("high_key"))


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x WHERE rn <= 5")
def group_head(spark, sf_dir):
    """The first five of each group: a top-k report."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.row_number().over(w).alias("rn")).where("rn <= 5").drop("rn")


@query(f"WITH {duck_scored()} SELECT round(id_score, 6) AS id_score, round(hs_score, 6) AS hs_score, count(*) AS n FROM scored WHERE training_site GROUP BY 1, 2")
def cigar_points(spark, sf_dir):
    """Null points of the two scores: the training sites."""
    s = scored(spark, sf_dir).where("training_site")
    return s.groupBy(r6("id_score"), r6("hs_score")).agg(F.count("*").alias("n"))


@query(f"""WITH {duck_scored()}, p AS (SELECT round(id_score, 6) AS x, round(hs_score, 6) AS y, count(*) AS m FROM scored WHERE training_site GROUP BY 1, 2), t AS (SELECT sum(m) AS t FROM p)
SELECT a.x, a.y, round(sum(CASE WHEN b.x >= a.x AND b.y >= a.y THEN b.m ELSE 0 END) / any_value(t), 6) AS tail FROM p a, p b, t GROUP BY a.x, a.y""")
def cigar_tail(spark, sf_dir):
    """The empirical tail of two scores over all training sites, by sums over the grid of their values."""
    return tails.dominance(scored(spark, sf_dir).where("training_site").select(r6("id_score", "x"), r6("hs_score", "y")), "x", "y").select("x", "y", r6("tail"))


_RATES = "{d}, c AS (SELECT *, id_n_bulk / nullif(cigar_dp_bulk::DOUBLE, 0) AS id_x, id_n / nullif(cigar_dp::DOUBLE, 0) AS id_y, hs_n_bulk / nullif(cigar_dp_bulk::DOUBLE, 0) AS hs_x, hs_n / nullif(cigar_dp::DOUBLE, 0) AS hs_y FROM scored)".format(d=duck_scored())


@query(f"WITH {_RATES} SELECT chr, pos, refnt, altnt, round(id_x, 6) AS id_x, round(id_y, 6) AS id_y, round(hs_x, 6) AS hs_x, round(hs_y, 6) AS hs_y FROM c")
def cigar_rates(spark, sf_dir):
    """Read operations a read of the cell and the bulk."""
    return tails.cigar_rates(scored(spark, sf_dir)).select(*SITE_KEY, r6("id_x"), r6("id_y"), r6("hs_x"), r6("hs_y"))


_EXCESS = ", ".join(
    f"""{k}_n AS (SELECT muttype, {k}_x AS x, {k}_y AS y, count(*) AS m FROM c WHERE training_site GROUP BY ALL), {k}_a AS (SELECT DISTINCT muttype, {k}_x AS x, {k}_y AS y FROM c),
 {k}_s AS (SELECT a.muttype, a.x, a.y, sum(CASE WHEN n.x >= a.x AND n.y >= a.y THEN m ELSE 0 END) / nullif(sum(CASE WHEN (n.x >= a.x AND n.y >= a.y) IS NOT NULL THEN m ELSE 0 END), 0) AS s FROM {k}_a a JOIN {k}_n n ON a.muttype = n.muttype GROUP BY a.muttype, a.x, a.y)"""
    for k in ("id", "hs")
)


@query(f"WITH {_RATES}, {_EXCESS} SELECT chr, pos, refnt, altnt, round(i.s, 6) AS id_score, round(h.s, 6) AS hs_score FROM c LEFT JOIN id_s i ON c.muttype = i.muttype AND id_x IS NOT DISTINCT FROM i.x AND id_y IS NOT DISTINCT FROM i.y LEFT JOIN hs_s h ON c.muttype = h.muttype AND hs_x IS NOT DISTINCT FROM h.x AND hs_y IS NOT DISTINCT FROM h.y")
def cigar_excess(spark, sf_dir):
    """The share of training sites of the type with as many read operations in cell and bulk."""
    s = stored.written(tails.cigar_rates(scored(spark, sf_dir)).select(*SITE_KEY, "muttype", "training_site", "id_x", "id_y", "hs_x", "hs_y"), "rates")
    return tails.excess_scores(s, s.where("training_site")).select(*SITE_KEY, r6("id_score"), r6("hs_score"))


_NUMBER = "CASE WHEN {c} IS NULL THEN '.' WHEN isinf({c}) THEN 'Inf' ELSE printf('%.4f', round({c}, 4)) END"
_LOG = "CASE WHEN {c} = 0 THEN 'inf'::DOUBLE ELSE -log10({c}) END"


def _n(c: str) -> str:
    return _NUMBER.format(c=c)


@query(f"""WITH {_CALLED}, x AS (SELECT *, concat_ws(';', {_REASONS}) AS why, CASE WHEN dp % 5 > 0 THEN (dp % 20 + 1) / 21.0::DOUBLE END AS ab, (dp % 7) / 10.0::DOUBLE AS gp_sd, {_LOG.format(c='abc_pv')} AS abc, {_LOG.format(c='lysis_fdr')} AS paa, {_LOG.format(c='mda_fdr')} AS aa FROM called)
SELECT concat_ws(chr(9), chr, pos::VARCHAR, dbsnp, refnt, altnt, '.', CASE WHEN why = '' THEN '.' ELSE why END, concat('MSC=', coalesce(mutsig, '.'), ';BALT_LOWMQ=', coalesce(balt_lowmq::VARCHAR, '.'), CASE WHEN dbsnp <> '.' THEN ';DB' ELSE '' END, CASE WHEN training_site THEN ';TS' ELSE '' END),
 'GT:DP:AD:AF:AB:ABSD:ABC:PAA:AA:GQ:SC', concat_ws(':', CASE WHEN pass THEN '0/1' ELSE './.' END, dp, concat(scref, ',', scalt), {_n('af')}, {_n('ab')}, {_n('gp_sd')}, {_n('abc')}, {_n('paa')}, {_n('aa')}, CASE WHEN paa IS NULL OR aa IS NULL THEN '.' ELSE {_n('least(paa, aa)')} END, somatic_candidate::INT),
 concat_ws(':', coalesce(phased_gt, bulk_gt), bulk_dp, concat(bref, ',', balt), {_n('bulk_af')}, '.:.:.:.:.:.:.')) AS line FROM x""")
def vcf_lines(spark, sf_dir):
    """All sites as lines of a VCF, with reasons, INFO and the fields of cell and bulk."""
    ab = F.when(F.col("dp") % 5 > 0, (F.col("dp") % 20 + 1) / F.lit(21.0))
    return vcf.lines(called_sites(spark, sf_dir).withColumns({"ab": ab, "gp_sd": (F.col("dp") % 7) / F.lit(10.0)}))


@query(f"WITH {duck('site')} SELECT chr, pos, refnt, altnt, round(1 / (1 + exp(-((dp - 25) / 10.0::DOUBLE))), 6) AS ab, round(1 / (1 + exp(-((dp - 25) / 10.0::DOUBLE - 2 * (bulk_dp / 40.0::DOUBLE)))), 6) AS ab_low, round(1 / (1 + exp(-((dp - 25) / 10.0::DOUBLE + 2 * (bulk_dp / 40.0::DOUBLE)))), 6) AS ab_high FROM site_v")
def balance_tube(spark, sf_dir):
    """The allele balance with two deviations on either side."""
    s = view(spark, sf_dir, "site").withColumns({"gp_mu": (F.col("dp") - 25) / F.lit(10.0), "gp_sd": F.col("bulk_dp") / F.lit(40.0)})
    return s.select(*SITE_KEY, *[F.round(c, 6).alias(n) for c, n in zip(allele_balance.tube(), ("ab", "ab_low", "ab_high"), strict=True)])


@query(f"WITH {duck('bins')}, t AS (SELECT (cnt * 37) % 100 / 100.0::DOUBLE AS a, (cnt * 17) % 100 / 100.0::DOUBLE AS b, cnt % 5 AS p, cnt % 3 AS q, cnt % 2 = 0 AS h FROM bins_v) SELECT h AS held_out, round((a + b) / 2, 6) AS pred, p + q AS npass, p + q + 2 AS ntotal, q AS ncalls FROM t")
def type_allele_tiles(spark, sf_dir):
    """Tiles of one type with both alleles put together."""
    cnt = F.col("cnt")
    wide = {"pred_snv_maj": (cnt * 37) % 100 / F.lit(100.0), "pred_snv_min": (cnt * 17) % 100 / F.lit(100.0), "snv_npass_maj": cnt % 5, "snv_npass_min": cnt % 3, "snv_ntotal_maj": cnt % 5 + 1, "snv_ntotal_min": cnt % 3 + 1, "snv_ncalls_maj": cnt % 3, "snv_ncalls_min": F.lit(0), "held_out": cnt % 2 == 0}
    got = filters.by_type_and_allele(view(spark, sf_dir, "bins").withColumns(wide), "snv")
    return got.select("held_out", r6("pred"), "npass", "ntotal", "ncalls")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 25 = 22 THEN 'X' WHEN s_suppkey % 25 > 22 THEN NULL ELSE CAST(s_suppkey % 25 + 1 AS VARCHAR) END AS contig, CASE WHEN s_suppkey % 25 > 22 THEN NULL ELSE (s_suppkey % 25 + 1)::INT END AS ord FROM supplier")
def contig_order(spark, sf_dir):
    """Ordinals of chromosomes from a small table."""
    names = [(str(k), k) for k in range(1, 23)] + [("X", 23)]
    order = spark.createDataFrame(names, "contig string, ord int")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 25 + 1).cast("int").alias("ord"))
    return s.join(F.broadcast(order), "ord", "left").select("s_suppkey", "contig", F.when(F.col("contig").isNotNull(), F.col("ord")).alias("ord")).orderBy("ord", "s_suppkey")
