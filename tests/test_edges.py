"""Edge cases of expressions, intervals, windows and filters on literal frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from genolake import config
from genolake.functions import channels, exprs
from genolake.operators import aggs, filters, intervals, joins, windows
from genolake.sources import tabular, vcf


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_zero_depth(spark):
    df = spark.createDataFrame([(0, None), (10, 0.0), (10, 0.05), (10, 0.0500001), (10, 0.5), (10, 1.0)], "dp int, af double")
    assert [r["b"] for r in df.select(exprs.vaf_bin(F.col("af"), F.col("dp")).alias("b")).collect()] == [1, 1, 1, 2, 10, 20]
    assert one(spark, exprs.div(F.lit(1.0), F.lit(0))) is None


def test_binomial_tail(spark):
    for k, n in ((0, 0), (0, 5), (3, 10), (10, 10), (12, 10), (700, 1500)):
        expected = sum(math.comb(n, i) for i in range(min(k, n) + 1)) / 2**n
        assert one(spark, exprs.binomial_half_cdf(F.lit(k), F.lit(n))) == pytest.approx(expected, rel=1e-9)


def test_strings_and_numbers(spark):
    assert one(spark, exprs.reverse_complement(F.lit("AACG"))) == "CGTT"
    assert one(spark, exprs.substitution_channel(F.lit("AGT"), F.lit("A"))) == "ACT:C>T"
    assert one(spark, exprs.substitution_channel(F.lit("ANT"), F.lit("A"))) is None
    assert one(spark, exprs.quantise(F.lit(None).cast("double"), 0, 1)) == 255
    assert one(spark, exprs.unquantise(exprs.quantise(F.lit(0.5), 0.0, 1.0), 0.0, 1.0)) == pytest.approx(0.5, abs=1 / 254)
    assert one(spark, exprs.logistic(F.lit(-1000.0))) == 0 and one(spark, exprs.logistic(F.lit(1000.0))) == 1
    assert one(spark, exprs.interpolate(F.lit(1.5), [1, 2], [10, 20])) == 15 and one(spark, exprs.interpolate(F.lit(9.0), [1, 2], [10, 20])) == 20
    assert one(spark, exprs.least_or_null(F.lit(1), F.lit(None).cast("int"))) is None
    assert 0 <= one(spark, exprs.uniform(3, F.lit("a"))) < 1


def test_merge_adjacent_and_blocks(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 11, 20), ("a", 22, 25), ("b", 5, 6)], "chr string, start int, end_ int")
    for width in (1 << 20, 8):
        assert sorted(map(tuple, intervals.merge(df, width).collect())) == [("a", 1, 20), ("a", 22, 25), ("b", 5, 6)]
    assert intervals.merge(df.limit(0)).count() == 0


def test_merge_random(spark):
    rnd = random.Random(4)
    rows = [("c", s, s + rnd.randrange(30)) for s in (rnd.randrange(2000) for _ in range(150))]
    covered = sorted({p for _, a, b in rows for p in range(a, b + 1)})
    expected, start = [], covered[0]
    for p, q in zip(covered, [*covered[1:], 10**9], strict=True):
        if q != p + 1:
            expected.append(("c", start, p))
            start = q
    assert sorted(map(tuple, intervals.merge(spark.createDataFrame(rows, "chr string, start int, end_ int"), 64).collect())) == expected


def test_nearest_ties_and_edges(spark):
    left = spark.createDataFrame([("a", p) for p in (5, 15, 20, 30, 31)], "chr string, pos int")
    right = spark.createDataFrame([("a", 10), ("a", 20), ("a", 20), ("a", 30)], "chr string, pos int")
    for width in (1 << 20, 7):
        got = {r["pos"]: r["nearest"] for r in joins.nearest(left, right, width=width).collect()}
        assert got == {5: 10, 15: 10, 20: 20, 30: None, 31: None}
    assert {r["pos"]: r["nearest"] for r in joins.nearest(left, right, right_edge="nearest").collect()}[31] == 30


def test_update_join_keeps_rows(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 5), (1, 7)], "k int, v int")
    assert sorted((r["k"], r["v"]) for r in joins.update_join(left, right, ["k"], ["v"], ["v"]).collect()) == [(1, 7), (2, None)]


def test_runs_of_neighbours(spark):
    rows = [("s", "1", p, "A", "C", 3, 3) for p in (100, 101, 102, 200, 300, 301)]
    got = windows.merge_neighbours(spark.createDataFrame(rows, "sample string, chr string, pos int, refnt string, altnt string, scalt int, scref int")).collect()
    assert sorted((r["pos"], r["refnt"], r["muttype"]) for r in got) == [(100, "AAA", "mnv"), (300, "AA", "dnv")]


def test_phase_recurrence(spark):
    rnd = random.Random(1)
    pos, rows = 0, []
    for _ in range(300):
        pos += rnd.choice([10, 50, 9999, 10000, 20000])
        rows.append((pos, rnd.choice([None, 0.5, 0.1, 0.3, 0.7, 0.9])))
    expected, before = {}, None
    for p, af in rows:
        out = af
        if before and af is not None and before[1] is not None and p - before[0] < 10000 and abs(1 - af - before[1]) < abs(af - before[1]) - 1e-12:
            out = 1 - af
        expected[p], before = out, (p, out)
    got = windows.flip_phase(spark.createDataFrame([("1", *r) for r in rows], "chr string, pos int, af double")).collect()
    assert {r["pos"]: r["flipped_af"] for r in got} == pytest.approx(expected)


def test_rolling_edges(spark):
    df = spark.createDataFrame([("1", k, 1) for k in range(30)], "chr string, start int, v int")
    got = windows.rolling_sum(df, "v", 10).collect()
    assert sum(r["nbhd"] is None for r in got) == 19 and all(r["nbhd"] in (None, 20) for r in got)


def test_burden_needs_rows(spark):
    sites = spark.createDataFrame([(k, 20, True, True, False) for k in range(50)] + [(5, 20, False, None, True)], "dp int, bulk_dp int, training_site boolean, training_pass boolean, pass boolean")
    depth = spark.createDataFrame([(5, 20, 100)], "sc_dp int, bulk_dp int, n long")
    out = aggs.mutation_burden(sites, depth, min_bulk_dp=11, gbp=5.8).collect()
    assert len(out) == 3 and all(r["burden"] is None and r["reason"] == "few germline sites" for r in out)
    out = {r["stratum"]: r for r in aggs.mutation_burden(sites, depth, min_bulk_dp=11, gbp=5.8, least=10).collect()}
    assert out[1]["ncalls"] == 1 and out[1]["sens"] == 1 and out[1]["callable_bp"] == 100 and out[1]["burden"] == pytest.approx(1 / 100 * 1e9 / 2 * 5.8) and out[2]["ncalls"] == 0
    flat = aggs.mutation_burden(sites.withColumn("dp", F.lit(7)), depth, min_bulk_dp=11, gbp=5.8, least=10).collect()
    assert all(r["reason"] == "quartiles coincide" for r in flat)
    strata = aggs.mutation_burden(sites, depth, min_bulk_dp=11, gbp=5.8, least=10)
    panel = spark.createDataFrame([(3, 2), (1, 1)], "unique_donors int, unique_cells int")
    assert aggs.reported_burden(strata, "indel", panel).first()["burden"] is None and aggs.reported_burden(strata.withColumn("burden", F.lit(3.5)), "snv", panel).first()["burden"] == 3.5


def test_empty_spectrum(spark):
    chans = spark.createDataFrame([("x",), ("y",)], "channel string")
    got = aggs.spectrum(spark.createDataFrame([], "channel string"), chans).collect()
    assert [(r["n"], r["share"]) for r in got] == [(0, None)] * 2


def test_haploid_training_site(spark):
    assert one(spark, filters.training_site(F.lit("1|1"), F.lit("0/1"), F.lit(True))) is True
    assert one(spark, filters.training_site(F.lit("0|1"), F.lit("0/1"), F.lit(True))) is False
    assert one(spark, filters.training_site(F.lit(None).cast("string"), F.lit("0/1"), F.lit(False))) is False


def test_channels(spark):
    assert channels.substitutions(spark).distinct().count() == 96 and channels.indels(spark).distinct().count() == 83
    df = spark.createDataFrame([("CA", "C", "AAT", "C"), ("C", "CT", "TTG", "C"), ("CAGT", "C", "AGC", "C"), ("CAG", "C", "AGT", "C")], "ref string, alt string, right string, left string")
    got = [r["c"] for r in df.select(channels.indel(F.col("ref"), F.col("alt"), F.col("right"), F.col("left")).alias("c")).collect()]
    assert got == ["1:Del:T:2", "1:Ins:T:2", "3:Del:M:2", "2:Del:R:1"]
    ref = spark.createDataFrame([("1", 0, "ACGTACGTAC" + "GT"), ("1", 1, "GTACGTACGT" + "AC")], "chr string, chunk_id int, seq string")
    sites = spark.createDataFrame([("1", p) for p in (1, 2, 10, 11, 12)], "chr string, pos int")
    assert {r["pos"]: r["ctx"] for r in channels.context(sites, ref, 10).collect()} == {1: None, 2: "ACG", 10: "ACG", 11: "CGT", 12: "GTA"}


def test_text_sources(spark, tmp_path):
    path = tmp_path / "t.tab"
    path.write_text("#old\n#chr\tpos\tdbsnp\trefnt\taltnt\tS1\tref\talt\tS2\tref\talt\n22\t5\t.\tA\tC\t0/1\t3\t4\t0/0\t7\t0\nX\t9\t.\tA\tC\tNA\tNA\t1\t0/0\t7\t0\n")
    long = tabular.read_wide(spark, str(path))
    assert {(r["chr"], r["sample"], r["alt_n"]) for r in long.collect()} == {("22", "S1", 4), ("22", "S2", 0), ("X", "S1", 1), ("X", "S2", 0)}
    assert tabular.read_wide(spark, str(path), region=("17", 1, 10)).count() == 0
    cell = tabular.one_sample(long, "S1").where("chr = '22'").first()
    assert cell["dp"] == 7 and cell["af"] == pytest.approx(4 / 7)
    tabular.write(long, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exists"):
        tabular.write(long, str(tmp_path / "out"))
    assert tabular.duplicates(long, ["chr", "pos"]).count() == 2
    one = tabular.first_rows(long, ["chr", "pos"], ["alt_n"])
    assert one.columns == long.columns and sorted((r["chr"], r["sample"], r["alt_n"]) for r in one.collect()) == [("22", "S2", 0), ("X", "S2", 0)]
    assert [tuple(r) for r in aggs.by_frequency(long, "ref_n").collect()] == [(7, 2), (None, 1), (3, 1)]


def site(**own):
    """A called SNV with all that filters and VCF need."""
    tests = dict.fromkeys(filters.TESTS, True)
    return tests | dict(chr="1", pos=9, refnt="A", altnt="C", dbsnp=".", muttype="snv", mutsig=None, balt_lowmq=None, training_site=False, somatic_candidate=True, dp=10, scref=5, scalt=5, af=0.5, ab=None, gp_sd=0.25, abc_pv=0.1, lysis_fdr=0.001, mda_fdr=0.0,
                        phased_gt=None, bulk_gt="0/0", bulk_dp=20, bref=20, balt=0, bulk_af=0.0, unique_donors=2, unique_cells=3, static_filter=True, **{"pass": True}) | own


SITE = "chr string, pos int, refnt string, altnt string, dbsnp string, muttype string, mutsig string, balt_lowmq int, training_site boolean, somatic_candidate boolean, dp int, scref int, scalt int, af double, ab double, gp_sd double, abc_pv double, lysis_fdr double, mda_fdr double, phased_gt string, bulk_gt string, bulk_dp int, bref int, balt int, bulk_af double, unique_donors int, unique_cells int, static_filter boolean, pass boolean, rescue boolean, " + ", ".join(f"{t} boolean" for t in filters.TESTS)


def sites(spark, *rows):
    names = [c.split()[0] for c in SITE.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SITE)


def test_vcf(spark, tmp_path):
    (tmp_path / "g.fai").write_text("2\t100\t3\t60\t61\n1\t200\t9\t60\t61\n")
    contigs = vcf.contigs(spark, str(tmp_path / "g.fai"))
    assert contigs == [("2", 100), ("1", 200)]
    rows = sites(spark, site(), site(chr="2", pos=5, dbsnp="rs1", training_site=True, mutsig="ACA:C>A", balt_lowmq=3, dp=0, scref=0, scalt=0, af=None, lysis_fdr=None, phased_gt="0|1", bulk_af=None, abc_test=False, panel_test=None, **{"pass": False}))
    vcf.write(rows, str(tmp_path / "v"), contigs, "cell")
    lines = [line for f in sorted((tmp_path / "v").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[0] == "##fileformat=VCFv4.4" and "##contig=<ID=2,length=100>" in lines and lines[-3].startswith("#CHROM\tPOS")
    assert lines[-2] == "2\t5\trs1\tA\tC\t.\tpre.amplification.artifact;abc\tMSC=ACA:C>A;BALT_LOWMQ=3;DB;TS\tGT:DP:AD:AF:AB:ABSD:ABC:PAA:AA:GQ:SC\t./.:0:0,0:.:.:0.2500:1.0000:.:Inf:.:1\t0|1:20:20,0:.:.:.:.:.:.:.:."
    assert lines[-1] == "1\t9\t.\tA\tC\t.\tPASS\tMSC=.;BALT_LOWMQ=.\tGT:DP:AD:AF:AB:ABSD:ABC:PAA:AA:GQ:SC\t0/1:10:5,5:0.5000:.:0.2500:1.0000:3.0000:Inf:3.0000:1\t0/0:20:20,0:0.0000:.:.:.:.:.:.:."
    with pytest.raises(Exception, match="exists"):
        vcf.write(rows, str(tmp_path / "v"), contigs, "cell")


def test_reasons(spark):
    no = {"pass": False}
    rows = [site(), site(**no, rescue=True, lysis_fdr=0.5), site(**no, panel_test=None), site(**no, static_filter=None), site(**no, lysis_fdr=None, mda_fdr=None), site(**no, abc_test=False), site(**no, mda_fdr=None), site(**no, id_test=False, dbsnp_test=False, mda_fdr=0.9, artifact_test=False)]
    df = sites(spark, *rows)
    got = df.select(filters.first_reason(rescue=True).alias("one"), filters.reasons(rescue=True).alias("all")).collect()
    assert [r["one"] for r in got] == ["PASS", "RESCUE", "cross.sample.filter", "hard.filters", "pre.amplification.artifact", "amplification.artifact", None, "amplification.artifact"]
    assert [r["all"] for r in got] == ["PASS", "pre.amplification.artifact;RESCUE", "", "", "pre.amplification.artifact;amplification.artifact", "abc", "amplification.artifact", "amplification.artifact;cigar.id;dbsnp"]


def test_indels_need_cells(spark):
    rows = lambda donors, cells: [site(muttype="indel", unique_donors=donors, unique_cells=c, pos=k) for k, c in enumerate(cells)]
    called = lambda *r: [x["pass"] for x in filters.call(sites(spark, *r)).orderBy("pos").collect()]
    assert called(*rows(2, [1, 3])) == [True, True] and called(*rows(1, [1, 3])) == [True, False]
    assert called(*rows(2, [1, 2])) == [False, False] and called(*rows(None, [None])) == [False] and called(site(unique_donors=None, unique_cells=None)) == [True]
    df = sites(spark, site(mutsig="1:Ins:C:3"), site(mutsig="1:Ins:C:2"), site(bulk_dp=0, bulk_af=None)).withColumns({"bulk_binom_prob": F.lit(0.5), "max_out": F.lit(None).cast("int"), "id_score": F.lit(1.0), "hs_score": F.lit(1.0)})
    got = filters.static_tests(df).collect()
    assert [r["artifact_test"] for r in got] == [False, True, True] and got[2]["dp_test"] is False and got[2]["bulk_af_test"] is None
    assert filters.sweep(df, [3, 1, 3], lambda d, v: d.where(F.col("dp") > v), "least").select("least").distinct().count() == 2


def test_inputs(spark, tmp_path):
    from genolake.sources import inputs

    fixed = [c.split()[0] for c in inputs.INTEGRATED.split(", ")]
    values = dict.fromkeys(fixed, "NA") | dict(chr="1", pos="5", refnt="A", altnt="C", dbsnp=".", muttype="snv", phased_gt="0|1", training_site="true")
    path = tmp_path / "i.tab"
    path.write_text("#" + "\t".join([*fixed, "S1", "ref", "alt", "S2", "ref", "alt"]) + "\n" + "\t".join([values[c] for c in fixed] + ["0/1", "3", "4", "0/0", "9", "1"]) + "\n")
    r = inputs.integrated(spark, str(path), "S2").first()
    assert (r["scref"], r["scalt"], r["dp"], r["hap1"], r["hap2"]) == (9, 1, 10, 9, 1) and inputs.training(spark, str(path), "S1").count() == 1
    with pytest.raises(ValueError, match="no sample"):
        inputs.integrated(spark, str(path), "S3")
    (tmp_path / "d.tab").write_text("#chr\tpos\tA\tB\n1\t7\t3\t8\n")
    assert inputs.depths(spark, str(tmp_path / "d.tab"), "B", "A", coordinates=True).first().asDict() == {"chr": "1", "pos": 7, "sc_dp": 8, "bulk_dp": 3}
    a = spark.createDataFrame([("1", 1, "A", "C"), ("1", 2, "A", "C")], "chr string, pos int, refnt string, altnt string")
    b = a.withColumn("score", F.lit(0.5))
    assert inputs.precomputed(a, b, ["score"]).count() == 2
    for x, y in ((a, b.limit(1)), (a.limit(1), b)):
        with pytest.raises(ValueError, match="not among"):
            inputs.precomputed(x, y, ["score"]).count()
    with pytest.raises(ValueError, match="repeated"):
        inputs.once(a.union(a))
    assert inputs.together([b, b], ["score"]).count() == 4
    with pytest.raises(ValueError, match="differ in score"):
        inputs.together([b, b.withColumn("score", F.lit(0.7))], ["score"])
    cig = spark.createDataFrame([("1", 1, 9, 1, 2, 0, 10)], "chr string, pos int, m int, id int, hs int, other int, dp int")
    got = inputs.with_cigars(a, cig, cig).orderBy("pos").collect()
    assert (got[0]["id_n"], got[0]["hs_n_bulk"], got[0]["cigar_dp"], got[1]["id_n"]) == (1, 2, 10, None)


def test_config():
    c = config.parse("bulk_sample: b\nsc_bams: {x: p}\nsex: male\ntarget_fdr: 0.05\nsnv_min_sc_dp: 9\n")
    assert c.params["snv"].min_sc_dp == 9 and c.params["indel"].min_sc_dp == 6 and c.haploid() == ["X", "Y"]


def test_vcf_line_is_short_code(spark):
    """Numbers of the cell are formatted by one piece of code, missing and infinite ones included."""
    assert str(vcf.record()).count("format_string") <= 2
    df = spark.createDataFrame([(0.5, None, float("nan"), 0.0, 1.0, None)], "af double, ab double, gp_sd double, abc_pv double, lysis_fdr double, mda_fdr double")
    texts = {"chr": "1", "pos": "7", "dbsnp": ".", "refnt": "A", "altnt": "C", "mutsig": "x", "bulk_gt": "0/0"}
    numbers = {c: F.lit(1) for c in ("dp", "scref", "scalt", "bulk_dp", "bref", "balt", "balt_lowmq")}
    flags = {c: F.lit(True) for c in ("pass", "training_site", "somatic_candidate", *filters.TESTS)}
    full = df.withColumns({c: F.lit(v) for c, v in texts.items()} | numbers | flags | {"phased_gt": F.lit(None).cast("string"), "bulk_af": F.lit(0.25)})
    line = vcf.lines(full).first()["line"].split("\t")
    assert line[9].split(":") == ["0/1", "1", "1,1", "0.5000", ".", ".", "Inf", "0.0000", ".", ".", "1"] and line[10].split(":")[3] == "0.2500"
