"""Numeric kernels against brute force, simulation or closed forms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from genolake.models import allele_balance, gauss_hermite, priors, regression, sampling, segments, tails
from genolake.plans import queries_models
from genolake.plans.adapters import scored


def test_read_probabilities():
    for d, mu, sd, factor in ((0, 0.0, 1.0, 1), (12, 0.3, 0.8, 1), (30, -1.0, 0.5, 2)):
        p = gauss_hermite.read_probabilities(d, mu, sd, factor)
        p = p[0]
        assert p.sum() == pytest.approx(1)
        b = np.linspace(mu - 10 * sd, mu + 10 * sd, 20001)
        w = np.exp(-0.5 * ((b - mu) / sd) ** 2)
        q = 1 / (1 + np.exp(-b)) / factor
        y = d // 3
        assert p[y] == pytest.approx((math.comb(d, y) * q**y * (1 - q) ** (d - y) * w).sum() / w.sum(), rel=1e-6)


def test_p_values(spark):
    t = gauss_hermite.tests(5, 10, 0.0, 0.7)
    assert 0 <= t["lysis_pv"] <= 1 and t["abc_pv"] > 0.5
    df = spark.createDataFrame([(5, 10, 0.0, 0.7), (5, 10, 0.0, 0.7), (None, 10, 0.0, 0.7)], "scalt int, dp int, mu double, sd double")
    got = gauss_hermite.models(df).collect()
    assert len(got) == 3 and sum(r["abc_pv"] is None for r in got) == 1
    assert gauss_hermite.legacy_fdr(0.1, np.array([0.05, 0.2]), np.array([0.5, 0.9]), 1.0, 1.0) == pytest.approx(0.2 / 1.1)


def one_prediction(at, pos, y, d, fit):
    """Newton's method on one window, written out."""
    cov = lambda u, v: np.exp(fit[0] - (u[:, None] - v[None]) ** 2 / fit[1] ** 2) + np.exp(fit[2] - (u[:, None] - v[None]) ** 2 / fit[3] ** 2)
    k, f = cov(pos, pos), np.zeros(len(pos))
    for _ in range(60):
        p = 1 / (1 + np.exp(-f))
        w = d * p * (1 - p)
        f = k @ np.linalg.solve(np.eye(len(pos)) + w[:, None] * k, w * f + y - d * p)
    p = 1 / (1 + np.exp(-f))
    w = d * p * (1 - p)
    near = cov(pos, np.array([at]))[:, 0]
    return near @ (y - d * p), math.sqrt(math.exp(fit[0]) + math.exp(fit[2]) - near @ np.linalg.solve(k + np.diag(1 / w), near))


def test_laplace_recovers_balance():
    rng = np.random.default_rng(3)
    pos = np.sort(rng.choice(50_000, 120, replace=False)).astype(float)
    truth = 1.5 * np.sin(pos / 8000)
    d = np.full(120, 60.0)
    y = rng.binomial(60, 1 / (1 + np.exp(-truth))).astype(float)
    fit = (0.0, 3000.0, 0.0, 9000.0)
    mu, sd = allele_balance.predict(pos[60], pos, y, d, fit)
    assert abs(mu - truth[60]) < 4 * max(sd, 0.1)
    at = np.sort(np.concatenate([pos[::7], pos[:-1:5] + 0.5, [pos[-1] + 2e5, pos[0] - 10]]))
    low, high = allele_balance.window(at, pos, flank=4000, most=9)
    means, deviations = allele_balance.predictions(at, low, high, pos, y, d, fit)
    for j, x in enumerate(at.tolist()):
        k = [i for i in range(120) if abs(pos[i] - x) < 4000 and pos[i] != x or pos[i] == x + 4000]
        k = [i for i in range(120) if pos[i] <= x - 4000][-1:] + k  # one more before the flank
        k = [i for i in k if pos[i] < x][-10:] + [i for i in k if pos[i] > x][:9]
        assert (means[j], deviations[j]) == pytest.approx(one_prediction(x, pos[k], y[k], d[k], fit), rel=1e-4)
    many = allele_balance.log_evidence(pos, y, d, (np.array([0.0, -1.0]), np.array([3000.0, 500.0]), np.array([0.0, -2.0]), np.array([9000.0, 4000.0])))
    assert many[0] == pytest.approx(allele_balance.log_evidence(pos, y, d, fit)[0]) and many[1] == pytest.approx(allele_balance.log_evidence(pos, y, d, (-1.0, 500.0, -2.0, 4000.0))[0])
    assert allele_balance.log_evidence(pos, y, d, fit) > allele_balance.log_evidence(pos, y, d, (-7.0, 100.0, -7.0, 200.0))


def test_evidence_is_taken_at_the_mode_in_few_rounds(monkeypatch):
    """modes are guessed from those before; evidence against Newton's method run on and on."""
    rng = np.random.default_rng(8)
    pos = np.sort(rng.choice(300_000, 60, replace=False)).astype(float)
    d = rng.integers(1, 50, 60).astype(float)
    y = np.floor(d * rng.integers(0, 11, 60) / 10)
    many = allele_balance.draws(120, allele_balance.BOUNDS, 3)
    fit = (many[:, 0], 10 ** many[:, 1], many[:, 2], 10 ** many[:, 3])
    solved, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: solved.append(len(a)) or solve(a, b))
    got = allele_balance.log_evidence(pos, y, d, fit)
    assert sum(solved) <= 3.3 * len(many)
    k = allele_balance.covariance(pos, pos, fit)
    assert np.allclose(allele_balance.covariances(*allele_balance.squares(pos), np.array(fit)), k, rtol=0, atol=1e-13)
    f = np.zeros((len(many), 60))
    for _ in range(40):
        p, w, b = allele_balance._shaped(k, d, f)
        g = w * f + y - d * p
        a = g - np.sqrt(w) * solve(b, (np.sqrt(w) * (k @ g[..., None])[..., 0])[..., None])[..., 0]
        f = (k @ a[..., None])[..., 0]
    plain = -0.5 * (a * f).sum(axis=1) + (y * f - d * np.logaddexp(0, f)).sum(axis=1) - 0.5 * np.linalg.slogdet(allele_balance._shaped(k, d, f)[2])[1] + allele_balance.choices(y, d)
    assert np.abs(got - plain).max() < 5e-4


def test_guesses_that_lead_nowhere_are_left(monkeypatch):
    rng = np.random.default_rng(9)
    pos = np.arange(20.0) * 500
    d = np.full(20, 30.0)
    y = rng.binomial(30, 0.9, 20).astype(float)
    fit = (np.linspace(-3, 2, 24), 900.0, -2.0, 20_000.0)
    want = allele_balance.log_evidence(pos, y, d, fit)
    monkeypatch.setattr(allele_balance.Guess, "modes", lambda self, first, end: None if first == 0 else np.full((end - first, 20), 1e6))
    assert allele_balance.log_evidence(pos, y, d, fit) == pytest.approx(want, abs=5e-4)


def test_positions_share_a_factored_matrix(monkeypatch):
    """Positions with the same training sites are right sides of one matrix, and have what each has alone."""
    rng = np.random.default_rng(4)
    pos = np.append(np.sort(rng.choice(1000, 20, replace=False)), [9000]).astype(float)
    d = rng.integers(5, 30, 21).astype(float)
    y = rng.binomial(d.astype(int), 0.4).astype(float)
    at, fit = np.arange(2000.0, 2300.0), (0.0, 3000.0, -1.0, 60_000.0)
    low, high = allele_balance.window(at, pos)
    alone = [allele_balance.predict(x, pos, y, d, fit) for x in at[::37]]
    solved, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda b, x: solved.append(len(b)) or solve(b, x))
    mu, sd = allele_balance.predictions(at, low, high, pos, y, d, fit)
    assert sum(solved) < 100
    assert np.stack([mu, sd], axis=1)[::37] == pytest.approx(np.array(alone))


def test_estimates_in_bare_stretches(spark):
    """Sites far from all training sites are judged by the last before them, or by the first of all; blocks agree with the whole chromosome."""
    rng = np.random.default_rng(12)
    pos = np.sort(rng.choice(60_000, 25, replace=False)) + 40_000
    pos = np.append(pos[(pos < 60_000) | (pos > 85_000)], 180_000)
    d = rng.integers(5, 30, len(pos))
    y = rng.binomial(d, 0.4)
    at = np.unique(np.concatenate([rng.choice(250_000, 60), pos[::4], [1, 70_000, 249_999]]))
    fit = (0.0, 3000.0, -1.0, 60_000.0)
    train = spark.createDataFrame([("1", int(p), int(a), int(b)) for p, a, b in zip(pos, y, d, strict=True)] + [("2", 50, 3, 9)], "chr string, pos int, hap1 int, dp int")
    sites = spark.createDataFrame([("1", int(p)) for p in at] + [("2", 50), ("2", 99_999), ("3", 5)], "chr string, pos int")
    fits = spark.createDataFrame([(c, *fit) for c in "123"], "chr string, a double, b double, c double, d double")
    low, high = allele_balance.window(at.astype(float), pos.astype(float), 5000, 150)
    assert ((high - low) >= 1).all()
    mu, sd = allele_balance.predictions(at.astype(float), low, high, pos.astype(float), y.astype(float), d.astype(float), fit)
    assert not np.isnan(mu).any()
    got = {(r["chr"], r["pos"]): (r["gp_mu"], r["gp_sd"]) for r in allele_balance.estimates(sites, train, fits, flank=5000).collect()}
    for p, m, s in zip(at.tolist(), mu, sd, strict=True):
        assert got["1", p] == pytest.approx((m, s), rel=1e-6, abs=1e-9), p
    assert got["2", 50] == (None, None) and got["2", 99_999][0] is not None and got["3", 5] == (None, None)


def test_exact_multinomial():
    g, s = np.array([5.0, 3.0, 2.0]), np.array([3, 2, 2])
    rng = np.random.default_rng(1)
    seen = (rng.multinomial(4, g / g.sum(), 200_000) <= s).all(axis=1).mean()
    assert priors.fits_under(4, g, s) == pytest.approx(seen, abs=0.005)
    assert priors.burden(g, np.zeros(3)) == (0, 0)
    low, high = priors.burden(g, np.array([30, 20, 10]))
    assert 0 < low <= high <= 60


def test_regressions(spark):
    rng = np.random.default_rng(2)
    strata = pd.DataFrame({"stratum": np.linspace(0.1, 0.9, 9), "n": 200})
    strata["hits"] = rng.poisson(0.7 * strata["n"] * strata["stratum"])
    assert regression.poisson_burden(strata) == pytest.approx(0.7, rel=0.1)
    assert regression.negative_binomial_burden(strata)[0] == pytest.approx(0.7, rel=0.1)
    x = np.linspace(0, 1, 200)
    assert np.abs(regression.smoothed(x, np.full(200, 3.0), np.where(np.arange(200) == 50, 0.0, 3.0), np.where(np.arange(200) == 50, 40, 2 * x), 0.3) - 2 * x).max() < 1e-9
    gc = rng.uniform(0.3, 0.6, 3000).round(3)
    cnt = (2 ** (8 + 4 * gc + rng.normal(0, 0.05, 3000))).astype(int)
    cnt[::300] = 90_000  # outliers
    bins = spark.createDataFrame([("1", k, k, int(c), float(g)) for k, (c, g) in enumerate(zip(cnt, gc, strict=True))] + [("1", 9000, 9000, 50, None)], "chr string, start int, end_ int, cnt long, gc double")
    got = regression.gc_correct(bins).toPandas().sort_values("start")
    fine = np.arange(3000) % 300 != 0
    assert np.abs(np.polyfit(gc[fine], np.log2(got["ratio_gcnorm"].to_numpy(float)[:3000][fine]), 1)[0]) < 0.05 and math.isnan(got["ratio_gcnorm"].iloc[-1])
    table = pd.DataFrame({"pred": [0.2, 0.5, 0.9], "sens": [0.2, 0.5, 0.9], "ntotal": 10, "n": [1000, 2000, 3000], "ncalls": [20, 100, 270]})
    sims = regression.simulated_burden(table)
    assert sims["burden"] == pytest.approx(100 + 200 + 300, rel=0.03) and sims["low99"] < sims["low95"] < sims["median"] < sims["high95"] < sims["high99"]
    assert regression.mean_rate_burden(table) == pytest.approx(600) and regression.loglinear_burden(table.assign(ncalls=0)) == 0
    size, slope = table["n"].to_numpy(float), np.exp(-5 + 2 * table["sens"].to_numpy(float))
    assert regression.loglinear_burden(table.assign(ncalls=size * slope)) == pytest.approx(np.exp(-3) * 6000, rel=1e-6)
    both = regression.compare_burdens({"maj": table, "min": table, "both": table}, 512.0, 1000).set_index("estimator")
    assert both.loc["mean", "equal"] == pytest.approx(1200) and both.loc["original", "both"] == 512 and len(both) == 5
    rows = [("1", k, float(v), int(rng.binomial(20, 1 / (1 + math.exp(-(0.5 + 1.2 * v))))), 20) for k, v in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame([*rows, ("1", 9999, None, 1, 20)], "chr string, start int, x double, hits int, total int")
    pred, coef = regression.sensitivity_model(df, ["x"])
    assert coef["x"] == pytest.approx(1.2, abs=0.2) and pred.count() == 601 and pred.where("pred is null").count() == 1


def test_segments_over_tasks_are_the_local_ones(spark):
    """Cuts of several chromosomes by rounds of tasks, and whether an arc is reached, against the plain code; outliers, gaps and empty chromosomes."""
    rng = np.random.default_rng(21)
    how = segments.Preset(0.05, 120, 1.0, 7)
    plans = {"1": [(70, 0.0), (30, 1.2), (50, 0.0), (12, -1.5), (40, 0.2)], "2": [(90, 0.3)], "3": [(7, 0.0)], "4": [(25, 0.0), (25, 2.0)]}
    x = {c: np.concatenate([rng.normal(m, 0.3, n) for n, m in plan]) for c, plan in plans.items()}
    for c in "14":
        v = x[c]
        z = segments.best_arc(v, 5)[0]
        for near in (z * 0.999, z, z * 1.001, 0.1, 99.0):
            assert segments.reaches(v, near, 5) == (segments.best_arc(v, 5)[0] >= near)
    rows = [(c, 10 * k + 1, 10 * k + 10, float(v)) for c, y in x.items() for k, v in enumerate(y)] + [("1", 5001, 5010, None), ("2", 5001, 5010, float("nan")), ("5", 1, 10, float("inf"))]
    got = {(r["chr"], r["start"]): r for r in segments.segment(spark.createDataFrame(rows, "chr string, start int, end_ int, v double").repartition(3), "v", how).collect()}
    assert len(got) == len(rows) and all(got[k]["seg"] is None and got[k]["seg_mean"] is None for k in (("1", 5001), ("2", 5001), ("5", 1)))
    for c, y in x.items():
        y = segments.smooth(y)
        cuts = segments.undone(y, segments.split(y, alpha=how.alpha, permutations=how.permutations, least=how.least, seed=how.seed, name=c), how.undo_sd)
        seg = np.searchsorted(cuts, np.arange(len(y)), "right")
        assert [got[c, 10 * k + 1]["seg"] for k in range(len(y))] == seg.tolist()
        assert [got[c, 10 * k + 1]["seg_mean"] for k in range(len(y))] == pytest.approx([y[seg == s].mean() for s in seg])
    assert {got["1", 10 * k + 1]["seg"] for k in (0, 80, 120, 155)} == {1, 2, 3, 4}
    assert segments.segment(spark.createDataFrame([], "chr string, start int, end_ int, v double"), "v", how).count() == 0


def test_segments():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.2, 60), rng.normal(2, 0.2, 40), rng.normal(0, 0.2, 60)])
    assert segments.split(x, permutations=200) == [0, 60, 100]
    total = np.append(0, np.cumsum(x - x.mean()))
    z = {(i, j): abs(total[j] - total[i]) / (x.std() * np.sqrt((j - i) * (160 - j + i) / 160)) for i in range(160) for j in range(i + 1, 161) if j - i < 160}
    assert segments.best_arc(x)[0] == pytest.approx(max(z.values())) and segments.best_arc(x)[1:] == max(z, key=z.get)
    fine = {k: v for k, v in z.items() if all(n == 0 or n >= 5 for n in (k[0], k[1] - k[0], 160 - k[1])) and 160 - k[1] + k[0] >= 5}
    assert segments.best_arc(x, 5)[1:] == max(fine, key=fine.get)
    noise = rng.normal(0, 0.3, 20_000)
    assert segments.trimmed_sd(noise) == pytest.approx(0.3, rel=0.03)
    spiked = x.copy()
    spiked[30] = 9.0
    assert segments.smooth(spiked)[30] < 1 and (segments.smooth(spiked)[np.arange(160) != 30] == spiked[np.arange(160) != 30]).all()
    assert segments.undone(x, [0, 30, 60, 100, 120], 3.0) == [0, 60, 100]
    assert {p.permutations for p in segments.PRESETS.values()} == {1000, 10_000}


def test_sampling(spark):
    regions = spark.createDataFrame([("1", 11, 20), ("1", 101, 110), ("2", 1, 20)], "chr string, start int, end_ int")
    got = sampling.positions(spark, regions, 4000, 1).toPandas()
    assert len(got) == 4000 and got.groupby("chr").size().to_dict()["2"] == pytest.approx(2000, abs=200)
    inside = ((got["chr"] == "1") & (got["pos"].between(11, 20) | got["pos"].between(101, 110))) | ((got["chr"] == "2") & got["pos"].between(1, 20))
    assert inside.all()
    assert sampling.homogeneity(np.array([50, 50]), np.array([0.5, 0.5]), 5000) > 0.5 > 0.01 > sampling.homogeneity(np.array([90, 10]), np.array([0.5, 0.5]), 5000)
    assert abs(sampling.correlation_effect(0.9, 10)) < 0.9 and sampling.corrected_correlation(sampling.correlation_effect(0.6, 30), 30) == pytest.approx(0.6, abs=0.1)


def test_permutations_solve_all_sets(spark, sf_dir):
    many = [("a", 30_000), ("b", 1), ("c", 700)]
    got = {r["channel"]: r["n"] for r in sampling.draws(spark, many, 3, 8).groupBy("channel").agg(F.count("*").alias("n")).collect()}
    assert all(got[c] >= 3 * n for c, n in many) and sampling.draws(spark, [], 3, 8).count() == 0
    calls = scored(spark, sf_dir).where("muttype = 'snv' and scalt >= 30").count()
    found = queries_models.placed_sites(spark, sf_dir).groupBy("perm_id").agg(F.count("*").alias("n")).collect()
    assert len(found) == queries_models.SETS == 1000 and {r["n"] for r in found} == {calls}
    inside = queries_models._real_calls(spark, sf_dir, queries_models._sequence(spark, sf_dir)).where("channel is not null").count()
    found = queries_models.permuted_sites(spark, sf_dir).groupBy("perm_id").agg(F.count("*").alias("n")).collect()
    assert len(found) == 1000 and {r["n"] for r in found} == {inside} and inside > 0


def test_ab_fit_takes_all_tiles(spark, sf_dir, monkeypatch):
    import inspect

    asked = {k: p.default for k, p in inspect.signature(allele_balance.fit).parameters.items() if k != "training"}
    assert (asked["steps"], asked["samples"]) == (4, 20_000)
    monkeypatch.setattr(allele_balance, "fit", lambda training, **options: asked.update(options, rows=training.count()))
    queries_models.ab_fit(spark, sf_dir)
    assert (asked["tiles"], asked["tile"], asked["best"]) == (250, 100, 50) and asked["rows"] == scored(spark, sf_dir).where("training_site and muttype = 'snv'").count()


def test_narrow_search_finds_what_a_wide_one_does(spark):
    """Seven steps of 1,200 draws against the best of 20,000 draws over the whole bounds."""
    rng = np.random.default_rng(12)
    pos = np.sort(rng.choice(400_000, 40, replace=False))
    f = np.cumsum(rng.normal(0, 0.4, 40))
    n = rng.integers(10, 60, 40)
    y = rng.binomial(n, 1 / (1 + np.exp(-f)))
    rows = spark.createDataFrame([("1", int(p), int(a), int(b)) for p, a, b in zip(pos, y, n, strict=True)], "chr string, pos int, hap1 int, dp int")
    best = allele_balance.fit(rows, steps=7, samples=1200).first()["logp"]
    wide = allele_balance.draws(20_000, allele_balance.BOUNDS, 5)
    plain = allele_balance.log_evidence(pos.astype(float), y.astype(float), n.astype(float), (wide[:, 0], 10 ** wide[:, 1], wide[:, 2], 10 ** wide[:, 3])).max()
    assert best >= plain - 0.01, (best, plain)


def test_gp_predict_estimates_all_sites(spark, sf_dir):
    got = queries_models.gp_predict(spark, sf_dir).select("chr", "pos")
    asked = scored(spark, sf_dir).select("chr", "pos").distinct()
    assert got.count() == asked.count() and asked.exceptAll(got).count() == 0


def test_dominance(spark):
    pts = [(0.1, 0.2), (0.1, 0.2), (0.5, 0.1), (0.9, 0.9), (None, 1.0)]
    got = {(r["x"], r["y"]): r["tail"] for r in tails.dominance(spark.createDataFrame(pts, "x double, y double"), "x", "y").collect()}
    full = [p for p in pts if p[0] is not None]
    assert got == {p: sum(a >= p[0] and b >= p[1] for a, b in full) / len(full) for p in set(full)}


def test_excess_scores(spark):
    rng = np.random.default_rng(4)
    value = lambda n: [None if rng.random() < 0.1 else round(float(v), 2) for v in rng.random(n) * 1.4]
    rows = list(zip([("snv", "indel")[k % 2] for k in range(400)], value(400), value(400), value(400), value(400), rng.integers(0, 3, 400).tolist(), strict=True))
    df = spark.createDataFrame([(k, *r, 5) for k, r in enumerate(rows)], "k int, muttype string, id_x double, id_y double, hs_x double, hs_y double, cigar_dp int, cigar_dp_bulk int")
    null = df.where("k % 3 = 0")

    def brute(one, mine):
        seen = []
        for x, y in mine:
            parts = [None if None in (a, b) else a >= b for a, b in ((x, one[0]), (y, one[1]))]
            if False in parts or None not in parts:
                seen.append(all(parts))
        return sum(seen) / len(seen) if seen else None

    for zero in (False, True):
        got = {r["k"]: r for r in tails.excess_scores(df, null, zero_depth=zero).collect()}
        assert len(got) == 400
        for k, r in enumerate(rows):
            for name, at in (("id", 1), ("hs", 3)):
                expected = 0.0 if zero and r[5] == 0 else brute(r[at : at + 2], [q[at : at + 2] for j, q in enumerate(rows) if j % 3 == 0 and q[0] == r[0]])
                assert got[k][f"{name}_score"] == pytest.approx(expected), (k, name)
    cuts = tails.score_cutoffs(tails.excess_scores(null, null), {"snv": (0.05, 0.5), "none": (0.1, 0.1)})
    scores = [got[k]["hs_score"] for k in range(0, 400, 3) if rows[k][0] == "snv"]
    plain = [brute(r[3:5], [q[3:5] for j, q in enumerate(rows) if j % 3 == 0 and q[0] == "snv"]) for k, r in enumerate(rows) if k % 3 == 0 and r[0] == "snv"]
    assert set(cuts) == {"snv"} and cuts["snv"][1] == pytest.approx(np.quantile([s for s in plain if s is not None], 0.5)) and len(scores) == len(plain)
    rated = tails.cigar_rates(spark.createDataFrame([(1, 2, 10, 3, 4, 0)], "id_n int, hs_n int, cigar_dp int, id_n_bulk int, hs_n_bulk int, cigar_dp_bulk int")).first()
    assert (rated["id_y"], rated["hs_y"], rated["id_x"], rated["hs_x"]) == (0.1, 0.2, None, None)


def test_indel_sets(spark):
    from genolake.functions import channels

    rng = np.random.default_rng(8)
    text = "".join(rng.choice(list("ACGT"), 5000))
    text = text[:2000] + "N" * 100 + text[2100:]
    sequence = spark.createDataFrame([("1", k, text[k * 500 : k * 500 + 600]) for k in range(10)], "chr string, chunk_id int, seq string")
    placed = spark.range(4000).select(F.col("id").alias("i"), F.lit("1").alias("chr"), (F.col("id") % 4800 + 40).cast("int").alias("pos"))
    got = sampling.indels(placed, sequence, chunk=500, shares=(0.4, 0.3))
    rows = got.withColumn("channel", channels.indel(F.col("refnt"), F.col("altnt"), F.col("right"), F.col("left"))).collect()
    assert len(rows) > 3000 and all("N" not in r["refnt"] + r["altnt"] for r in rows)
    for r in rows:
        at = r["pos"] - 1
        assert text[at : at + len(r["refnt"])] == r["refnt"] and r["altnt"][0] == r["refnt"][0] and 1 in (len(r["refnt"]), len(r["altnt"]))
        assert text[at + len(r["refnt"]) :].startswith(r["right"]) and text[: at + 1].endswith(r["left"])
    known = {r["channel"] for r in channels.indels(spark).collect()}
    assert {r["channel"] for r in rows} - {None} <= known and sum(r["channel"] is None for r in rows) == 0
    sizes = np.array([len(r["refnt"]) - 1 for r in rows if len(r["refnt"]) > 1])
    assert sizes.mean() == pytest.approx(4, abs=0.2)
    one = spark.createDataFrame([(p, "1", 10 * p + k, "x", 5) for p in range(3) for k in range(2)], "perm_id int, chr string, pos int, channel string, seed int")
    assert sampling.joined_sets([one, one.withColumn("seed", F.lit(6))]).select("perm_id").distinct().count() == 6
    with pytest.raises(ValueError, match="twice"):
        sampling.joined_sets([one, one])
    both = one.withColumn("sample", F.lit("a")).union(one.withColumn("sample", F.lit("b")))
    assert sampling.combined(both).count() == 12
    with pytest.raises(ValueError, match="differ"):
        sampling.combined(both.where("sample = 'a' or perm_id < 2"))


def test_cell_from_counts_to_burden(spark, sf_dir):
    """The chain's calls and burden, worked out again from the columns of its table."""
    from genolake.config import Config
    from genolake.plans import pipeline

    cell = queries_models.cell_sites(spark, sf_dir)
    results = pipeline.run_cell(cell, queries_models._fits(spark), queries_models.view(spark, sf_dir, "depth"), Config("bulk", ("cell",)), 5.8, bins=queries_models.view(spark, sf_dir, "bins"))
    t = results["called"].toPandas()
    assert len(t) == cell.count() and t["id_score"].notna().mean() > 0.8 and t["lysis_fdr"].notna().mean() > 0.5
    static = (t["id_test"] & t["hs_test"] & t["lowmq_test"] & t["dp_test"] & t["abc_test"] & t["sc_alt_test"] & t["bulk_alt_test"] & t["bulk_af_test"] & t["bulk_binom_test"] & t["dbsnp_test"] & t["panel_test"] & t["artifact_test"]).fillna(False).astype(bool)
    assert (t["pass"] == (t["somatic_candidate"] & static & (t["lysis_fdr"] <= 0.01) & (t["mda_fdr"] <= 0.01))).all()
    for kind in ("lysis", "mda"):
        rate = t[f"{kind}_pv"] * t["na"] / (t[f"{kind}_pv"] * t["na"] + t[f"{kind}_beta"] * t["nt"])
        assert np.allclose(rate.dropna(), t[f"{kind}_fdr"][rate.notna()].astype(float))
    snv = t[t["muttype"] == "snv"]
    edges = np.quantile(snv.loc[snv["training_site"], "dp"], [0, 0.25, 0.5, 0.75, 1])
    got = {(r["muttype"], r["stratum"]): r for r in results["burden"].collect()}
    inside = snv[(snv["dp"] > edges[1]) & (snv["dp"] <= edges[3])]
    if got["snv", 2]["reason"] is None:
        deep = inside[inside["training_site"] & (inside["bulk_dp"] >= 11)]
        assert got["snv", 2]["ncalls"] == (inside["pass"] & ~inside["training_site"]).sum() and got["snv", 2]["sens"] == pytest.approx(deep["training_pass"].eq(True).mean())
    assert len(got) == 6 and results["segments"].count() > 0 and results["mapd"].first()["mapd"] is not None and results["reasons"].count() > 1
    assert results["tests"].first()["dp_test"]["yes"] == t["dp_test"].sum() and results["ab"].agg(F.sum("n")).first()[0] == (t["training_site"] & t["ab"].notna()).sum()
    calls = pipeline.all_calls({"b": results["called"].withColumn("rescue", F.lit(False)), "a": results["called"].withColumn("rescue", F.lit(False))}, "any", ["snv"])
    assert calls.count() == 2 * (t["pass"] & (t["muttype"] == "snv")).sum() and results["analyzable"].first()["snv"] > 0


def test_pipeline(spark):
    from genolake.config import Config
    from genolake.plans import pipeline

    rng = np.random.default_rng(0)
    rows = []
    for k in range(150):
        het = k % 2 == 0
        a = int(rng.binomial(30, 0.5)) if het else (12 if k % 5 == 0 else 0)
        rows.append(("1", 100 + 50 * k, "A", "C", ".", "cell", "0/1", 30 - a, a))
        rows.append(("1", 100 + 50 * k, "A", "C", ".", "bulk", "0/1" if het else "0/0", 20 if not het else 10, 10 if het else 0))
    counts = spark.createDataFrame(rows, "chr string, pos int, refnt string, altnt string, dbsnp string, sample string, gt string, ref_n int, alt_n int")
    phased = counts.where("sample = 'bulk' and gt = '0/1'").selectExpr("chr", "pos", "refnt", "altnt", "'0|1' as phased_gt")
    config = Config("bulk", ("cell",))
    sites = pipeline.integrate(counts, config, phased=phased)
    assert sites.count() == 150 and sites.where("training_site").count() == 75 and sites.where("somatic_candidate").count() == 15
    fits = spark.createDataFrame([("1", -1.0, 1000.0, -1.0, 20000.0)], "chr string, a double, b double, c double, d double")
    called = pipeline.analyse(pipeline.for_cell(sites, counts, "cell"), fits, config).cache()
    assert called.count() == 150 and called.where("lysis_fdr is not null").count() > 100
    assert "snv: 150 sites" in pipeline.report(called)
    with pytest.raises(ValueError, match="missing"):
        pipeline.require(sites, ["nothing"])


def test_models_are_worked_out_once(spark, sf_dir):
    """What comes after the models reads a table: their Python tasks aren't in its plan."""
    from genolake.config import Config
    from genolake.plans import pipeline

    cell = queries_models.cell_sites(spark, sf_dir).where("chr = 'chr1'")
    plan = pipeline.analyse(cell, queries_models._fits(spark), Config("bulk", ("cell",)), stages=("ab", "models"))._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "FlatMapGroupsInPandas" not in plan


@pytest.mark.parametrize("d", [0, 1, 7, 60, 250])
def test_read_probabilities_by_powers(d):
    """Powers give what logarithms do, far out as well, where a fraction is 1 to the last digit."""
    mu, sd = np.array([0.0, -3.1, 2.4, 40.0, -30.0]), np.array([0.0, 1.5, 0.2, 1.0, 0.5])
    got = gauss_hermite.read_probabilities(d, mu, sd)
    assert np.isfinite(got).all() and got.sum(axis=1) == pytest.approx(np.ones(5))
    x, w = gauss_hermite.nodes()
    for k in range(5):
        b = math.sqrt(2) * sd[k] * x + mu[k]
        each = [sum(wi * math.exp(math.lgamma(d + 1) - math.lgamma(y + 1) - math.lgamma(d - y + 1) - y * np.logaddexp(0, -bi) - (d - y) * np.logaddexp(0, bi)) for bi, wi in zip(b, w, strict=True)) / math.sqrt(math.pi) for y in range(d + 1)]
        assert got[k] == pytest.approx(np.array(each), rel=1e-6, abs=1e-12)
