"""Rescue over many cells and the four sensitivity models, against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from genolake.models import rescue, sensitivity
from genolake.operators import filters

CHANNELS = [("snv", c) for c in "abcd"] + [("indel", c) for c in "xyz"]


def least_squares(a, b):
    """Non-negative, of two columns, by trying all sides."""
    best = None
    for keep in ([0, 1], [0], [1], []):
        w = np.zeros(2)
        if keep:
            w[keep] = np.linalg.lstsq(a[:, keep], b, rcond=None)[0]
        if (w >= 0).all():
            e = ((a @ w - b) ** 2).sum()
            best = (e, w) if best is None or e < best[0] - 1e-15 else best
    return best[1]


@pytest.fixture(scope="module")
def cells(spark):
    rng, rows = np.random.default_rng(6), []
    for k in range(900):
        kind = "snv" if rng.random() < 0.8 else "indel"
        channel = rng.choice([c for t, c in CHANNELS if t == kind], p=[0.5, 0.3, 0.2, 0.0] if kind == "snv" else [0.2, 0.3, 0.5])
        what = rng.random()
        passed = bool(what < 0.3 and kind == "snv")
        lysis = 0.001 if passed else 0.3 if what < 0.8 else 0.9
        rows.append((f"s{rng.integers(4)}", k, kind, str(channel), passed, bool(rng.random() < 0.95), lysis, 0.001, float(rng.random() / 50), float(rng.random()), float(1 + rng.integers(9)), float(1 + rng.integers(5))))
    df = spark.createDataFrame(rows, "sample string, pos int, muttype string, channel string, pass boolean, static_filter boolean, lysis_fdr double, mda_fdr double, lysis_pv double, lysis_beta double, nt double, na double")
    return df.withColumns({t: F.lit(True) for t in filters.LABELS}), rows


def test_batch_is_each_cell_with_the_spectrum_of_all(spark, cells):
    df, rows = cells
    art = {c: v for (_, c), v in zip(CHANNELS, [0.1, 0.2, 0.3, 0.4, 0.2, 0.3, 0.5], strict=True)}
    artifact = spark.createDataFrame([(t, c, art[c]) for t, c in CHANNELS], "muttype string, channel string, artifact_sig double")
    got = rescue.batch(df, artifact, rescue_fdr=0.02)
    kept = [r for r in rows if r[5] and r[6] <= 0.5]
    snv = [c for t, c in CHANNELS if t == "snv"]
    calls = [r[3] for r in kept if r[4]]
    true = np.array([calls.count(c) for c in snv]) / len(calls)
    assert {(r["muttype"], r["channel"]): r["true_sig"] for r in got["true"].collect()} == pytest.approx(dict(zip([("snv", c) for c in snv], true, strict=True)))
    want = {}
    for s in {r[0] for r in kept}:
        own = [r for r in kept if r[0] == s and r[2] == "snv" and not r[4]]
        share = np.array([sum(r[3] == c for r in own) for c in snv]) / len(own)
        w = least_squares(np.column_stack([true, [art[c] for c in snv]]), share) + 0.001
        for r in own:
            j = snv.index(r[3])
            weight = true[j] * w[0] / (art[r[3]] * w[1])
            want[r[1]] = r[8] / (r[8] + r[9] * weight * r[10] / r[11])
    sites = {r["pos"]: r for r in got["sites"].collect()}
    assert sorted(sites) == sorted(r[1] for r in kept)
    for k, r in sites.items():
        if k in want:
            assert r["rescue_fdr"] == pytest.approx(want[k], rel=1e-9) and r["rescue"] == (want[k] <= 0.02)
        else:  # calls, and a type that has no calls in any cell
            assert r["rescue_fdr"] is None and not r["rescue"]
    assert 0 < sum(r["rescue"] for r in sites.values()) < len(want)
    tests = got["tests"].collect()
    assert sorted(r["sample"] for r in tests) == [f"s{k}" for k in range(4)] and all(0 <= r["p"] <= r["holm"] <= r["bonferroni"] <= 1 for r in tests)


def test_batch_with_other_signatures(spark, cells):
    df, _ = cells
    artifact = spark.createDataFrame([(t, c, 0.25) for t, c in CHANNELS], "muttype string, channel string, artifact_sig double")
    extra = spark.createDataFrame([("indel", "x")] * 3 + [("indel", "z"), ("indel", None)], "muttype string, channel string")
    true = {r["channel"]: r["true_sig"] for r in rescue.batch(df, artifact, extra=extra)["true"].where("muttype = 'indel'").collect()}
    assert true == {"x": 0.75, "y": 0.0, "z": 0.25}
    given = spark.createDataFrame([("snv", "a", 1.0)], "muttype string, channel string, true_sig double")
    weights = rescue.batch(df, artifact, true=given)["weights"].select("muttype", "channel", F.col("weight") > 0).distinct().collect()
    assert sorted(map(tuple, weights)) == [("snv", c, c == "a") for c in "abcd"]
    none = rescue.batch(df.withColumn("pass", F.lit(False)), artifact)
    assert none["sites"].where("rescue or rescue_fdr is not null").count() == 0 and none["tests"].count() == 0 and none["weights"].count() == 0


def logit_fit(x, hits, total):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        gram = (x.T * (total * p * (1 - p))) @ x
        beta = beta + np.linalg.solve(gram, x.T @ (hits - total * p))
    return beta, np.sqrt(np.diag(np.linalg.inv(gram)))


def test_four_models_are_those_of_numpy(spark):
    rng, n = np.random.default_rng(9), 1500
    cols = {"gp_mu": rng.normal(0, 1, n), "gp_sd": rng.uniform(0.2, 2, n), "mean_sc_dp": rng.gamma(3, 8, n)}
    for t in sensitivity.TYPES:
        cols |= {f"bases_gt_{t}_sc_min_dp": rng.integers(0, 1000, n).astype(float), f"bases_gt_{t}_bulk_min_dp": rng.integers(0, 1000, n).astype(float), f"{t}_nbhd": rng.integers(0, 40, n).astype(float)}
        for a in sensitivity.ALLELES:
            total = rng.integers(0, 6, n)
            p = 1 / (1 + np.exp(-(0.5 - cols["gp_sd"] + 0.002 * cols[f"bases_gt_{t}_sc_min_dp"])))
            cols |= {f"{t}_ntotal_{a}": total, f"{t}_npass_{a}": rng.binomial(total, p)}
    cols["indel_nbhd"] = 2 * cols["bases_gt_indel_sc_min_dp"] + 3 * np.abs(cols["gp_mu"])  # made up of others
    chrom = np.where(np.arange(n) % 5 == 0, "X", np.where(np.arange(n) % 97 == 1, "Y", "1"))
    names = list(cols)
    rows = [(str(chrom[k]), k * 1000 + 1, *[v[k].item() for v in cols.values()]) for k in range(n)]
    df = spark.createDataFrame(rows, ["chr", "start", *names]).withColumn("gp_mu", F.when(F.col("start") != 7001, F.col("gp_mu")))
    tiles = sensitivity.prepared(df, ["X", "Y"]).withColumn("held_out", F.col("held_out") | (F.col("chr") == "Y")).cache()
    out, coefficients = sensitivity.models(tiles, ["X", "Y"])
    t = out.toPandas().sort_values("start").reset_index(drop=True)
    found = {(r["model"], r["term"]): r for r in coefficients.collect()}
    assert abs(t["norm_sc_dp"].mean()) < 1e-9 and 0.4 < t.loc[t["chr"] != "Y", "held_out"].mean() < 0.6
    for g in sensitivity.GROUPS:
        kind = g.split("_")[0]
        terms = list(sensitivity.terms(kind, ["X", "Y"]))
        used = [c for c in terms if c != "is_Y" and not (kind == "indel" and c == "indel_nbhd")]
        x = np.column_stack([np.ones(n), *[np.abs(t["gp_mu"]) if c == "abs_gp_mu" else t[c].astype(float) for c in used]])
        allele = g.split("_")[1]
        total, hits = t[f"{kind}_ntotal_{allele}"].to_numpy(float), t[f"{kind}_npass_{allele}"].to_numpy(float)
        fine = ~t["held_out"].to_numpy(bool) & (total > 0) & ~np.isnan(x).any(axis=1)
        beta, error = logit_fit(x[fine], hits[fine], total[fine])
        assert [found[g, c]["estimate"] for c in ("intercept", *used)] == pytest.approx(beta.tolist(), rel=1e-5, abs=1e-8)
        assert [found[g, c]["std_error"] for c in ("intercept", *used)] == pytest.approx(error.tolist(), rel=1e-4)
        assert found[g, "is_Y"]["estimate"] is None  # no training tile is there
        pred = t[f"pred_{g}"].astype(float)
        on_y = (t["chr"] == "Y").to_numpy()
        assert pred[on_y].isna().all() and pred[t["start"] == 7001].isna().all()
        rest = ~on_y & (t["start"] != 7001).to_numpy()
        assert np.allclose(pred[rest], (1 / (1 + np.exp(-(x @ beta))))[rest], atol=1e-6)
    assert found["indel_maj", "indel_nbhd"]["estimate"] is None


def test_models_without_tiles(spark):
    names = ["gp_mu", "gp_sd", "mean_sc_dp", *[f"bases_gt_{t}_{s}_min_dp" for t in sensitivity.TYPES for s in ("sc", "bulk")], *[f"{t}_nbhd" for t in sensitivity.TYPES], *[f"{t}_{c}_{a}" for t in sensitivity.TYPES for c in ("npass", "ntotal") for a in sensitivity.ALLELES]]
    none = spark.createDataFrame([], "chr string, start int, " + ", ".join(f"{c} double" for c in names))
    out, coefficients = sensitivity.models(sensitivity.prepared(none))
    assert out.count() == 0 and coefficients.where("estimate is null").count() == 4 * 8
