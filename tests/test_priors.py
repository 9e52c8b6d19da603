"""Prior tables by brute force on planted sites, and the ordered pass on dense blocks."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from genolake.models import priors
from genolake.operators import filters, intervals, joins, windows

P = {"snv": filters.Params(), "indel": filters.Params(min_sc_dp=10, use_panel=True)}


def planted(n=4000, seed=3):
    rng, rows = np.random.default_rng(seed), []
    for k in range(n):
        kind = "snv" if rng.random() < 0.7 else "indel"
        dp = int(rng.poisson(22)) if rng.random() < 0.97 else 0
        training = bool(rng.random() < 0.5)
        balance = rng.beta(6, 6) if training or rng.random() < 0.3 else rng.beta(1, 6)
        alt = int(rng.binomial(dp, balance))
        rows.append((k, kind, dp, alt, alt / dp if dp else None, int(rng.integers(5, 40)), training, not training and bool(rng.random() < 0.6)))
    rows += [(n, "snv", None, None, None, 30, False, True), (n + 1, None, 20, 5, 0.25, 30, True, False), (n + 2, "snv", 900, 450, 0.5, 30, True, False), (n + 3, "snv", 901, 300, 1 / 3, None, None, None)]
    return rows


def brute(rows, params):
    out = {}
    for kind, p in params.items():
        own = [r for r in rows if r[1] == kind and r[2] is not None]
        hets = [r for r in own if r[6] and r[3] >= p.min_sc_alt and r[2] >= p.min_sc_dp and r[5] is not None and r[5] >= p.min_bulk_dp]
        cands = [r for r in own if r[7] and r[3] >= p.min_sc_alt and r[2] >= p.min_sc_dp]
        top = int(np.quantile([r[2] for r in hets], 0.8)) if hets else 0
        at = lambda r: (min(r[2], top + 1), max(1, math.ceil(r[4] * 20)) if r[2] else 1)
        g, s = np.zeros((top + 2, 21)), np.zeros((top + 2, 21))
        for r in hets:
            if r[4]:
                g[at(r)] += 1
        for r in cands:
            if r[4] is not None:
                s[at(r)] += 1
        high = [priors.burden(g[d, 1:], s[d, 1:])[1] for d in range(top + 2)]
        for r in own:
            d, b = at(r)
            G, S = g[d].sum(), s[d].sum()
            if r[6] and r[3] >= p.min_sc_alt:
                nt = max((high[d] + 1) * g[d, b] / G, 0.1) if G else 0.1
                na = max(s[d, b] + 1 - nt, 0.1) if G else 0.1
            else:
                nt = max(high[d] * g[d, b] / G, 0.1) if G and S else 0.1
                na = max(s[d, b] - nt, 0.1) if G and S else 0.1
            out[r[0]] = (nt, na)
    return out


def test_priors_are_those_of_the_populations(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "k int, muttype string, dp int, scalt int, af double, bulk_dp int, training_site boolean, somatic_candidate boolean").withColumn("nt", F.lit("old"))
    got = {r["k"]: (r["nt"], r["na"]) for r in priors.assign(df, P).collect()}
    want = brute(rows, P)
    assert len(got) == len(rows) and got[4000] == (None, None)
    for k, pair in want.items():
        assert got[k] == pytest.approx(pair, rel=1e-9), k
    assert len({round(v[0], 6) for v in want.values()}) > 100
    empty = priors.assign(df.limit(0), P)
    assert empty.count() == 0
    none = priors.assign(df.withColumn("training_site", F.lit(False)), P).where("dp is not null")
    assert none.select("nt", "na").distinct().collect() == [(0.1, 0.1)]


def test_exact_fit_of_many():
    """Large numbers neither overflow nor vanish; the probability falls; the exact value of a small case."""
    g, s = np.array([400.0, 250.0, 350.0]), np.array([4400, 2700, 3900])
    p = [priors.fits_under(n, g, s) for n in (9000, 10400, 10700, 10900, 11200)]
    assert p[0] == pytest.approx(1.0) and 1 > p[1] > p[2] > p[3] > 0 and p[4] == 0
    rng = np.random.default_rng(4)
    seen = (rng.multinomial(10700, g / g.sum(), 100_000) <= s).all(axis=1).mean()
    assert p[2] == pytest.approx(seen, abs=0.006)
    assert priors.sizes(1).tolist() == [] and priors.sizes(5).tolist() == [1, 2, 3, 4]
    assert priors.sizes(300)[99:102].tolist() == [100, 101, 101 + 199 / 99] and priors.sizes(300)[-1] < 300


def test_dense_block_is_linear(spark):
    """200,000 rows in one block: nearest, gaps, islands, runs and merged intervals in seconds."""
    n = 200_000
    left = spark.range(n).select(F.lit("1").alias("chr"), (F.col("id") * 5 % (1 << 20)).cast("int").alias("pos"))
    right = spark.range(n).select(F.lit("1").alias("chr"), (F.col("id") * 7 % (1 << 20)).cast("int").alias("pos"))
    began = time.time()
    got = joins.nearest(left, right).agg(F.count("nearest"), F.sum(F.abs(F.col("nearest") - F.col("pos")))).first()
    at, points = np.arange(n) * 5 % (1 << 20), np.unique(np.arange(n) * 7 % (1 << 20))
    j = np.searchsorted(points, at, "right")
    l, r = points[np.maximum(j - 1, 0)], points[np.minimum(j, len(points) - 1)]
    near = np.where(j == 0, r - at, np.minimum(np.abs(at - l), np.abs(r - at)))[j < len(points)]
    assert got[0] == (j < len(points)).sum() and got[1] == near.sum()
    assert windows.nearest_gap(left, ["chr"]).agg(F.count("nearest")).first()[0] == n
    assert intervals.merge(left.select("chr", F.col("pos").alias("start"), (F.col("pos") + 4).alias("end_"))).count() >= 1
    assert time.time() - began < 60


@pytest.mark.parametrize("width", [1, 3, 16, 1000])
def test_blocks_of_any_width_agree(spark, width):
    """Runs, islands, flips and merged intervals that go on over blocks, some of them empty."""
    rng = np.random.default_rng(width)
    rows = [(c, int(p), k, int(rng.integers(2)) if rng.random() < 0.9 else None, float(rng.integers(11)) / 10 if rng.random() < 0.9 else None) for c in "ab" for k, p in enumerate(sorted(rng.choice(400, 60, replace=False)))]
    df = spark.createDataFrame(rows, "chr string, pos int, k int, v int, af double")
    runs, flips = [], {}
    for c in "ab":
        own, first = [r for r in rows if r[0] == c], None
        for i, r in enumerate(own):
            if i == 0 or own[i - 1][3] != r[3]:
                runs.append([c, r[3], 0])
            runs[-1][2] += 1
            b = own[i - 1] if i else None
            if b is None or r[1] - b[1] >= 12 or r[4] is None or b[4] is None or b[4] == 0.5:
                first = r[4]
            flips[c, r[1]] = 1 - r[4] if r[4] is not None and first is not None and np.sign(r[4] - 0.5) * np.sign(first - 0.5) < 0 else r[4]
    got = windows.run_lengths(df, "v", ["pos", "k"], width=width).orderBy("chr", "island").collect()
    assert [[r["chr"], r["v"], r["n"]] for r in got] == runs
    assert {(r["chr"], r["pos"]): r["flipped_af"] for r in windows.flip_phase(df, 12, width=width).collect()} == flips
    spans = [(c, p, p + int(rng.integers(25))) for c, p, *_ in rows]
    merged = []
    for c, a, b in sorted(spans):
        if merged and merged[-1][0] == c and a <= merged[-1][2] + 1:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([c, a, b])
    assert sorted(list(r) for r in intervals.merge(spark.createDataFrame(spans, "chr string, start int, end_ int"), width).select("chr", "start", "end_").collect()) == merged
