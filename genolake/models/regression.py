"""Regressions: sensitivity by a binomial model, burdens by Poisson and negative-binomial ones, and local smoothing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs


def sensitivity_model(tiles: DataFrame, covariates: Sequence[str], hits: str = "hits", total: str = "total", seed: int = 1) -> tuple[DataFrame, dict[str, float]]:
    """Adds pred: a logit model of hits of total, learned on the half of tiles that a hash picks (``held_out`` false); and its coefficients.

    Tiles with a NULL covariate have no prediction; constant covariates are left out.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    df = tiles.withColumn("held_out", exprs.uniform(seed, F.col("chr"), F.col("start")) >= 0.5)
    spread = df.where("not held_out").agg(*[F.stddev_samp(c).alias(c) for c in covariates]).first()
    used = [c for c in covariates if spread[c]]
    whole = VectorAssembler(inputCols=used, outputCol="_x", handleInvalid="skip").transform(df)
    train = whole.where(f"not held_out and {total} > 0").select("_x", (F.col(hits) / F.col(total)).alias("_y"), F.col(total).cast("double").alias("_w"))
    model = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="pred").fit(train)
    found = model.transform(whole).select(*tiles.columns, "held_out", "pred")
    missing = df.where(" or ".join(f"{c} is null" for c in used)).withColumn("pred", F.lit(None).cast("double"))
    return found.unionByName(missing.select(*found.columns)), dict(zip(["intercept", *used], [model.intercept, *model.coefficients.toArray().tolist()], strict=True))


def poisson_burden(strata: pd.DataFrame) -> float:
    """The rate at sensitivity 1 of hits in strata (stratum, hits, n): maximum likelihood with mean rate n stratum."""
    size = float((strata["n"] * strata["stratum"]).sum())
    return float(strata["hits"].sum()) / size if size else float("nan")


def negative_binomial_burden(strata: pd.DataFrame, rounds: int = 50) -> tuple[float, float]:
    """Rate and dispersion of hits with mean rate n stratum, by turns: weighted rate, then moments."""
    size, hits = (strata["n"] * strata["stratum"]).to_numpy(float), strata["hits"].to_numpy(float)
    size, hits = size[size > 0], hits[size > 0]
    if not len(size):
        return float("nan"), float("nan")
    rate, alpha = hits.sum() / size.sum(), 0.0
    for _ in range(rounds):
        mean = rate * size
        weight = size / (1 + alpha * mean)
        rate = (weight * hits / size).sum() / weight.sum()
        mean = rate * size
        alpha = max(0.0, float((((hits - mean) ** 2 - mean) / np.maximum(mean**2, 1e-300)).mean()))
    return float(rate), alpha


def simulated_burden(strata: pd.DataFrame, draws: int = 10_000, seed: int = 0) -> dict[str, float]:
    """The number of calls and of missed ones, a negative binomial of each stratum's calls and sensitivity: mean, median and two intervals.

    strata: ncalls, sens, ntotal; those without calls count 0, and those without sensitivity or germline sites are left out.
    """
    rng = np.random.default_rng(seed)
    total = np.zeros(draws)
    for row in strata[(strata["sens"] > 0) & (strata["ntotal"] > 0) & (strata["ncalls"] > 0)].itertuples():
        total += row.ncalls + rng.negative_binomial(row.ncalls, min(1.0, row.sens), draws)
    low, high = np.quantile(total, [0.025, 0.975])
    lowest, highest = np.quantile(total, [0.005, 0.995])
    return {"burden": float(total.mean()), "median": float(np.median(total)), "low95": float(low), "high95": float(high), "low99": float(lowest), "high99": float(highest)}


def mean_rate_burden(strata: pd.DataFrame) -> float:
    """The mean rate of calls a tile over its sensitivity, times all tiles; strata: pred, ncalls, sens, ntotal, n."""
    fine = strata[(strata["pred"] > 0) & (strata["sens"] > 0) & (strata["ntotal"] > 0)]
    return float((fine["ncalls"] / fine["sens"] / fine["n"]).mean() * strata["n"].sum()) if len(fine) else float("nan")


def loglinear_burden(strata: pd.DataFrame, dispersed: bool = False, rounds: int = 100) -> float:
    """exp of the fit of log(calls a tile) on sensitivity, at full sensitivity, times all tiles: Poisson, or negative binomial by moments."""
    fine = strata[(strata["sens"] > 0) & (strata["ntotal"] > 0) & (strata["n"] > 0)]
    hits, size = fine["ncalls"].to_numpy(float), fine["n"].to_numpy(float)
    if not len(fine) or not hits.sum():
        return 0.0 if len(fine) else float("nan")
    x = np.column_stack([np.ones(len(fine)), fine["sens"].to_numpy(float)])
    beta, alpha = np.array([np.log(hits.sum() / size.sum()), 0.0]), 0.0
    for _ in range(rounds):
        mean = size * np.exp(np.clip(x @ beta, -50, 50))
        weight = mean / (1 + alpha * mean)
        step = np.linalg.lstsq((x.T * weight) @ x, x.T @ (weight * (hits - mean) / mean), rcond=None)[0]
        beta = beta + step
        mean = size * np.exp(np.clip(x @ beta, -50, 50))
        if dispersed:
            alpha = max(0.0, float((((hits - mean) ** 2 - mean) / np.maximum(mean**2, 1e-300)).sum() / max(1, len(hits) - 2)))
        if np.abs(step).max() < 1e-10:
            break
    return float(np.exp(beta.sum()) * strata["n"].sum())


def compare_burdens(strata: dict[str, pd.DataFrame], original: float | None = None, draws: int = 10_000) -> pd.DataFrame:
    """(estimator, maj, min, both, equal) of strata by allele: four estimators, twice the major allele's, and a known burden beside them."""
    methods = {"simulated": lambda t: simulated_burden(t, draws)["burden"], "poisson": loglinear_burden, "negative_binomial": lambda t: loglinear_burden(t, True), "mean": mean_rate_burden}
    rows = [{"estimator": "original", "maj": None, "min": None, "both": original, "equal": None}]
    for name, f in methods.items():
        got = {allele: f(table) for allele, table in strata.items()}
        rows.append({"estimator": name, **got, "equal": 2 * got["maj"]})
    return pd.DataFrame(rows)[["estimator", "maj", "min", "both", "equal"]]


def smoothed(x: np.ndarray, n: np.ndarray, weight: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Local lines with tricube weights at ascending values x, of n rows each with total weight and weighted mean y; a line spans the share of rows next to it."""
    k, out = min(n.sum(), max(2, np.ceil(share * n.sum()))), np.empty(len(x))
    for j, at in enumerate(x):
        far = np.abs(x - at)
        order = np.argsort(far, kind="stable")
        reach = far[order][int(np.searchsorted(np.cumsum(n[order]), k))]
        w = np.clip(1 - (far / max(reach * 1.0000001, 1e-12)) ** 3, 0, 1) ** 3 * weight
        total = w.sum()
        if total <= 0:
            out[j] = y[j]
            continue
        mx, my = (w * x).sum() / total, (w * y).sum() / total
        var = (w * (x - mx) ** 2).sum()
        out[j] = my + ((w * (x - mx) * (y - my)).sum() / var * (at - mx) if var > 1e-12 * max(1.0, total) else 0.0)
    return out


def gc_correct(bins: DataFrame, digits: int = 3, share: float = 0.05, rounds: int = 3) -> DataFrame:
    """Adds ratio, (count + 1) over the median, and ratio_gcnorm without its trend over GC.

    The trend is a robust local line over all bins: bins are added up by rounded GC
    (at most 10^digits values come to the driver in each round), with each bin's
    weight by its distance from the last round's trend.  Bins without GC keep no corrected ratio.
    """
    middle = bins.agg(F.median("cnt").alias("m")).scalar()
    df = bins.withColumn("ratio", (F.col("cnt") + 1) / middle)
    known = df.where("gc is not null").select(F.bround("gc", digits).alias("_g"), F.log2("ratio").alias("_y"))
    table = None
    for k in range(rounds + 1):
        weighed = known.withColumn("_w", F.lit(1.0))
        if table is not None:
            rest = known.join(F.broadcast(table), "_g").withColumn("_r", F.abs(F.col("_y") - F.col("_t")))  # a row for each rounded GC
            scale = 6 * rest.agg(F.percentile("_r", 0.5).alias("s")).first()["s"]
            if not scale:
                break
            bisquare = F.greatest(F.lit(0.0), 1 - F.pow(F.col("_r") / scale, F.lit(2.0)))
            weighed = rest.withColumn("_w", bisquare * bisquare)
        means = weighed.groupBy("_g").agg(F.count("*").alias("n"), F.sum("_w").alias("w"), exprs.div(F.sum(F.col("_w") * F.col("_y")), F.sum("_w")).alias("y")).orderBy("_g").toPandas()
        if not len(means):
            return df.withColumn("ratio_gcnorm", F.lit(None).cast("double"))
        trend = smoothed(means["_g"].to_numpy(float), means["n"].to_numpy(float), means["w"].to_numpy(float), means["y"].fillna(0).to_numpy(float), share)
        table = bins.sparkSession.createDataFrame(pd.DataFrame({"_g": means["_g"].astype(float), "_t": trend}), "_g double, _t double")
    joined = df.withColumn("_g", F.bround("gc", digits)).join(F.broadcast(table), "_g", "left")
    return joined.withColumn("ratio_gcnorm", F.pow(F.lit(2.0), F.log2("ratio") - F.col("_t"))).drop("_g", "_t")
