"""P-values of read counts: binomial draws whose allele balance is logit-normal, integrated by Gauss-Hermite."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.threads import one_thread


#: Up to this depth binomials are products of powers; probabilities below the second are worked out by logarithms.
POWERS, TINY = 200, 1e-200


@functools.cache
def nodes(n: int = 128) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.hermite.hermgauss(n)


@functools.cache
def _log_choose(d: int) -> np.ndarray:
    return np.array([math.lgamma(d + 1) - math.lgamma(y + 1) - math.lgamma(d - y + 1) for y in range(d + 1)])


def read_probabilities(d: int, mu, sd, factor: float = 1.0) -> np.ndarray:
    """P(Y = y) for y = 0..d where Y ~ Bin(d, 1 / (factor (1 + exp(-b)))) and b ~ N(mu, sd); a row for each mu and sd."""
    x, w = nodes()
    mu, sd = np.atleast_1d(np.asarray(mu, float)), np.atleast_1d(np.asarray(sd, float))
    b = math.sqrt(2) * sd[:, None] * x + mu[:, None]
    log_p = -np.logaddexp(0, -b) - math.log(factor)
    with np.errstate(divide="ignore"):
        log_q = np.maximum(np.log1p(-np.exp(np.minimum(log_p, -1e-300))), -1e300)  # finite, as none of it is 0
    if d > POWERS:
        return _by_logs(d, log_p, log_q)
    # powers by products, a plane for each y: no exponential of a number apart
    p, q = np.exp(log_p), np.exp(log_q)
    planes, rest = np.ones((d + 1, *p.shape)), np.ones(p.shape)
    for y in range(d):
        np.multiply(planes[y], p, out=planes[y + 1])
    for y in range(d - 1, -1, -1):
        rest *= q
        planes[y] *= rest
    out = (planes @ w).T * (np.exp(_log_choose(d)) / math.sqrt(math.pi))
    tiny = np.flatnonzero((out < TINY).any(axis=1))  # powers may have sunk below the least number
    if len(tiny):
        out[tiny] = _by_logs(d, log_p[tiny], log_q[tiny])
    return out


def _by_logs(d: int, log_p: np.ndarray, log_q: np.ndarray) -> np.ndarray:
    y = np.arange(d + 1)[None, :, None]
    return (np.exp(_log_choose(d)[None, :, None] + y * log_p[:, None, :] + (d - y) * log_q[:, None, :]) @ nodes()[1]) / math.sqrt(math.pi)


@functools.lru_cache(maxsize=4)
def thinned(d: int, factor: float) -> np.ndarray:
    """P(Y = y) for Y ~ Bin(x, 1 / factor), a row for each x = 0..d: of x reads each is kept by itself."""
    x, y = np.arange(d + 1)[:, None], np.arange(d + 1)
    log = np.append(0.0, np.cumsum(np.log(np.arange(1.0, d + 1))))
    log = log[x] - log[y] - log[np.maximum(x - y, 0)] - y * math.log(factor) + (x - y) * math.log1p(-1 / factor)
    return np.where(y <= x, np.exp(np.where(y <= x, log, 0.0)), 0.0)


def tables(d: int, mu, sd) -> dict[str, np.ndarray]:
    """Of a mutation, of a change before amplification (half the reads) and of one in amplification (a quarter).

    A read of those two is a read of a mutation that is kept with a half or a quarter,
    and what -mu gives is what mu gives with alleles changed: one table makes all.
    """
    one = read_probabilities(d, mu, sd)
    both = (one + one[:, ::-1]) / 2
    return {"mut": one, "lysis": both @ thinned(d, 2.0), "mda": both @ thinned(d, 4.0)}


def tests(alt, d: int, mu, sd) -> dict[str, np.ndarray]:
    """For each model the probability of outcomes no likelier than the one seen, and what a mutation has of them; a number for each row."""
    t = tables(d, mu, sd)
    alt = np.atleast_1d(np.asarray(alt, int))
    out = {}
    for name, p in t.items():
        reject = p <= np.take_along_axis(p, alt[:, None], axis=1) * (1 + 1e-12)
        out[name] = np.minimum(1.0, (p * reject).sum(axis=1))
        out[f"{name}_beta"] = np.minimum(1.0, (t["mut"] * reject).sum(axis=1))
    return {"abc_pv": out["mut"], "lysis_pv": out["lysis"], "lysis_beta": out["lysis_beta"], "mda_pv": out["mda"], "mda_beta": out["mda_beta"]}


COLUMNS = ("abc_pv", "lysis_pv", "lysis_beta", "mda_pv", "mda_beta")


def models(sites: DataFrame) -> DataFrame:
    """(scalt, dp, mu, sd) with the five columns; sites with equal values are computed once, those of one depth together.  NULL inputs give NULL."""
    keys = ["scalt", "dp", "mu", "sd"]
    unique = sites.select(*keys).distinct().where("scalt is not null and dp is not null and mu is not null and sd is not null and scalt between 0 and dp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        for part in batches:
            alt, depth, mu, sd = (part[k].to_numpy() for k in keys)
            got = np.empty((len(part), len(COLUMNS)))
            for d in np.unique(depth).tolist():
                at = np.flatnonzero(depth == d)
                step = max(1, (1 << 17) // (128 * (d + 1)))  # as much as a core's cache holds
                for k in range(0, len(at), step):
                    some = at[k : k + step]
                    got[some] = np.stack(list(tests(alt[some], int(d), mu[some], sd[some]).values()), axis=1)
            yield pd.concat([part.reset_index(drop=True), pd.DataFrame(got, columns=list(COLUMNS))], axis=1)

    schema = "scalt int, dp int, mu double, sd double, " + ", ".join(f"{c} double" for c in COLUMNS)
    typed = unique.select(F.col("scalt").cast("int"), F.col("dp").cast("int"), F.col("mu").cast("double"), F.col("sd").cast("double"))
    return sites.join(typed.mapInPandas(run, schema), keys, "left")


def legacy_fdr(pv: float, alphas: np.ndarray, betas: np.ndarray, nt: float, na: float) -> float:
    """The least rate over cut-offs that reject no less than the outcome: alpha na / (alpha na + beta nt)."""
    fine = alphas >= pv
    bad, good = alphas[fine] * na, betas[fine] * nt
    total = bad + good
    return float((bad[total > 0] / total[total > 0]).min()) if (total > 0).any() else math.nan
