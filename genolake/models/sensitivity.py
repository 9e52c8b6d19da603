"""Sensitivity of tiles by type and allele: four binomial models fitted together, a pass over the tiles a round."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import intervals, windows
from ..sources import stored

TYPES, ALLELES = ("snv", "indel"), ("maj", "min")
GROUPS = [f"{t}_{a}" for t in TYPES for a in ALLELES]


def covariates(tiles: DataFrame, called: DataFrame, neighbourhood: int = 10) -> DataFrame:
    """The tiles with the counts that the models need, of each type: training sites (<type>_ntotal), those that would be called
    (<type>_npass) and calls (<type>_ncalls), each also by allele (_maj from a fraction of a half, _min below), and training sites
    and calls in the neighbourhood (<type>_nbhd, <type>_calls_nbhd).

    called: chr, pos, muttype, af, training_site, training_pass, pass.  One join by
    bins for all counts.  The neighbourhood is ``neighbourhood`` tiles on either side,
    NULL near the ends of a chromosome.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    side = {"": F.lit(True), "_maj": F.coalesce(F.col("af") >= 0.5, F.lit(False)), "_min": F.coalesce(F.col("af") < 0.5, F.lit(False))}
    kinds = {"ntotal": yes("training_site"), "npass": yes("training_site") & yes("training_pass"), "ncalls": yes("pass")}
    counts = {f"{t}_{k}{a}": (F.col("muttype") == t) & has & on for t in TYPES for k, has in kinds.items() for a, on in side.items()}
    found = intervals.overlap_counts(tiles, called.where(yes("training_site") | yes("pass")), counts)
    out = tiles.join(found, ["chr", "start", "end_"])
    for t in TYPES:
        out = windows.rolling_sum(out, f"{t}_ntotal", neighbourhood, name=f"{t}_nbhd")
        out = windows.rolling_sum(out, f"{t}_ncalls", neighbourhood, name=f"{t}_calls_nbhd")
    return out


def prepared(tiles: DataFrame, sex: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Tiles with held_out (a hashed half), norm_sc_dp (the standardised logarithm of mean_sc_dp, NULL for 0) and is_<chromosome> for each sex chromosome."""
    out = windows.standardise(tiles, "mean_sc_dp", "norm_sc_dp").withColumn("held_out", exprs.uniform(seed, F.col("chr"), F.col("start")) >= 0.5)
    return out.withColumns({f"is_{c}": (F.col("chr") == c).cast("double") for c in sex}) if sex else out


def terms(muttype: str, sex: Sequence[str] = ()) -> dict[str, Column]:
    """The covariates of a type's models, by name."""
    names = [f"bases_gt_{muttype}_sc_min_dp", f"bases_gt_{muttype}_bulk_min_dp", f"{muttype}_nbhd", "gp_sd", "mean_sc_dp", "norm_sc_dp", *(f"is_{c}" for c in sex)]
    return {"abs_gp_mu": F.abs("gp_mu"), **{n: F.col(n) for n in names}}


def independent(gram: np.ndarray, tolerance: float = 1e-7) -> list[int]:
    """Columns that aren't sums of those before them, from the products of all columns."""
    kept: list[int] = []
    for k in range(len(gram)):
        rest = gram[k, k]
        if kept:
            g = gram[np.ix_(kept, kept)]
            rest -= gram[k, kept] @ np.linalg.lstsq(g, gram[kept, k], rcond=None)[0]
        if gram[k, k] > 0 and rest > tolerance * tolerance * gram[k, k] and rest > 1e-9 * gram[k, k]:
            kept.append(k)
    return kept


def models(tiles: DataFrame, sex: Sequence[str] = (), groups: Sequence[str] = GROUPS, rounds: int = 25, tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """The tiles with pred_<type>_<allele> for each group, and (model, term, estimate, std_error, z).

    tiles: the columns of ``prepared`` and of ``terms``, and <type>_npass_<allele>
    and <type>_ntotal_<allele>.  A group's model is a logit of npass of ntotal on
    its type's terms, learned on the tiles not held out.  All groups are fitted by
    the same rounds of reweighted least squares: a round sums products of terms over
    the tiles, a few dozen numbers a group, and the small systems are solved on the
    driver.  Terms are shifted and scaled by their training mean and deviation
    while fitting.  A term that others make up is left out (estimate NULL), and a
    tile that it would matter for has no prediction, as has one with a NULL term.
    """
    spark = tiles.sparkSession
    parts = [tuple(g.rsplit("_", 1)) for g in groups]
    names = {t: list(terms(t, sex)) for t, _ in parts}
    width = 1 + max(map(len, names.values()))
    values = {t: F.array(*[c.cast("double") for c in terms(t, sex).values()]) for t in names}
    known = lambda x: ~F.exists(x, lambda v: v.isNull() | F.isnan(v))
    row = lambda t, a: F.struct(F.lit(f"{t}_{a}").alias("model"), F.col(f"{t}_npass_{a}").cast("double").alias("hits"), F.col(f"{t}_ntotal_{a}").cast("double").alias("total"), values[t].alias("x"))
    train = tiles.where(~F.col("held_out")).select(F.inline(F.array(*[row(t, a) for t, a in parts]))).where(known(F.col("x")) & (F.col("total") > 0) & F.col("hits").isNotNull())
    train = stored.written(train, "training-tiles")

    column = lambda k: F.get("x", F.lit(k))
    moments = train.groupBy("model").agg(*[f(column(k)).alias(f"{n}{k}") for k in range(width - 1) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    centre, scale = {}, {}
    for r in moments.collect():  # a row for each model
        centre[r["model"]] = [r[f"m{k}"] or 0.0 for k in range(width - 1)]
        scale[r["model"]] = [r[f"s{k}"] or 1.0 for k in range(width - 1)]

    def by_model(value) -> Column:
        out = F.lit(None).cast("double")
        for g in centre:
            out = F.when(F.col("model") == g, F.lit(float(value(g)))).otherwise(out)
        return out

    fitted = train.select("model", "hits", "total", *[F.coalesce((column(k) - by_model(lambda g: centre[g][k])) / by_model(lambda g: scale[g][k]), F.lit(0.0)).alias(f"z{k + 1}") for k in range(width - 1)], F.lit(1.0).alias("z0"))
    fitted = stored.written(fitted, "scaled-tiles")
    pairs = [(i, j) for i in range(width) for j in range(i, width)]

    def products(weight: Column, response: Column | None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        w = fitted.withColumn("_w", weight)
        w = w if response is None else w.withColumn("_r", response)
        aggs = [F.sum(F.col("_w") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"p{i}_{j}") for i, j in pairs] + ([F.sum(F.col("_r") * F.col(f"z{i}")).alias(f"r{i}") for i in range(width)] if response is not None else [])
        out = {}
        for r in w.groupBy("model").agg(*aggs).collect():  # a row for each model
            gram = np.zeros((width, width))
            for i, j in pairs:
                gram[i, j] = gram[j, i] = r[f"p{i}_{j}"]
            out[r["model"]] = gram, np.array([r[f"r{i}"] for i in range(width)]) if response is not None else np.zeros(width)
        return out

    plain = products(F.lit(1.0), None)
    kept = {g: independent(gram) for g, (gram, _) in plain.items()}
    beta = {g: np.zeros(width) for g in plain}
    covariance: dict[str, np.ndarray] = {}
    moving = set(plain)
    for _ in range(rounds):
        if not moving:
            break
        eta = sum((by_model(lambda g, k=k: beta[g][k]) * F.col(f"z{k}") for k in range(width)), F.lit(0.0))
        p = exprs.logistic(eta)
        for g, (gram, rest) in products(F.col("total") * p * (1 - p), F.col("hits") - F.col("total") * p).items():
            k = kept[g]
            inner = gram[np.ix_(k, k)]
            covariance[g] = np.linalg.pinv(inner)
            if g in moving:
                step = np.linalg.lstsq(inner, rest[k], rcond=None)[0]
                beta[g][k] += step
                if np.abs(step).max() < tolerance:
                    moving.discard(g)

    rows, out = [], tiles
    for g, (t, _) in zip(groups, parts, strict=True):
        if g not in plain:  # no training tile
            rows += [(g, n, None, None, None) for n in ("intercept", *names[t])]
            out = out.withColumn(f"pred_{g}", F.lit(None).cast("double"))
            continue
        gram, k = plain[g][0], kept[g]
        # back from scaled terms: b / s each, and the intercept takes the shifts
        back = np.eye(width)
        for j in range(1, width):
            back[j, j] = 1 / scale[g][j - 1]
            back[0, j] = -centre[g][j - 1] / scale[g][j - 1]
        own, spread = back @ beta[g], np.zeros((width, width))
        spread[np.ix_(k, k)] = covariance[g]
        error = np.sqrt(np.maximum(0.0, np.diag(back @ spread @ back.T)))
        for j, n in enumerate(("intercept", *names[t])):
            fine = j in k
            rows.append((g, n, float(own[j]) if fine else None, float(error[j]) if fine else None, float(own[j] / error[j]) if fine and error[j] > 0 else None))
        x = values[t]
        z = [F.lit(1.0), *[(F.get(x, F.lit(j)) - centre[g][j]) / scale[g][j] for j in range(width - 1)]]
        score = sum((float(beta[g][j]) * z[j] for j in k), F.lit(0.0))
        estimable = known(x)
        for j in sorted(set(range(1, width)) - set(k)):  # the tile agrees with what the training tiles say about the term
            along = np.linalg.lstsq(gram[np.ix_(k, k)], gram[k, j], rcond=None)[0]
            estimable = estimable & (F.abs(z[j] - sum((float(c) * z[i] for c, i in zip(along, k, strict=True)), F.lit(0.0))) < 1e-6)
        out = out.withColumn(f"pred_{g}", F.when(estimable, exprs.logistic(score)))
    return out, spark.createDataFrame(rows, "model string, term string, estimate double, std_error double, z double")


def assessed(tiles: DataFrame, digits: int = 2) -> DataFrame:
    """(model, stratum, hits, total, n, rate) over held-out tiles by rounded prediction: how well predictions tell the measured rates."""
    row = lambda t, a: F.struct(F.lit(f"{t}_{a}").alias("model"), F.bround(f"pred_{t}_{a}", digits).alias("stratum"), F.col(f"{t}_npass_{a}").alias("hits"), F.col(f"{t}_ntotal_{a}").alias("total"))
    each = tiles.where("held_out").select(F.inline(F.array(*[row(t, a) for t in TYPES for a in ALLELES]))).where("stratum is not null")
    got = each.groupBy("model", "stratum").agg(F.sum("hits").alias("hits"), F.sum("total").alias("total"), F.count("*").alias("n"))
    return got.withColumn("rate", exprs.div(F.col("hits").cast("double"), F.col("total")))
