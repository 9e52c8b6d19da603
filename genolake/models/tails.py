"""Empirical tails of two scores, without pairs of points: a sweep by ranges of both coordinates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs
from ..operators import blocks
from ..sources import stored

#: Blocks of values, for each unit of a score.
BANDS = 4096
#: Ranges of a coordinate at most, and rows of a range that are worth a task.
RANGES, ROWS = 64, 4096


def running(points: DataFrame, by: Sequence[str], value: str, weights: Sequence[str]) -> DataFrame:
    """(by, value, <w>, <w>_below): for each distinct value the weight of its points and of those with a smaller value.

    Points are added up by value first; sums before a block of values come from a row for each block.
    """
    each = points.groupBy(*by, value).agg(*[F.sum(w).alias(w) for w in weights])
    before = blocks.inside(by, value).rowsBetween(Window.unboundedPreceding, -1)
    cut = blocks.passed(
        each, list(by), [{f"{w}_inside": F.sum(w).over(before) for w in weights}], {f"{w}_all": F.sum(w) for w in weights},
        lambda earlier, later: [{f"{w}_done": F.sum(f"{w}_all").over(earlier) for w in weights}], pos=value, width=1 / BANDS)
    return cut.select(*by, value, *weights, *[(F.coalesce(f"{w}_done", F.lit(0)) + F.coalesce(f"{w}_inside", F.lit(0))).alias(f"{w}_below") for w in weights])


def dominating(x: np.ndarray, y: np.ndarray, w: np.ndarray, asked_x: np.ndarray, asked_y: np.ndarray) -> np.ndarray:
    """For each asked pair the weight of the points with both coordinates at least as large.

    All are laid out by falling x.  Blocks of two, four and so on are merged: what
    a point in a left half adds to the pairs of the right half is a running sum by falling y.
    """
    n, m = len(x), len(asked_x)
    order = np.lexsort((np.repeat([0, 1], [n, m]), -np.append(x, asked_x)))
    high = np.unique(-np.append(y, asked_y), return_inverse=True)[1].ravel()[order].astype(np.int64)
    weight = np.append(w, np.zeros(m))[order]
    out, place, step = np.zeros(n + m), np.arange(n + m), 1
    while step < n + m:
        pair, right = place // (2 * step), (place // step) % 2
        by = np.argsort((pair * (n + m) + high) * 2 + right, kind="stable")
        run = np.cumsum(np.where(right[by] == 0, weight[by], 0.0))
        before = np.append(0.0, run)[np.searchsorted(pair[by], pair[by])]
        asked = right[by] == 1
        out[by[asked]] += (run - before)[asked]
        step *= 2
    back = np.empty(n + m)
    back[order] = out
    return np.rint(back[n:]).astype(np.int64)


def _swept(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, x, y, n) of the asked pairs of a written table (by, x, y, w, asked) of distinct pairs without NULLs.

    Both coordinates are cut in ranges.  Points above a pair lie in ranges above
    both of its own (sums of a table of cells), in its range of x (counted in a
    task for each range of x), or else in its range of y (a task for each of those).
    """
    by = list(by)
    many = table.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, min(RANGES, -(-many // ROWS)))
    cuts = F.array(*[F.lit(k / parts) for k in range(1, parts)]) if parts > 1 else None
    edge = lambda c: (F.percentile_approx(c, cuts, 4096) if parts > 1 else F.first(F.array().cast("array<double>"))).alias(f"_{c}_edges")
    edges = table.groupBy(*by).agg(edge("x"), edge("y"))
    at = lambda c: F.size(F.filter(f"_{c}_edges", lambda e: e <= F.col(c))).alias(f"{c}r")
    placed = stored.written(table.join(edges, by).select(*by, "x", "y", "w", "asked", at("x"), at("y")), "placed")
    cells = placed.groupBy(*by, "xr", "yr").agg(F.sum("w").alias("w"))
    range_ = F.sequence(F.lit(0), F.lit(parts - 1))
    grid = edges.select(*by, F.explode(range_).alias("xr")).select(*by, "xr", F.explode(range_).alias("yr")).join(cells, [*by, "xr", "yr"], "left")
    over = lambda along, down: Window.partitionBy(*by, along).orderBy(F.desc(down)).rowsBetween(Window.unboundedPreceding, -1)
    above = grid.withColumn("_right", F.sum("w").over(over("xr", "yr"))).withColumn("_above", F.coalesce(F.sum("_right").over(over("yr", "xr")), F.lit(0)))
    fields = placed.select(*by).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "x double, y double, n long"])

    def counted(own: str):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            points, asked = part[part["w"] > 0], part[part["asked"]]
            ax = asked["x"] if own == "xr" else asked["xr"] + 1
            n = dominating(points["x" if own == "xr" else "xr"].to_numpy(float), points["y"].to_numpy(float), points["w"].to_numpy(float), ax.to_numpy(float), asked["y"].to_numpy(float))
            return asked[[*by, "x", "y"]].assign(n=n)

        return placed.groupBy(*by, own).applyInPandas(run, schema)

    beyond = placed.where("asked").join(above, [*by, "xr", "yr"]).select(*by, "x", "y", F.col("_above").alias("n"))
    return beyond.unionByName(counted("xr")).unionByName(counted("yr")).groupBy(*by, "x", "y").agg(F.sum("n").alias("n"))


def at_least(points: DataFrame, asked: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, x, y, n): for each distinct pair asked the number of points with both coordinates at least as large; NULL coordinates are left out.

    Without a pair of points: see ``_swept``.
    """
    keys = list(by) or ["_all"]
    named = lambda df, w: df.withColumn("_all", F.lit(0)).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(w).alias("w"), F.lit(w == 0).alias("asked")).where("x is not null and y is not null")
    table = named(points, 1).unionByName(named(asked, 0)).groupBy(*keys, "x", "y").agg(F.sum("w").alias("w"), F.max("asked").alias("asked"))
    return _swept(stored.written(table, "pairs"), keys).select(*by, F.col("x").alias(x), F.col("y").alias(y), "n")


def dominance(points: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, tail): for each distinct point the share of points with both coordinates at least as large; NULLs are left out."""
    own = stored.written(points.select(x, y), "points")
    total = own.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count("*").alias("t")).scalar()
    return at_least(own, own, x, y).select(x, y, (F.col("n") / total).alias("tail"))


def cigar_rates(sites: DataFrame) -> DataFrame:
    """Adds id_x, id_y, hs_x and hs_y: insertions and deletions, and clippings, a read of the bulk (x) and the cell (y), from id_n, hs_n, cigar_dp and their _bulk."""
    rate = lambda n, dp: exprs.div(F.col(n).cast("double"), F.col(dp))
    return sites.withColumns({f"{kind}_{axis}": rate(f"{kind}_n{of}", f"cigar_dp{of}") for kind in ("id", "hs") for axis, of in (("x", "_bulk"), ("y", ""))})


def excess_scores(sites: DataFrame, null: DataFrame, by: Sequence[str] = ("muttype",), *, zero_depth: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """Adds id_score and hs_score to sites with the rates: the share of the null sites of their type with both rates at least as large.

    A comparison with a NULL rate is unknown unless the other rate decides it: a
    null site counts if its known rate is smaller, else it is left out; so a site
    that lacks one rate has the score 0, or NULL if no null site is smaller in the
    other, and one that lacks both has NULL.  With ``zero_depth`` sites without
    reads of the cell or the bulk have 0.  ``asked`` has the sites' rates and ``by``
    where that is less to read than the sites.
    """
    by = list(by)
    key = [*by, "kind"]

    def long(df: DataFrame, w: int) -> DataFrame:
        pair = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_x").cast("double").alias("x"), F.col(f"{kind}_y").cast("double").alias("y"))
        return df.select(*by, F.inline(F.array(pair("id"), pair("hs")))).withColumns({"w": F.lit(w), "asked": F.lit(w == 0)})

    # both scores' distinct pairs in one table: sites and null sites are read once each
    pairs = stored.written(long(null, 1).unionByName(long(sites if asked is None else asked, 0)).groupBy(*key, "x", "y").agg(F.sum("w").alias("w"), F.max("asked").alias("asked")), "pairs")
    fine = pairs.where("x is not null and y is not null")
    # null sites by one rate alone: all that are smaller, and those of them that lack the other rate
    one = lambda axis, own, other: F.struct(F.lit(axis).alias("axis"), F.col(own).alias("value"), F.when(F.col(other).isNull(), F.col("w")).otherwise(0).alias("lone"))
    single = running(pairs.select(*key, "w", F.inline(F.array(one("x", "x", "y"), one("y", "y", "x")))).where("value is not null"), [*key, "axis"], "value", ["w", "lone"])
    single = stored.written(single.select(*key, "axis", "value", "w_below", "lone_below"), "single-rates")
    of = lambda axis: single.where(F.col("axis") == axis).select(*key, F.col("value").alias(axis), F.col("w_below").alias(f"_{axis}"), F.col("lone_below").alias(f"_{axis}_lone"))
    total = fine.groupBy(*key).agg(F.sum("w").alias("_all"))
    got = pairs.where("asked").join(_swept(fine, key), [*key, "x", "y"], "left").join(of("x"), [*key, "x"], "left").join(of("y"), [*key, "y"], "left").join(total, key, "left")
    known = F.coalesce("_all", F.lit(0)) + F.coalesce("_x_lone", F.lit(0)) + F.coalesce("_y_lone", F.lit(0))
    smaller = F.coalesce("_x", "_y", F.lit(0))
    score = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), exprs.div(F.coalesce("n", F.lit(0)).cast("double"), known)).when(smaller > 0, F.lit(0.0))
    scores, out = stored.written(got.select(*key, "x", "y", score.alias("score")), "scores"), sites
    for kind in ("id", "hs"):
        own = scores.where(F.col("kind") == kind).select(*[F.col(c).alias(f"_k_{c}") for c in (*by, "x", "y")], F.col("score").alias(f"{kind}_score"))
        same = F.col(f"{kind}_x").cast("double").eqNullSafe(F.col("_k_x")) & F.col(f"{kind}_y").cast("double").eqNullSafe(F.col("_k_y"))
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        out = out.join(own, same, "left").drop(*[f"_k_{c}" for c in (*by, "x", "y")])
    if zero_depth:
        none = (F.col("cigar_dp") == 0) | (F.col("cigar_dp_bulk") == 0)
        out = out.withColumns({f"{kind}_score": F.when(none, 0.0).otherwise(F.col(f"{kind}_score")) for kind in ("id", "hs")})
    return out


def score_cutoffs(null_scored: DataFrame, quantiles: dict[str, tuple[float, float]]) -> dict[str, tuple[float, float]]:
    """For each type the quantiles of the null sites' id and hs scores; a type without null sites isn't there."""
    out = {}
    for muttype, (low_id, low_hs) in quantiles.items():
        row = null_scored.where(F.col("muttype") == muttype).agg(F.percentile("id_score", low_id).alias("id"), F.percentile("hs_score", low_hs).alias("hs")).first()
        if row["id"] is not None and row["hs"] is not None:
            out[muttype] = (row["id"], row["hs"])
    return out
