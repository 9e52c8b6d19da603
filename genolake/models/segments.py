"""Copy-number segments of coverage bins by circular binary segmentation."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stored


@dataclass(frozen=True)
class Preset:
    alpha: float
    permutations: int
    undo_sd: float
    seed: int
    least: int = 5


#: The parameters of three published procedures.
PRESETS = {"baslan": Preset(0.05, 1000, 1.0, 25), "baslan_mod": Preset(0.02, 1000, 1.0, 25), "garvin": Preset(0.01, 10_000, 3.0, 1)}


def trimmed_sd(x: np.ndarray, trim: float = 0.025) -> float:
    """The deviation of noise by the differences of neighbours without the largest, put right for a normal distribution."""
    steps = np.sort(np.abs(np.diff(x)))
    keep = round((1 - 2 * trim) * len(steps))
    if not keep:
        return 0.0
    a = NormalDist().inv_cdf(1 - trim)
    lost = 1 - 2 * a * NormalDist().pdf(a) / (1 - 2 * trim)
    return float(np.sqrt((steps[:keep] ** 2).sum() / (2 * keep) / lost))


def smooth(x: np.ndarray, reach: int = 10, outlier: float = 4.0, to: float = 2.0) -> np.ndarray:
    """Bins that stand out from all of their neighbours by ``outlier`` deviations are set ``to`` deviations from the median around."""
    sd = trimmed_sd(x)
    if len(x) < 3 or sd == 0:
        return x.copy()
    wide = np.pad(x, reach, constant_values=np.nan)
    around = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1)
    others = np.delete(around, reach, axis=1)
    middle, top, low = np.nanmedian(around, axis=1), np.nanmax(others, axis=1), np.nanmin(others, axis=1)
    return np.where(x > top + outlier * sd, middle + to * sd, np.where(x < low - outlier * sd, middle - to * sd, x))


def best_arc(x: np.ndarray, least: int = 1) -> tuple[float, int, int]:
    """The arc i..j whose mean differs most from the rest's: statistic, i and j.

    All lengths are tried.  An arc over the ends of the chromosome is the rest of one that isn't, with the same statistic.
    """
    n = len(x)
    total = np.append(0, np.cumsum(x - x.mean()))
    sd = x.std() or 1.0
    best = (0.0, 0, n)
    for length in range(least, n - least + 1):
        s = np.abs(total[length:] - total[:-length])
        if least > 1:  # what is left at an end is none or long enough
            s[1:least] = 0
            s[max(0, len(s) - least) : len(s) - 1] = 0
        k = int(s.argmax())
        z = s[k] / (sd * np.sqrt(length * (n - length) / n))
        if z > best[0]:
            best = (float(z), k, k + length)
    return best


def reaches(x: np.ndarray, z: float, least: int = 1) -> bool:
    """Whether the best arc's statistic is z or more.

    No arc's sum is more than the span of the running sums: lengths for which even
    that falls short of z, most of the middle ones, aren't tried.
    """
    n = len(x)
    total = np.append(0, np.cumsum(x - x.mean()))
    sd = x.std() or 1.0
    length = np.arange(least, n - least + 1)
    needed = z * sd * np.sqrt(length * (n - length) / n)
    for k, enough in zip(length[total.max() - total.min() >= needed].tolist(), needed[total.max() - total.min() >= needed].tolist(), strict=True):
        s = np.abs(total[k:] - total[:-k])
        if least > 1:
            s[1:least] = 0
            s[max(0, len(s) - least) : len(s) - 1] = 0
        if s.max() >= enough:
            return True
    return False


def shuffled(x: np.ndarray, seed: int, name: str, a: int, b: int, k: int) -> np.ndarray:
    """The k-th permutation of bins a..b of a chromosome, the same in every task."""
    return np.random.default_rng([seed, *name.encode(), a, b, k]).permutation(x)


def pieces(a: int, b: int, i: int, j: int) -> list[tuple[int, int]]:
    """What an arc i..j of bins a..b leaves: the parts before, in and after it."""
    cuts = sorted({a, a + i, a + j, b})
    return list(zip(cuts, cuts[1:], strict=False))


def split(x: np.ndarray, *, alpha: float = 0.05, permutations: int = 1000, least: int = 5, seed: int = 25, name: str = "") -> list[int]:
    """Starts of the segments of one chromosome: an arc is cut out if few permutations have one as good."""
    out, todo = {0}, [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a < 2 * least:
            continue
        z, i, j = best_arc(x[a:b], least)
        if z <= 0:
            continue
        worse, limit = 0, alpha * permutations
        for k in range(permutations):
            worse += reaches(shuffled(x[a:b], seed, name, a, b, k), z, least)
            if worse > limit:
                break
        if worse > limit:
            continue
        todo += pieces(a, b, i, j)
        out.update(start for start, _ in pieces(a, b, i, j))
    return sorted(out)


def split_all(chromosomes: DataFrame, how: Preset, batch: int = 50) -> DataFrame:
    """(chr, start) of the segments of all chromosomes, from (chr, y), the smoothed values in order: the cuts of ``split``.

    Open segments of all chromosomes are a table.  A round finds each one's best
    arc, and then tries permutations, ``batch`` to a task: first as many as could
    rule an arc out, then the rest of those that are still in question.  Arcs that
    stand are cut out, and what they leave is the next round's table.
    """
    least, limit = how.least, how.alpha * how.permutations
    key = ["chr", "a", "b"]
    size = F.size("y").cast("int")
    first = chromosomes.where(size > 0).select("chr", F.lit(0).alias("a"), size.alias("b"))
    open_, starts = stored.written(first, "open-segments"), [first.select("chr", F.col("a").alias("start"))]

    def part(df: DataFrame) -> DataFrame:
        return df.join(chromosomes, "chr").withColumn("x", F.slice("y", F.col("a") + 1, F.col("b") - F.col("a"))).drop("y")

    def arcs(group: pd.DataFrame) -> pd.DataFrame:
        z, i, j = best_arc(np.asarray(group["x"].iloc[0], float), least)
        return group[key].assign(z=z, i=i, j=j)

    def tried(group: pd.DataFrame) -> pd.DataFrame:
        row = group.iloc[0]
        x, worse = np.asarray(row["x"], float), 0
        for k in range(int(row["k"]), int(row["k_end"])):
            worse += reaches(shuffled(x, how.seed, row["chr"], int(row["a"]), int(row["b"]), k), float(row["z"]), least)
        return group[key].assign(worse=worse)

    def worse(df: DataFrame, low: int, high: int) -> DataFrame:
        """How many permutations low..high of each segment have an arc as good."""
        if low >= high:
            return df.select(*key, F.lit(0).cast("long").alias("worse"))
        tasks = df.select(*key, "z", F.explode(F.sequence(F.lit(low), F.lit(high - 1), F.lit(batch))).alias("k")).withColumn("k_end", F.least(F.col("k") + batch, F.lit(high)))
        return part(tasks).groupBy(*key, "k").applyInPandas(tried, "chr string, a int, b int, worse long").groupBy(*key).agg(F.sum("worse").alias("worse"))

    while True:
        long = open_.where(F.col("b") - F.col("a") >= 2 * least)
        found = stored.written(part(long).groupBy(*key).applyInPandas(arcs, "chr string, a int, b int, z double, i int, j int").where("z > 0"), "arcs")
        if found.isEmpty():
            break
        enough = min(how.permutations, int(limit) + 1)
        look = stored.written(found.join(worse(found, 0, enough), key).where(F.col("worse") <= limit), "arcs-in-question")
        rest = worse(look.drop("worse"), enough, how.permutations).withColumnRenamed("worse", "more")
        standing = stored.written(look.join(rest, key).where(F.col("worse") + F.col("more") <= limit).select(*key, "i", "j"), "standing-arcs")
        if standing.isEmpty():
            break
        cuts = F.array_sort(F.array_distinct(F.array("a", F.col("a") + F.col("i"), F.col("a") + F.col("j"), "b")))
        parts = F.transform(F.sequence(F.lit(1), F.size("_c") - 1), lambda k: F.struct(F.get("_c", k - 1).alias("a"), F.get("_c", k).alias("b")))
        open_ = stored.written(standing.select("chr", cuts.alias("_c")).select("chr", F.inline(parts)), "open-segments")
        starts.append(open_.select("chr", F.col("a").alias("start")))
    out = starts[0]
    for more in starts[1:]:
        out = out.unionByName(more)
    return out.distinct()


def undone(x: np.ndarray, starts: list[int], deviations: float) -> list[int]:
    """Starts without the smallest steps between neighbours' means, one after the other, while they are below so many deviations of the noise."""
    starts, limit = list(starts), deviations * trimmed_sd(x)
    while len(starts) > 1:
        means = np.add.reduceat(x, starts) / np.diff([*starts, len(x)])
        steps = np.abs(np.diff(means))
        if steps.min() >= limit:
            break
        starts.pop(int(steps.argmin()) + 1)
    return starts


def segment(bins: DataFrame, value: str, preset: Preset | str = "baslan") -> DataFrame:
    """Adds seg and seg_mean to (chr, start, end_, value): outliers are smoothed, chromosomes cut (``split_all``), and small steps undone.

    Bins without a finite value have neither.  Smoothing and undoing are a task for
    a chromosome, whose bins are a bounded group; the permutations of a segment are many tasks.
    """
    how = PRESETS[preset] if isinstance(preset, str) else preset
    own = stored.written(bins.select("chr", "start", "end_", value), "bins")
    fine = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    rows = own.where(fine).groupBy("chr").agg(F.array_sort(F.collect_list(F.struct("start", F.col(value).alias("v")))).alias("r"))

    def smoothed(batches):
        for part in batches:
            yield pd.DataFrame({"chr": part["chr"], "places": [[r["start"] for r in rs] for rs in part["r"]], "y": [smooth(np.array([r["v"] for r in rs], float)).tolist() for rs in part["r"]]})

    chromosomes = stored.written(rows.repartition("chr").mapInPandas(smoothed, "chr string, places array<int>, y array<double>"), "chromosomes")
    starts = split_all(chromosomes.select("chr", "y"), how).groupBy("chr").agg(F.array_sort(F.collect_list("start")).alias("starts"))

    def numbered(group: pd.DataFrame) -> pd.DataFrame:
        row = group.iloc[0]
        y = np.asarray(row["y"], float)
        cuts = undone(y, [int(k) for k in row["starts"]], how.undo_sd)
        seg = np.searchsorted(cuts, np.arange(len(y)), "right")
        return pd.DataFrame({"chr": row["chr"], "start": np.asarray(row["places"], np.int64), "seg": seg, "seg_mean": pd.Series(y).groupby(seg).transform("mean").to_numpy()})

    found = chromosomes.join(starts, "chr").groupBy("chr").applyInPandas(numbered, "chr string, start int, seg int, seg_mean double")
    # bins that repeat a start have one segment
    found = found.groupBy("chr", "start").agg(F.min("seg").alias("seg"), F.min_by("seg_mean", "seg").alias("seg_mean"))
    joined = own.withColumn("_fine", fine).join(found, ["chr", "start"], "left")
    return joined.select("chr", "start", "end_", value, F.when(F.col("_fine"), F.col("seg")).alias("seg"), F.when(F.col("_fine"), F.col("seg_mean")).alias("seg_mean"))
