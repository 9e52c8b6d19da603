"""Column expressions; all stay on the JVM.  Undefined results are NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

div = F.try_divide


def muttype(ref: Column, alt: Column) -> Column:
    """snv for two alleles of length 1, else indel."""
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1), "snv").otherwise("indel")


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-F.abs(x)))).otherwise(F.exp(-F.abs(x)) / (1 + F.exp(-F.abs(x))))


def match_ab(af: Column, mu: Column) -> Column:
    """mu with the sign that points to the side of the allele fraction."""
    return F.when(af < 0.5, -F.abs(mu)).otherwise(F.abs(mu))


def haplotypes(phased: Column, ref: Column, alt: Column) -> tuple[Column, Column]:
    """Counts of haplotypes 1 and 2; NULL where the site has no phase."""
    first = F.when(phased.isNotNull(), F.when(phased == "0|1", ref).otherwise(alt))
    return first, F.when(phased.isNotNull(), F.when(phased == "0|1", alt).otherwise(ref))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def substitution_channel(context: Column, alt: Column) -> Column:
    """CTX:REF>ALT of a three-base context, folded to a pyrimidine reference; NULL unless all bases are A, C, G, T."""
    fold = F.substring(context, 2, 1).isin("A", "G")
    ctx = F.when(fold, reverse_complement(context)).otherwise(context)
    to = F.when(fold, reverse_complement(alt)).otherwise(alt)
    return F.when(context.rlike("^[ACGT]{3}$") & alt.rlike("^[ACGT]$") & (F.substring(ctx, 2, 1) != to), F.concat(ctx, F.lit(":"), F.substring(ctx, 2, 1), F.lit(">"), to))


def binomial_half_cdf(k: Column, n: Column) -> Column:
    """P(Bin(n, 1/2) <= k), by the ratio of neighbouring terms; 1 for n = 0."""
    start = F.struct((F.lit(-0.6931471805599453) * n).alias("log"), F.exp(F.lit(-0.6931471805599453) * n).alias("total"))

    def add(state: Column, i: Column) -> Column:
        log = state["log"] + F.log((n - i + 1).cast("double") / i)
        return F.struct(log.alias("log"), (state["total"] + F.exp(log)).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), F.least(k, n).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n, F.lit(1.0)).when(k < 0, F.lit(0.0)).when(n.isNotNull() & k.isNotNull(), F.aggregate(steps, start, add, lambda s: s["total"]))


def vaf_bin(af: Column, dp: Column, bins: int = 20) -> Column:
    """1-based bin of (k/bins, (k+1)/bins]; 0 and undefined fractions go to the first."""
    return F.when((dp == 0) | af.isNull() | (af == 0), 1).otherwise(F.ceil(af * bins)).cast("int")


def depth_index(dp: Column, max_dp: Column | int) -> Column:
    """min(dp, max_dp + 1) + 1; NULL without a depth."""
    top = F.lit(max_dp) if isinstance(max_dp, int) else max_dp
    return F.when(dp.isNotNull(), F.least(dp, top + 1) + 1).cast("int")


def quantise(x: Column, low: float, high: float, levels: int = 254) -> Column:
    """0..levels by truncation; NULL as levels + 1."""
    return F.coalesce((levels * (x - low) / (high - low)).cast("int"), F.lit(levels + 1))


def unquantise(q: Column, low: float, high: float, levels: int = 254) -> Column:
    return F.when(q <= levels, q.cast("double") / levels * (high - low) + low)


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the MD5 of seed and keys, the same on every engine and in every run."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_seed(text: Column) -> Column:
    """28 bits of the SHA-1."""
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 7), 16, 10).cast("int")


def least_or_null(*columns: Column) -> Column:
    """least() that is NULL if any is."""
    fine = F.lit(True)
    for c in columns:
        fine = fine & c.isNotNull()
    return F.when(fine, F.least(*columns))


def kernel(distance: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """The covariance of two squared exponentials at a distance."""
    square = distance * distance
    return F.exp(a - square / (b * b)) + F.exp(c - square / (d * d))


def interpolate(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Linear between knots in ascending order, clamped at the ends."""
    out = F.when(x.isNull(), F.lit(None).cast("double")).when(x <= xs[0], F.lit(float(ys[0])))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(ys[-1])))
