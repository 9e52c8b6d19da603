"""Operator 8: URL filters by empirical-Bayes host reputation, with DataFrame functions only.

Labelled page outcomes are shrunk through beta-binomial priors: all pages, then
the suffix, the registered domain and the host, each the prior of the next.  A
level's prior strength comes from how far its units scatter about their parents
(moments).  A host is blocked if even the lower bound of its posterior share of
bad pages is over the limit.  Rules on hosts and paths go before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIMIT, DEVIATIONS = 0.5, 2.0
#: A host with more than this share of all pages is hot: there are at most 1 / HOT of them.
HOT = 1 / 256
LEVELS = ("suffix", "domain", "host")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: between :// and /, ?, # or the end; then up to ?, # or the end.  Empty without ://."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls.  A rule is a host and the beginning of a path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for how, rule in sorted(rules, key=lambda r: len(r[1])):
        where, _, begin = rule.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith("/" + begin)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, how).otherwise(verdict)
    return name, verdict


def suffix_and_domain(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """The public suffix, the last label unless one of ``suffixes`` fits, and the label before it with it."""
    labels = F.split(host, r"\.")
    n = F.when(F.lit(False), 0)
    for s in sorted(suffixes, key=len, reverse=True):
        n = n.when((host == s) | host.endswith("." + s), s.count(".") + 1)
    n = n.otherwise(1) if suffixes else F.lit(1)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), F.greatest(k, F.lit(1))), ".")
    return last(n), last(n + 1)


def reputations(hosts: DataFrame) -> DataFrame:
    """(host, n, bad) of each host to (host, suffix, domain, mean, deviation) of its posterior share of bad pages.

    For each level, with parents' means m and units of n > 0 pages: the excess of
    sum (bad - n m)^2 over sum n m (1 - m), against sum n (n - 1) m (1 - m), is
    the correlation r of pages in a unit; the prior's strength is (1 - r) / r.
    """
    # the share of all pages, with one good and one bad page more
    whole = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m"))
    table = hosts.withColumn("m", whole.scalar())
    for level in LEVELS:
        units = table.groupBy(level).agg(F.sum("n").alias("u_n"), F.sum("bad").alias("u_bad"), F.first("m").alias("u_m"))
        n, bad, m = F.col("u_n"), F.col("u_bad"), F.col("u_m")
        spread = units.agg(
            F.sum((bad - n * m) * (bad - n * m)).alias("seen"), F.sum(n * m * (1 - m)).alias("by_chance"), F.sum(n * (n - 1) * m * (1 - m)).alias("room"))
        r = F.least(F.greatest(F.coalesce(F.try_divide(F.col("seen") - F.col("by_chance"), F.col("room")), F.lit(0.0)), F.lit(0.001)), F.lit(0.999))
        units = units.withColumn("strength", spread.select((1 - r) / r).scalar()).select(level, ((m * F.col("strength") + bad) / (F.col("strength") + n)).alias("m"), (F.col("strength") + n).alias("weight"))
        table = table.drop("m", "weight").join(units, level)
    return table.select("host", "suffix", "domain", F.col("m").alias("mean"), F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("weight") + 1)).alias("deviation"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], *, limit: float = LIMIT, deviations: float = DEVIATIONS, suffixes: Sequence[str] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages, given outcomes (page_id, bad 0 or 1).

    Null urls and urls without :// have an empty host and path, which is a host
    like others.  Hosts without labelled pages have the posterior of their
    domain; null outcomes don't count, repeated rows count each.
    """
    host, path = parts(F.col(url_col))
    pages = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    known = outcomes.select("page_id", F.col("bad").cast("int").alias("bad")).where("bad is not null")
    counted = pages.select("page_id", "host").join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("*").alias("pages"))
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    counted = shared.written(counted.select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "bad", "pages"), "hosts")
    bound = F.col("mean") - deviations * F.col("deviation")
    judged = shared.written(reputations(counted), "reputations").select("host", F.when(bound > limit, "block").otherwise("allow").alias("judged"))
    # hot hosts, of a bounded number, are broadcast; pages of the others are joined by host
    total = counted.agg(F.sum("pages")).scalar()
    hot = judged.join(counted.where(F.col("pages") > total * HOT).select("host"), "host", "left_semi").select("host", F.col("judged").alias("hot"))
    marked = pages.join(F.broadcast(hot), "host", "left")
    key = F.when(F.col("hot").isNull(), F.col("host")).otherwise(F.concat(F.lit("\x00"), F.pmod(F.xxhash64("page_id"), F.lit(4096)).cast("string")))
    joined = marked.withColumn("_key", key).join(judged.withColumnRenamed("host", "_key"), "_key", "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "hot", "judged").alias("verdict"))
