"""Compressed tables of tiles."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from genolake.sources import spatial


@pytest.fixture(scope="module")
def tiles(spark):
    rng, rows = np.random.default_rng(3), []
    for c, n in (("1", 5000), ("2", 900), ("X", 1)):
        at = np.cumsum(rng.integers(1, 2000, n))
        rows += [(c, int(a), int(a) + int(rng.integers(0, 5000)), float(rng.normal()) if rng.random() < 0.9 else None, float(rng.integers(3)), 7.0, "x") for a in at]
    return spark.createDataFrame(rows, "chr string, start int, end_ int, mu double, k double, flat double, low string").repartition(5), rows


def test_round_trip_within_a_step(spark, tiles):
    df, rows = tiles
    for size in (64, 4096):
        chunks = spatial.compress(df, ["mu", "k", "flat"], size).cache()
        assert chunks.agg(F.max("n"), F.sum("n")).first() == (min(size, chunks.agg(F.max("n")).first()[0]), len(rows)) and chunks.where("low > high").count() == 0
        got = sorted(map(tuple, spatial.decompress(chunks, ["k", "mu", "flat"]).collect()), key=lambda r: r[:3])
        assert [g[:3] for g in got] == sorted(r[:3] for r in rows)
        mu = [r[3] for r in rows if r[3] is not None]
        step = (max(mu) - min(mu)) / spatial.LEVELS
        for g, r in zip(got, sorted(rows, key=lambda r: r[:3]), strict=True):
            assert (g[4] is None) == (r[3] is None) and (r[3] is None or -1e-9 <= r[3] - g[4] <= step * 1.000001)
            assert abs(g[3] - r[4]) <= 2 / spatial.LEVELS and g[5] == 7.0


def test_regions_open_their_chunks(spark, tiles):
    df, rows = tiles
    chunks = spatial.compress(df, ["mu"], 100).cache()
    for region in (("1", 100_000, 200_000), ("1", 1, 1), ("2", 500_000, 10**9), ("Y", 1, 10), ("X", 1, 10**9)):
        want = sorted(r[:3] for r in rows if r[0] == region[0] and r[1] <= region[2] and r[2] >= region[1])
        assert sorted(tuple(r)[:3] for r in spatial.decompress(chunks, ["mu"], region).collect()) == want
    opened = chunks.where("chr = '1' and low <= 200000 and high >= 100000").count()
    assert 0 < opened < chunks.where("chr = '1'").count() / 4


def test_size_and_edges(spark, tiles):
    df, rows = tiles
    chunks = spatial.compress(df, ["k", "flat"])
    size = chunks.agg(F.sum(F.length("payload"))).first()[0]
    assert size < len(rows) * (4 + 4 + 8 + 8) / 3  # of two numbers that repeat and two positions
    assert spatial.decompress(spatial.compress(df.limit(0), ["mu"]), ["mu"]).collect() == []
    only = spatial.compress(df.where("chr = 'X'"), []).collect()
    assert len(only) == 1 and only[0]["n"] == 1
    nothing = df.withColumn("mu", F.lit(None).cast("double"))
    assert spatial.decompress(spatial.compress(nothing, ["mu"]), ["mu"]).where("mu is not null").count() == 0
    with pytest.raises(Exception, match="a tile without start"):
        spatial.compress(df.withColumn("start", F.lit(None).cast("int")), ["mu"]).collect()
    q = spatial.quantised(np.array([0.0, 1.0, np.nan, 0.5]), 0.0, 1.0)
    assert q.tolist() == [0, spatial.LEVELS, spatial.NULL, spatial.LEVELS // 2]
