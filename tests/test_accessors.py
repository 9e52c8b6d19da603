"""Views of finished tables and loaders of stored ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from genolake.plans import accessors
from genolake.sources import inputs


def test_shared_table_prefers_the_first_and_orders(spark):
    one = spark.createDataFrame([("a", "chr10", 5, "A", "C", "snv", 0.5, True), ("a", "chr2", 9, "A", "C", "snv", None, False)], "sample string, chr string, pos int, refnt string, altnt string, muttype string, af double, pass boolean")
    two = one.withColumn("af", F.lit(9.0)).unionByName(spark.createDataFrame([("b", "chrUn", 1, "A", "G", "snv", 0.1, True), ("b", "chrUn", 1, "A", "G", "snv", 0.2, True)], one.schema))
    got = accessors.shared_table([one, two], ["chr2", "chr10"]).collect()
    assert [(r["chr"], r["af"]) for r in got] == [("chr2", None), ("chr10", 0.5), ("chrUn", 0.1)]
    assert got[0].asDict().keys() == set(accessors.SHARED) and got[0]["rescue"] is None
    with pytest.raises(ValueError, match="no tables"):
        accessors.shared_table([])


def test_coverage_of_samples(spark):
    bins = spark.createDataFrame([("a", "1", 1, 10, 0.41, 3), ("a", "1", 11, 20, 0.4101, 5), ("b", "1", 1, 10, 0.2, 7), ("b", "1", 11, 20, 0.3, 9)], "sample string, chr string, start int, end_ int, gc double, cnt int")
    assert sorted(map(tuple, accessors.binned_along(bins, "cnt").collect())) == [("a", "1", 5, 3.0), ("a", "1", 15, 5.0), ("b", "1", 5, 7.0), ("b", "1", 15, 9.0)]
    assert sorted(map(tuple, accessors.binned_along(bins, "cnt", "gc").collect())) == [("a", 0.41, 4.0), ("b", 0.3, 9.0)]
    with pytest.raises(ValueError, match="along"):
        accessors.binned_along(bins, "cnt", "x")


def test_neighbours_in_their_members_place(spark):
    rows = [("s", "1", 10, "A", "C", "snv", 5, 9, 0.5), ("s", "1", 11, "G", "T", "snv", 6, 9, 0.4), ("s", "1", 12, "GA", "G", "indel", 6, 9, 0.4), ("s", "1", 50, "G", "T", "snv", 1, 9, 0.1), ("s", "1", 51, "G", "T", "snv", 9, 9, 0.5), ("t", "1", 11, "G", "T", "snv", 6, 9, 0.4)]
    df = spark.createDataFrame(rows, "sample string, chr string, pos int, refnt string, altnt string, muttype string, scalt int, scref int, af double")
    got = sorted((r["sample"], r["pos"], r["refnt"], r["altnt"], r["muttype"], r["n_combined"], r["af"]) for r in accessors.combined_neighbours(df).collect())
    assert got == [("s", 10, "AG", "CT", "dnv", 2, None), ("s", 12, "GA", "G", "indel", 1, 0.4), ("s", 50, "G", "T", "snv", 1, 0.1), ("s", 51, "G", "T", "snv", 1, 0.5), ("t", 11, "G", "T", "snv", 1, 0.4)]
    assert accessors.combined_neighbours(df.limit(0)).count() == 0


def test_phased_sites_and_loaders(spark, tmp_path):
    hsnps = spark.createDataFrame([("1", 5, ".", "A", "C", "0|1"), ("1", 6, "rs1", "A", "C", "1|0")], "chr string, pos int, dbsnp string, refnt string, altnt string, phasedgt string")
    called = spark.createDataFrame([("1", 5, ".", "A", "C", 9), ("1", 5, ".", "A", "C", 8), ("1", 6, ".", "A", "C", 7)], "chr string, pos int, dbsnp string, refnt string, altnt string, qual int")
    assert [tuple(r) for r in inputs.phased_sites(hsnps, called).collect()] == [("1", 5, ".", "A", "C", ".", ".", ".", "GT", "0|1")]
    assert inputs.phased_sites(hsnps, called.limit(0)).count() == 0
    with pytest.raises(ValueError, match="calls lack dbsnp"):
        inputs.phased_sites(hsnps, called.drop("dbsnp"))
    fits = spark.createDataFrame([("1", -1.0, 10.0, -1.0, 100.0)], "chr string, a double, b double, c double, d double")
    fits.write.parquet(str(tmp_path / "fits"))
    assert tuple(inputs.fits(spark, str(tmp_path / "fits")).first()) == ("1", -1.0, 10.0, -1.0, 100.0, None)
    (tmp_path / "fits.tab").write_text("#chr\ta\tb\tc\td\tlogp\n1\t-1\t10\t-1\t100\tNA\n1\t-1\t10\t-1\t100\t5\n")
    with pytest.raises(ValueError, match="repeated row: 1"):
        inputs.fits(spark, str(tmp_path / "fits.tab"))
    (tmp_path / "depth.tab").write_text("#sc_dp\tbulk_dp\tn\n3\t4\t100\n501\t4\t1\n")
    with pytest.raises(ValueError, match="not a depth table"):
        inputs.depth_profile(spark, str(tmp_path / "depth.tab"))
    assert tuple(inputs.depth_profile(spark, str(tmp_path / "depth.tab"), 600).orderBy("sc_dp").first()) == (3, 4, 100, None)
    with pytest.raises(ValueError, match="lacks chr, a, b"):
        inputs.fits(spark, str(tmp_path / "depth.tab"))


def test_signatures_are_checked(spark):
    channels = spark.createDataFrame([("snv", c) for c in "abc"], "muttype string, channel string")
    make = lambda rows: spark.createDataFrame(rows, "muttype string, channel string, true_sig double")
    assert {r["channel"]: r["true_sig"] for r in inputs.signatures(make([("snv", "a", 0.5), ("snv", "b", 1.5)]), channels).collect()} == {"a": 0.5, "b": 1.5, "c": 0.0}
    for rows, why in (([("snv", "z", 1.0)], "z is not known"), ([("snv", "a", -1.0)], "no share"), ([("snv", "a", 0.0)], "empty"), ([("snv", "a", 1.0), ("snv", "a", 2.0)], "repeated")):
        with pytest.raises(ValueError, match=why):
            inputs.signatures(make(rows), channels)


def test_shared_table_sorts_rows_once(spark):
    """The first table's row, of several the smallest with NULLs first; no aggregate that sorts, and the order is over a written table."""
    schema = "sample string, chr string, pos int, refnt string, altnt string, muttype string, af double, dp int"
    one = spark.createDataFrame([("s", "1", 5, "A", "C", "snv", 0.5, 9), ("s", "1", 5, "A", "C", "snv", None, 30), ("s", "2", 1, "A", "C", "snv", 0.1, 8)], schema)
    two = spark.createDataFrame([("s", "1", 5, "A", "C", "indel", None, 1), ("s", "1", 7, "A", "C", "indel", 0.2, 3)], schema)
    got = accessors.shared_table([one, two], ["2", "1"])
    assert [(r["chr"], r["pos"], r["muttype"], r["af"], r["dp"]) for r in got.collect()] == [("2", 1, "snv", 0.1, 8), ("1", 5, "snv", None, 30), ("1", 7, "indel", 0.2, 3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "parquet" in plan.lower()
