"""Every registered query of the site operators against its SQL."""

import oracle
import pytest

from genolake.plans import queries, queries_models, queries_more, queries_parts, queries_rates  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(name, spark, sf_dir, duck):
    assert oracle.differences(queries.QUERIES[name](spark, sf_dir), queries.SQL[name], duck) == ""


@pytest.mark.parametrize("name", ["gp_predict", "population_burden", "gc_correct", "cbs_segments", "permuted_sites", "resampled_training", "spectrum_homogeneity", "mapd_curve"])
def test_rows(name, spark, sf_dir):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_track_tiles_before_the_first(spark, tmp_path):
    """The place before the first and those up to a tile ahead are counted in the first tile, as whole numbers are divided in SQL."""
    places = [-100_001, -100_000, -99_999, -1, 0, 1, 2, 100_000, 100_001, 200_000]
    spark.createDataFrame([(k, p, "a", k) for k, p in enumerate(places)], "event_id long, s long, event_type string, user_id long").selectExpr(
        "event_id", "dateadd(SECOND, s, TIMESTAMP_NTZ '2024-01-01 00:00:00') AS ts", "event_type", "user_id", "1.0D AS value").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    name = "track_tiles"
    assert oracle.differences(queries.QUERIES[name](spark, str(tmp_path)), queries.SQL[name], oracle.connect(str(tmp_path))) == ""
