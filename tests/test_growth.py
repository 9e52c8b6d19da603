"""What a task is given doesn't grow with the tables."""

import oracle
import pytest
from pyspark.sql import functions as F

from genolake.plans import queries, queries_models, queries_more, queries_parts, queries_rates  # noqa: F401
from genolake.sources import stored

ROWS = 250


@pytest.fixture
def few_rows(monkeypatch):
    monkeypatch.setattr(stored, "ROWS", ROWS)


def largest_part(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def matches_sql(name, spark, sf_dir):
    return oracle.differences(queries.QUERIES[name](spark, sf_dir), queries.SQL[name], oracle.connect(sf_dir))


def test_combined_calls_in_small_parts(spark, sf_dir, few_rows):
    """no join sends the neighbours whole to every task, and calls are told apart in parts of a bounded size."""
    assert matches_sql("combined_calls", spark, sf_dir) == ""
    plan = queries.QUERIES["combined_calls"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "BroadcastHashJoin" not in plan
    assert largest_part(queries_more.adjacent_calls(spark, sf_dir)) < 4 * ROWS


def test_site_counts_in_small_parts(spark, sf_dir, few_rows):
    """rows of a place are grouped where they have been dealt to, in one exchange."""
    assert matches_sql("site_counts", spark, sf_dir) == ""
    counts = queries.QUERIES["site_counts"](spark, sf_dir)
    assert largest_part(counts) < 4 * ROWS
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_nearest_in_small_parts(spark, sf_dir, few_rows):
    """a block's rows are dealt by the number of rows that were read, not to as many tasks as Spark has by itself."""
    assert matches_sql("nearest_both", spark, sf_dir) == ""
    parts = [f for f in queries.QUERIES["nearest_both"](spark, sf_dir).inputFiles() if "/blocks-" in f]
    assert len(parts) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_depths_are_dealt(spark):
    """the depths' burdens are many tasks, and only sums that can still come to the whole are carried on."""
    import numpy as np

    from genolake.models import priors

    rows = [("snv", d, b, 50 + b, 60 + 3 * b) for d in range(40) for b in range(1, 21)]
    got = priors.burdens(spark.createDataFrame(rows, "muttype string, dp_idx int, bin int, g long, s long"))
    assert got.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert got.select("low", "high").distinct().count() == 1
    g, s = np.arange(51.0, 71), np.arange(63.0, 121, 3)
    lengths, convolve = [], np.convolve
    try:
        np.convolve = lambda a, b: lengths.append(len(a)) or convolve(a, b)
        priors.fits_under(int(s.sum()) - 30, g, s)
    finally:
        np.convolve = convolve
    assert max(lengths) <= 31  # 30 are missing at most


def test_prior_rates_counts_once(spark, sf_dir, few_rows, monkeypatch):
    """bounds and histograms are worked out once, and a type's rows don't meet in one task."""
    from genolake.models import priors

    calls, depth_bounds = [], priors.depth_bounds
    monkeypatch.setattr(priors, "depth_bounds", lambda *a, **k: calls.append(1) or depth_bounds(*a, **k))
    rated = queries.QUERIES["prior_rates"](spark, sf_dir)
    assert len(calls) == 1
    assert "SortMergeJoin" not in rated._jdf.queryExecution().executedPlan().toString()
    assert matches_sql("prior_rates", spark, sf_dir) == ""


def test_sites_are_judged_from_a_table(spark, sf_dir):
    """tests are not worked out where rows are grouped, nor the filter on them before, where their code is too long to be compiled."""
    assert matches_sql("rescue_batch", spark, sf_dir) == ""
    plan = queries.called_sites(spark, sf_dir).where("static_filter")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("Subquery")[0]


def test_sensitivity_counts_from_written_calls(spark, sf_dir):
    """the sites to be counted are written when they have been judged, so that their tests are not named by each of eighteen counts."""
    assert matches_sql("sensitivity_covariates", spark, sf_dir) == ""
    plan = queries.QUERIES["sensitivity_covariates"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "id_score" not in plan and "training_pass" in plan


def balance_data(seed=5):
    import numpy as np

    rng = np.random.default_rng(seed)
    pos = np.sort(rng.choice(900_000, 260, replace=False)).astype(float)
    d = rng.integers(3, 60, 260).astype(float)
    y = rng.binomial(d.astype(int), 1 / (1 + np.exp(-2 * np.sin(pos / 9000)))).astype(float)
    return np.sort(np.concatenate([pos, rng.choice(900_000, 1500, replace=False) + 0.5])), pos, y, d


@pytest.mark.parametrize("fit", [(-1.0, 1000.0, -1.0, 20_000.0), (-0.5, 3000.0, 0.5, 60_000.0), (0.0, 500.0, 0.0, 300_000.0)])
def test_balance_of_positions_in_a_row(fit, monkeypatch):
    """positions in a row are solved from what their windows have in common, each to the mode of its own window."""
    import numpy as np

    from genolake.models import allele_balance

    at, pos, y, d = balance_data()
    low, high = allele_balance.window(at, pos)
    problems, modes = [], allele_balance.modes
    monkeypatch.setattr(allele_balance, "modes", lambda k, *a, **o: problems.append(len(k)) or modes(k, *a, **o))
    mu, sd = allele_balance.predictions(at, low, high, pos, y, d, fit)
    assert sum(problems) < len(at) / 4
    for j in range(0, len(at), 37):
        i = np.arange(low[j], high[j])
        i = i[pos[i] != at[j]]
        k, f = allele_balance.covariance(pos[i], pos[i], fit), np.zeros(len(i))
        near = allele_balance.covariance(at[j : j + 1], pos[i], fit)[0]
        for _ in range(60):
            p = 1 / (1 + np.exp(-f))
            w = d[i] * p * (1 - p)
            f = k @ np.linalg.solve(np.eye(len(i)) + w[:, None] * k, w * f + y[i] - d[i] * p)
        assert mu[j] == pytest.approx(near @ (y[i] - d[i] * p), abs=2e-5)
        assert sd[j] ** 2 == pytest.approx(np.exp(fit[0]) + np.exp(fit[2]) - near @ np.linalg.solve(k + np.diag(1 / w), near), abs=1e-4)


def test_read_models_share_one_table(monkeypatch):
    """what half and a quarter of the reads give follows from the mutation's own table."""
    import numpy as np

    from genolake.models import gauss_hermite

    mu, sd = np.array([-1.3, 0.0, 0.7]), np.array([0.4, 1.1, 0.02])
    calls, real = [], gauss_hermite.read_probabilities
    monkeypatch.setattr(gauss_hermite, "read_probabilities", lambda *a: calls.append(1) or real(*a))
    for d in (0, 9, 60, 230):
        calls.clear()
        got = gauss_hermite.tables(d, mu, sd)
        assert len(calls) == 1
        for name, factor in (("mut", 1.0), ("lysis", 2.0), ("mda", 4.0)):
            plain = real(d, mu, sd) if factor == 1 else (real(d, mu, sd, factor) + real(d, -mu, sd, factor)) / 2
            np.testing.assert_allclose(got[name], plain, rtol=1e-10, atol=1e-200)


def test_models_move_few_columns(spark, sf_dir):
    """sites are joined whole with what models and balance come to, not sorted for each of them; rows that repeat stay as many."""
    from genolake.config import Config
    from genolake.plans import pipeline

    cell = queries_models.cell_sites(spark, sf_dir).where("chr = 'chr2'").limit(300)
    cell = stored.written(cell.unionByName(cell.limit(5)).unionByName(cell.limit(4).withColumn("dp", F.lit(None).cast("int"))), "cell")
    got = pipeline.analyse(cell, queries_models._fits(spark), Config("bulk", ("cell",)), stages=("ab", "models"))
    assert got.count() == cell.count()
    assert got.drop("gp_mu", "gp_sd", "ab", "abc_pv", "lysis_pv", "lysis_beta", "mda_pv", "mda_beta").exceptAll(cell).count() == 0
    assert got.where("dp is null and abc_pv is not null").count() == 0 and got.where("dp is not null and abc_pv is null").count() == 0
    models = [f for f in got.inputFiles() if "/models-" in f]
    assert models and spark.read.parquet(*models).columns == ["_m_chr", "_m_pos", "_m_scalt", "_m_dp", "_m_af", "gp_mu", "gp_sd", "ab", "abc_pv", "lysis_pv", "lysis_beta", "mda_pv", "mda_beta"]


def test_placed_draws_are_not_moved(spark, sf_dir, monkeypatch):
    """a draw is made by the task that has its region; sets are whole, draws uniform and the same for any number of tasks."""
    import numpy as np

    from genolake.models import sampling

    plan = queries_models.placed_sites(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("FlatMapGroupsInArrow")[0] and "Exchange" not in plan.split("FlatMapGroupsInArrow")[0].split("== Initial Plan ==")[0]
    regions = spark.createDataFrame([("1", 11, 20), ("1", 15, 30), ("1", 101, 180), ("2", 1, 100)], "chr string, start int, end_ int")
    for drawn in (1 << 19, 700):
        monkeypatch.setattr(sampling, "DRAWN", drawn)
        got = sampling.placed_sets(regions, [("b", 7), ("a", 1), ("none", 0)], 1000, 3).toPandas()
        assert len(got) == 8000 and sorted(got["i"]) == list(range(8000))
        assert got.groupby(["perm_id", "channel"]).size().unstack().apply(lambda c: c.unique().tolist()).to_dict("list") == {"a": [1], "b": [7]}
        inside = ((got["chr"] == "1") & (got["pos"].between(11, 30) | got["pos"].between(101, 180))) | ((got["chr"] == "2") & got["pos"].between(1, 100))
        assert inside.all()
        n = got.groupby(["chr", "pos"]).size()
        assert len(n) == 200 and ((n - 40) ** 2 / 40).sum() == pytest.approx(199, abs=5 * np.sqrt(2 * 199))
        half = got.assign(far=got["chr"] == "2").groupby("perm_id")["far"].sum()
        assert half.var() == pytest.approx(2, abs=0.5) and half.mean() == pytest.approx(4, abs=0.25)
        again = sampling.placed_sets(regions.repartition(3), [("b", 7), ("a", 1)], 1000, 3).toPandas()
        assert again.sort_values("i").reset_index(drop=True).equals(got.sort_values("i").reset_index(drop=True))
    assert sampling.placed_sets(regions, [], 1000).count() == 0
    for n in (1, 2, 3, 1000, 4097):
        assert sorted(sampling.shuffled(np.arange(n), n, (5, 1)).tolist()) == list(range(n))
    parts = [sampling.share(k, 13, 1_000_003, 5000, (1, 2)) for k in range(13)]
    assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) == 5000


@pytest.fixture(scope="module")
def far_dir(spark, sf_dir, tmp_path_factory):
    """Tables whose sites are there twice, once 3,000 million bases further on."""
    folder = str(tmp_path_factory.mktemp("far"))
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line.unionByName(line.withColumn("l_orderkey", F.col("l_orderkey") + 30_000_000)).write.parquet(f"{folder}/lineitem.parquet")
    spark.read.parquet(f"{sf_dir}/orders.parquet").write.parquet(f"{folder}/orders.parquet")
    return folder


def test_balance_beyond_32_bits(spark, sf_dir, far_dir):
    """tables of many orders have positions that 32 bits don't hold; sites there are judged as others are."""
    got = queries_models.gp_predict(spark, far_dir).toPandas()
    near, far = got[got["pos"] < 3_000_000_000], got[got["pos"] >= 3_000_000_000]
    assert len(near) == len(far) == queries_models.gp_predict(spark, sf_dir).count()
    both = near.merge(far.assign(pos=far["pos"] - 3_000_000_000), on=["chr", "pos"])
    assert len(both) == len(near) and (both["gp_sd_x"] - both["gp_sd_y"]).abs().mean() < 1e-3


def test_substitution_sets_of_many_calls(spark, sf_dir, far_dir):
    """calls may lie beyond 32 bits, and a batch holds whole sets however many calls there are."""
    from genolake.models import sampling

    sequence = stored.written(queries_models._sequence(spark, far_dir), "sequence")
    calls = stored.written(queries_models._real_calls(spark, far_dir, sequence), "calls")
    n = calls.where("channel is not null").count()
    assert n > 0 and queries_models._scored(spark, far_dir).agg(F.max("pos")).first()[0] > 3_000_000_000
    many = calls
    for _ in range(3):
        many = many.unionByName(many)
    made = sampling.substitution_sets(queries_models.view(spark, far_dir, "interval"), sequence, stored.written(many, "many"), 5, seed=8, chunk=queries_models.CHUNK, batch=4 * n)
    found = made.groupBy("perm_id").count().collect()
    assert len(found) == 5 and {r["count"] for r in found} == {8 * n}
