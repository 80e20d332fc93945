"""Keyed draws: columns and their twins agree, and they follow their laws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixshard.functions import draws as D


def test_gamma_column_is_its_twin_and_has_its_moments(spark):
    shapes = [1e-9, 0.05, 0.7, 1.0, 2.5, 40.0, 1e6]
    df = spark.range(4000).select(F.col("id"), *[D.keyed_gamma(F.lit(a), F.lit(5), F.col("id"), F.lit(i)).alias(f"g{i}") for i, a in enumerate(shapes)])
    t = df.toPandas()
    for i, a in enumerate(shapes):
        g = t[f"g{i}"].to_numpy()
        assert (g >= 0).all()
        if a >= 0.05:
            assert abs(g.mean() - a) < 5 * np.sqrt(a / len(g))
            assert abs(g.var() / a - 1) < 0.25 + 0.5 / np.sqrt(a) * (a < 1)
        for r in t.itertuples():
            if r.id < 40:
                assert getattr(r, f"g{i}") == pytest.approx(D.gamma_of(a, 5, r.id, i), rel=1e-12, abs=1e-300)


def test_weights_do_not_run_python(spark):
    sizes = spark.createDataFrame([(i, float(i)) for i in range(5)], "cluster_id int, size double")
    betas, bu = D.dirichlet_weights(sizes, 1.0, 1, 0)
    assert "Python" not in betas._jdf.queryExecution().executedPlan().toString() and "Arrow" not in betas._jdf.queryExecution().executedPlan().toString()
    assert betas.agg(F.sum("beta")).first()[0] + bu.first()[0] == pytest.approx(1.0)


@pytest.mark.parametrize("form", ["rate", "scale"])
def test_concentration_column_is_its_twin(spark, form):
    rows = [(s, 0.1 + s, 1 + s, 10 ** (s % 5)) for s in range(12)]
    df = spark.createDataFrame(rows, "shard int, conc double, k int, n long")
    got = df.select("shard", D.concentration_step(F.col("conc"), F.col("k"), F.col("n"), 1.0, 0.5, form, F.lit(7), F.col("shard")).alias("c")).collect()
    for r in got:
        _, conc, k, n = rows[r["shard"]]
        assert r["c"] == pytest.approx(D.concentration_of(conc, k, n, 1.0, 0.5, form, 7, r["shard"]), rel=1e-10)


def test_concentration_keeps_its_posterior():
    """With data from a DP of known concentration the chain settles around it."""
    r = np.random.default_rng(0)
    alpha, n = 3.0, 5000
    k = 1 + int((r.random(n - 1) < alpha / (alpha + np.arange(1, n))).sum())
    c, chain = 1.0, []
    for t in range(1500):
        c = D.concentration_of(c, k, n, 1.0, 0.5, "rate", 1, t)
        chain.append(c)
    assert 1.0 < np.mean(chain[200:]) < 6.0


def test_counters_are_uniform_and_independent():
    h = D.counter(np.arange(100_000)[:, None], np.arange(3)[None, :])
    u = np.stack([D.counter_uniform(h, p) for p in range(3)], axis=-1).reshape(-1, 3)
    assert abs(u.mean() - 0.5) < 2e-3 and abs(u.var() - 1 / 12) < 1e-3
    assert np.abs(np.corrcoef(u.T) - np.eye(3)).max() < 0.01
    counts = np.bincount((u[:, 0] * 64).astype(int), minlength=64)
    assert ((counts - len(u) / 64) ** 2 / (len(u) / 64)).sum() < 120  # chi-square with 63 degrees
    neighbours = u[:, 0].reshape(-1, 3)
    assert abs(np.corrcoef(neighbours[:-1, 0], neighbours[1:, 0])[0, 1]) < 0.01


@pytest.mark.parametrize("dof", [0, 1, 2, 7, 63])
def test_normals_and_chi_squares(dof):
    h = D.counter(np.arange(60_000))
    z = D.counter_normal(h, 0)
    assert abs(z.mean()) < 0.02 and abs(z.var() - 1) < 0.03 and abs((z**4).mean() - 3) < 0.2
    x = D.counter_chi2(h, dof, 2)
    assert abs(x.mean() - dof) < 5 * np.sqrt(2 * dof / len(x)) + 1e-12
    assert abs(x.var() - 2 * dof) < 0.1 * dof + 1e-12
    assert abs(np.corrcoef(z, x)[0, 1]) < 0.02 if dof else True


def test_points_draw_the_same_whatever_block_they_are_in():
    ids = np.array([5, 1 << 40, 7, (1 << 40) + 5, 9])
    d = D.PointDraws(3, 1, 2, ids)
    whole = d.candidates(4, slice(0, 5), 3, 8)
    for i in range(5):
        one = d.candidates(4, slice(i, i + 1), 3, 8)
        assert all((a[i] == b[0]).all() for a, b in zip(whole, one))
    assert len(np.unique(whole[0])) == 15
    shares = [D.PointDraws(3, 1, 2, np.arange(4000)).opening(0, i, 2.0, 2)[0] for i in range(4000)]
    assert abs(np.mean(shares) - 1 / 3) < 0.02  # Beta(1, 2)


def test_the_registered_sweep_opens_clusters(spark):
    from mixshard.plans.catalog import q_full_sweep

    rows = q_full_sweep(spark, "/root/testdata/sf0.001").collect()
    assert max(r["clusters"] for r in rows) > 4 and any(r["cluster_id"] >= 4 for r in rows)
