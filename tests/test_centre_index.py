"""Scoring through the index over centres against the full product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixshard.functions.centre_index import CentreIndex
from mixshard.functions.matrix import best_of_block
from mixshard.operators import score as S


def blobs(k, d, seed=0, spread=10.0):
    r = np.random.default_rng(seed)
    g = r.normal(0, spread, (max(1, k // 50), d))
    return g[r.integers(0, len(g), k)] + r.normal(0, 1, (k, d)), r


@pytest.mark.parametrize("k,d,E,far", [(1, 2, 1.0, 0), (7, 1, 1.0, 0), (2000, 2, 0.05, 0), (1500, 3, 5.0, 1e6), (1200, 64, 0.5, 0)])
def test_labels_scores_and_ties_are_those_of_the_full_product(k, d, E, far):
    phi, r = blobs(k, d, seed=k)
    phi[k - k // 4:] = phi[: k // 4]  # equal centres: the lowest id wins
    phi += far
    x = phi[r.integers(0, k, 800)] + r.normal(0, 0.3, (800, d))
    x[:5] = phi[r.integers(0, k, 5)]
    logw = np.log(r.random(k))
    logw[r.random(k) < 0.1] = -np.inf
    logw[k - k // 4:] = logw[: k // 4]
    ids = np.arange(k) * 3
    index = CentreIndex(ids, phi)
    got, want = index.best(x, logw, E), best_of_block(x, phi, logw, ids, E)
    for a, b in zip(got[:3], want[:3]):
        assert np.array_equal(a, b)
    floor = want[0] - r.exponential(3.0, len(x))
    true = logw[None, :] - ((x[:, None] - phi[None]) ** 2).sum(axis=2) / (2 * E)
    reached = index.reached(x, logw, E, floor)
    assert set(ids[(true >= floor[:, None]).any(axis=0)]) <= set(reached.tolist())


def test_points_that_bounds_do_not_hold_for():
    phi, _ = blobs(1100, 2)
    x = np.array([[np.nan, 0.0], [np.inf, 0.0], [0.0, 0.0]])
    logw, ids = np.zeros(1100), np.arange(1100)
    got, want = CentreIndex(ids, phi).best(x, logw, 1.0), best_of_block(x, phi, logw, ids, 1.0)
    assert np.array_equal(got[1], want[1]) and np.array_equal(got[0], want[0], equal_nan=True)


def test_twenty_thousand_centres_skip_most_products(spark):
    phi, r = blobs(20000, 8)
    x = phi[r.integers(0, 20000, 2000)] + r.normal(0, 0.3, (2000, 8))
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, x array<double>")
    model = spark.createDataFrame([(i, v.tolist(), 0.0) for i, v in enumerate(phi)], "cluster_id int, phi array<double>, logw double")
    rep = S.pruning_report(pts, model, 1.0).first()
    assert rep["products"] == 2000 * 20000 and rep["computed"] < 0.2 * rep["products"]
    got = {r["point_id"]: r["cluster_id"] for r in S.best_cluster(pts, model, 1.0).collect()}
    want = best_of_block(x, phi, np.zeros(20000), np.arange(20000), 1.0)[1]
    assert got == dict(enumerate(want.tolist()))


def test_blocks_of_a_large_model_carry_the_best(spark, monkeypatch):
    phi, r = blobs(3000, 2, seed=4)
    x = phi[r.integers(0, 3000, 300)] + r.normal(0, 0.3, (300, 2))
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, x array<double>")
    model = spark.createDataFrame([(i, v.tolist(), float(w)) for i, (v, w) in enumerate(zip(phi, r.normal(size=3000)))], "cluster_id int, phi array<double>, logw double")
    one = S.best_cluster(pts, model, 0.1, with_score=True, with_resid=True).orderBy("point_id").collect()
    many = S.best_cluster(pts, model, 0.1, with_score=True, with_resid=True, max_model_bytes=20000).orderBy("point_id").collect()
    monkeypatch.setattr(S, "INDEX_CENTRES", 10**9)
    full = S.best_cluster(pts, model, 0.1, with_score=True, with_resid=True).orderBy("point_id").collect()
    assert one == many == full


def test_empty_blocks_are_left_out(spark):
    model = spark.createDataFrame([(4 * i, [float(i), 0.0], 0.0) for i in range(300)], "cluster_id int, phi array<double>, logw double")
    pts = spark.createDataFrame([(0, [7.2, 0.0])], "point_id long, x array<double>")
    assert S.best_cluster(pts, model, 1.0, max_model_bytes=4000).first()["cluster_id"] == 28
    assert S.best_cluster(pts, model.withColumn("logw", F.lit(0.0)), 1.0).first()["cluster_id"] == 28
