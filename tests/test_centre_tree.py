"""Search through a tree over many centres of few dimensions against the full product."""

import numpy as np
import pytest

from mixshard.functions.centre_tree import TREE_DIMS, CentreTree
from mixshard.functions.matrix import best_of_block
from mixshard.operators import score as S


@pytest.mark.parametrize("k,d,E,far", [(1, 2, 1.0, 0), (17, 1, 1.0, 0), (2000, 2, 0.05, 0), (1500, 3, 5.0, 1e6), (1200, TREE_DIMS, 0.5, 0)])
@pytest.mark.parametrize("grid", [False, True])
def test_labels_scores_and_ties_are_those_of_the_full_product(k, d, E, far, grid):
    r = np.random.default_rng(k)
    phi = r.normal(0, 5, (k, d))
    x = phi[r.integers(0, k, 600)] + r.normal(0, 0.3, (600, d))
    if grid:  # many points halfway between centres
        phi, x = np.round(phi), np.round(2 * x) / 2
    phi[k - k // 4:] = phi[: k // 4]
    phi, x = phi + far, x + far
    x[:3] = phi[r.integers(0, k, 3)]
    x[3], x[4, 0], x[5, 0], x[6, -1], x[7] = np.nan, np.inf, -np.inf, np.nan, 1e160
    logw = np.zeros(k) if grid else np.where(r.random(k) < 0.1, -np.inf, np.log(r.random(k)))
    ids = np.arange(k) * 3
    with np.errstate(all="ignore"):
        want = best_of_block(x, phi, logw, ids, E)
    got = CentreTree(ids, phi, logw).best(x, E)
    for a, b in zip(got[:3], want[:3]):
        assert np.array_equal(a, b, equal_nan=True)
    floor = want[0] + np.where(np.arange(600) % 2 == 0, 1.0, -1.0)
    above = CentreTree(ids, phi, logw).best(x[8:], E, floor[8:])
    assert np.array_equal(above[1], np.where(np.arange(8, 600) % 2 == 0, -1, want[1][8:]))


def test_no_centre_with_a_weight():
    got = CentreTree(np.arange(5), np.zeros((5, 2)), np.full(5, -np.inf)).best(np.zeros((2, 2)), 1.0)
    assert got[1].tolist() == [0, 0] and (got[0] == -np.inf).all()


@pytest.mark.parametrize("copies", [1, 40])
def test_products_of_a_point_do_not_grow_with_the_centres(spark, copies):
    """The shape of nearest_of_many: most points far from all centres, which may come several times."""
    r = np.random.default_rng(5)
    own = np.column_stack([r.integers(1, 51, 40000 // copies).astype(float), 900 + 100 * r.random(40000 // copies)])
    phi = np.tile(own, (copies, 1))
    x = np.column_stack([r.integers(1, 51, 2000).astype(float), np.exp(r.normal(8, 1, 2000))])
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, x array<double>")
    model = spark.createDataFrame([(i, v.tolist(), 0.0) for i, v in enumerate(phi)], "cluster_id int, phi array<double>, logw double")
    assert S.pruning_report(pts, model, 1.0).first()["computed"] < 60 * 2000
    got = {r["point_id"]: r["cluster_id"] for r in S.nearest_center(pts, model.drop("logw")).collect()}
    d2 = np.array([((own - p) ** 2).sum(axis=1) for p in x])
    assert got == dict(enumerate(d2.argmin(axis=1).tolist()))
