"""What a sweep computes for a point, and that leaving the rest out changes nothing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixshard.functions.draws import PointDraws
from mixshard.operators import sweep as sw
from mixshard.params import DPMParams


def clustered(n, d, k, seed=3):
    r = np.random.default_rng(seed)
    phi = r.normal(0, 4, (k, d))
    return phi[r.integers(0, k, n)] + r.normal(0, 0.4, (n, d)), phi


def swept(X, phi, p, prune):
    xn, k = (X * X).sum(1), len(phi)
    st = sw._State(phi, np.full(k, 1 / (k + 1)))
    c = sw._initial_pass(X, xn, st, p.alpha0, p.E)
    draws = PointDraws(p.seed, 0, 9, np.arange(len(X)))
    asked, inner = [], draws.candidates

    def counted(sweep, at, count, dim):
        z, chi = inner(sweep, at, count, dim)
        asked.append(len(z))
        return z, chi

    draws.candidates = counted
    a, bu = sw._sweeps(X, xn, c, st, p.alpha0, 1 / (k + 1), 1.0, p, draws, prune=prune)
    return sum(asked), (c.tolist(), st.size[: st.k].tolist(), st.phi[: st.k].tolist(), a, bu)


@pytest.mark.parametrize("d", [1, 2, 5])
def test_candidates_are_drawn_only_where_one_could_win(d):
    X, phi = clustered(6000, d, 6)
    X[::500] += 30.0  # a few that open clusters
    p = DPMParams(E=0.2, S=20.0, seed=5, local_sweeps=4)
    few, got = swept(X, phi, p, True)
    every, want = swept(X, phi, p, False)
    assert got == want
    assert every == 4 * 6000 and few < every / 2


@pytest.mark.parametrize("k", [1, 5, 60])
def test_first_pass_places_points_one_after_the_other(k):
    X, phi = clustered(3000, 2, k)
    beta = np.random.default_rng(1).random(k) * 0.01
    st = sw._State(phi, beta)
    got = sw._initial_pass(X, None, st, 1.0, 0.5)
    sizes, want = np.zeros(k), []
    L = np.concatenate([sw._dist_block(X[s: s + sw.BLOCK], sw._State(phi, beta), k, 0.5) for s in range(0, len(X), sw.BLOCK)])
    for row in L:
        j = int(np.argmax(row + [math.log(v) for v in sizes + beta]))
        sizes[j] += 1
        want.append(j)
    assert got.tolist() == want and st.size[:k].tolist() == sizes.tolist()


def test_points_of_another_dimension_raise(spark):
    pts = spark.createDataFrame([(0, [0.0, 1.0], None, 0), (1, [0.0, 1.0, 2.0], None, 0)], "point_id long, x array<double>, label int, shard int")
    model = spark.sparkContext.broadcast((np.zeros((2, 2)), np.full(2, 0.3)))
    run = lambda df: sw.point_labels(sw.run_sweep(df, None, model, DPMParams(seed=1, local_sweeps=1), 0, 1.0, 0.4)).collect()
    assert len(run(pts.where("point_id = 0"))) == 1
    with pytest.raises(Exception, match="coordinates"):
        run(pts)
    with pytest.raises(Exception, match="coordinates"):
        run(pts.withColumn("x", F.when(F.col("point_id") == 0, F.col("x"))))


def test_the_last_score_is_computed_once(spark, monkeypatch):
    """Both of its figures come from rows written once, not from two runs of the scoring job."""
    from mixshard.plans import fit as ft

    read, quality = [], ft._quality
    monkeypatch.setattr(ft, "_quality", lambda out: (read.append(out._jdf.queryExecution().toString()), quality(out))[1])
    pts = spark.createDataFrame([(i, [float(i % 3), 0.0], i % 3) for i in range(60)], "point_id long, x array<double>, label int")
    ft.fit(pts, DPMParams(E=0.1, S=1.0, seed=2, local_sweeps=1, global_sweeps=1), k_init=3, rounds=1, shards=2)
    assert len(read) == 1 and "FlatMapCoGroupsInPandas" not in read[0]


def test_sizes_of_the_first_centres_are_counted_once(spark):
    from mixshard.operators.kmeans import kmeans_init

    pts = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(30)], "point_id long, x array<double>")
    _, sizes = kmeans_init(pts, 3, seed=1)
    assert sorted(r["size"] for r in sizes.collect()) == [10, 10, 10]
    assert "UDF" not in sizes._jdf.queryExecution().toString()  # no prediction left in its plan
