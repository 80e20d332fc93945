"""Posterior limits, softmax, log-density, and the candidate-distance shortcut."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixshard.functions.vectors import log_density, posterior_mean, posterior_var, safe_log, sqdist
from mixshard.operators.score import membership, prior_log_weight


def test_posterior_limits(spark):
    df = spark.createDataFrame([(0.0, [2.0, 4.0], [1.0, -1.0]), (1e9, [2.0, 4.0], [1.0, -1.0])],
                               "size DOUBLE, y ARRAY<DOUBLE>, m ARRAY<DOUBLE>")
    r = df.select(posterior_var(F.col("size"), 0.5, 3.0).alias("v")).withColumn("size", F.lit(0.0))
    rows = (df.withColumn("v", posterior_var(F.col("size"), 0.5, 3.0))
            .withColumn("pm", posterior_mean("y", "m", "size", 0.5, 3.0, "v")).collect())
    assert rows[0].v == pytest.approx(3.0) and rows[0].pm == pytest.approx([1.0, -1.0])
    assert rows[1].pm == pytest.approx([2.0, 4.0], rel=1e-6)
    assert r.count() == 2


def test_log_density_matches_closed_form_and_stays_finite(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0]), ([1e4, 0.0], [0.0, 0.0])], "x ARRAY<DOUBLE>, m ARRAY<DOUBLE>")
    out = [r.ld for r in df.select(log_density("x", "m", 2.0).alias("ld")).collect()]
    assert out[0] == pytest.approx(-25.0 / 4.0 - math.log(2 * math.pi * 2.0))
    assert math.isfinite(out[1])  # far outlier: density underflows, its log does not


def test_safe_log_zero(spark):
    r = spark.range(1).select(safe_log(F.lit(0.0)).alias("a"), sqdist(F.array(F.lit(1.0)), F.array(F.lit(4.0))).alias("b")).first()
    assert r.a == float("-inf") and r.b == 9.0


def test_softmax_sums_to_one(spark):
    pts = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "point_id BIGINT, x ARRAY<DOUBLE>")
    model = spark.createDataFrame([(0, [0.0, 0.0], 5.0, 0.3), (1, [10.0, 0.0], 2.0, 0.2), (2, [30.0, 1.0], 0.0, 0.1)],
                                  "cluster_id INT, phi ARRAY<DOUBLE>, size DOUBLE, beta DOUBLE")
    m = membership(pts, prior_log_weight(model, "local", 1.0), 4.0).collect()
    for r in m:
        assert sum(r.probs) == pytest.approx(1.0) and r.cluster_ids == [0, 1, 2]


def test_candidate_distance_shortcut_distribution():
    """||x - sqrt(S) z||^2 via (normal, chi-square) has the law of the direct draw."""
    rng = np.random.default_rng(3)
    d, S = 5, 4.0
    x = np.array([1.0, -2.0, 0.5, 0.0, 3.0])
    z = rng.standard_normal((200_000, d))
    direct = ((x - math.sqrt(S) * z) ** 2).sum(1)
    z1 = rng.standard_normal(200_000)
    chi = rng.chisquare(d - 1, 200_000)
    xn = float(x @ x)
    short = xn - 2 * math.sqrt(S) * math.sqrt(xn) * z1 + S * (z1 ** 2 + chi)
    for q in (0.1, 0.5, 0.9):
        assert np.quantile(short, q) == pytest.approx(np.quantile(direct, q), rel=0.02)


def test_blocked_scoring_equals_single_broadcast(spark):
    """A model over the broadcast bound is scored in blocks; same argmax and probability."""
    from mixshard.operators.score import best_cluster

    rng = np.random.default_rng(2)
    pts = spark.createDataFrame([(i, rng.normal(0, 3, 4).tolist()) for i in range(300)], "point_id BIGINT, x ARRAY<DOUBLE>")
    model = spark.createDataFrame([(k, rng.normal(0, 3, 4).tolist(), float(k + 1), 0.05) for k in range(40)],
                                  "cluster_id INT, phi ARRAY<DOUBLE>, size DOUBLE, beta DOUBLE")
    m = prior_log_weight(model, "local", 1.0)
    one = {r.point_id: (r.cluster_id, r.prob) for r in best_cluster(pts, m, 2.0, with_prob=True).collect()}
    blk = {r.point_id: (r.cluster_id, r.prob)
           for r in best_cluster(pts, m, 2.0, with_prob=True, max_model_bytes=500).collect()}
    assert one.keys() == blk.keys()
    for k in one:
        assert one[k][0] == blk[k][0] and one[k][1] == pytest.approx(blk[k][1], rel=1e-9)


def test_blocked_scoring_of_summaries_with_repeated_ids(spark):
    """Blocks carry the best in the row: no key, so ids that repeat across shards are safe; with
    score, probability, residual, all probabilities and distances."""
    from mixshard.operators.score import best_cluster, membership, squared_distances

    rng = np.random.default_rng(8)
    rows = [(s, i, rng.normal(0, 2, 3).tolist()) for s in range(3) for i in range(5)]
    pts = spark.createDataFrame(rows, "shard INT, local_id INT, y_mean ARRAY<DOUBLE>")
    model = spark.createDataFrame([(k, rng.normal(0, 2, 3).tolist(), float(k + 1), 0.05) for k in range(90)], "cluster_id INT, phi ARRAY<DOUBLE>, size DOUBLE, beta DOUBLE")
    m = prior_log_weight(model, "global")
    mr = sorted(m.collect(), key=lambda r: r.cluster_id)
    phi, logw = np.array([r.phi for r in mr]), np.array([r.logw for r in mr])
    for bound in (10**9, 700):
        got = {(r.shard, r.local_id): r for r in best_cluster(pts, m, 2.0, x="y_mean", with_score=True, with_prob=True, with_resid=True, max_model_bytes=bound).collect()}
        probs = {(r.shard, r.local_id): r for r in membership(pts, m, 2.0, x="y_mean", max_model_bytes=bound).collect()}
        dist = {(r.shard, r.local_id): r for r in squared_distances(pts, m, x="y_mean", max_model_bytes=bound).collect()}
        for s, i, y in rows:
            d2 = ((np.array(y) - phi) ** 2).sum(1)
            sc = logw - d2 / 4.0
            p = np.exp(sc - sc.max())
            p /= p.sum()
            r = got[s, i]
            assert r.cluster_id == sc.argmax() and r.score == pytest.approx(sc.max()) and r.prob == pytest.approx(p.max()) and r.resid == pytest.approx(d2[sc.argmax()] / 2.0)
            assert probs[s, i].cluster_ids == list(range(90)) and probs[s, i].probs == pytest.approx(p.tolist())
            assert dist[s, i].sqdists == pytest.approx(d2.tolist())


@pytest.mark.parametrize("offset", [0.0, 1e4, 1e7, 1e8])
def test_product_scores_equal_direct_scores_far_from_the_origin(offset):
    from mixshard.functions.matrix import best_of_block

    rng = np.random.default_rng(3)
    phi = offset + rng.normal(0, 0.5, (40, 3))
    x = phi[rng.integers(40, size=2000)] + rng.normal(0, 0.1, (2000, 3))
    logw = np.log(rng.integers(1, 50, 40).astype(float))
    _, got, d2, _ = best_of_block(x, phi, logw, np.arange(40), 0.01)
    direct = ((x[:, None, :] - phi[None]) ** 2).sum(2)
    want = (logw - direct / 0.02).argmax(1)
    assert (got == want).all() and d2 == pytest.approx(direct[np.arange(2000), want])


@pytest.mark.parametrize("offset", [1e7, 1e8])
def test_sweep_distances_far_from_the_origin(offset):
    from mixshard.operators.sweep import _dist_block, _State

    rng = np.random.default_rng(4)
    phi = offset + np.array([[0.0, 0.0], [0.5, 0.0], [0.0, 0.5]])
    x = phi[rng.integers(3, size=2000)] + rng.normal(0, 0.1, (2000, 2))
    st = _State(phi, np.full(3, 0.3))
    st.add(phi[0] + 0.7, 0.1, 1.0)
    got = _dist_block(x, st, 4, 0.01)
    want = -((x[:, None, :] - st.phi[None, :4]) ** 2).sum(2) / 0.02
    assert (got.argmax(1) == want.argmax(1)).all()


def test_keyed_normal_vector_moments_and_keys(spark):
    from mixshard.functions.draws import keyed_normal_vector

    df = spark.range(20_000).select(keyed_normal_vector(F.array(F.lit(2.0), F.lit(-1.0)), F.lit(4.0), 1, 2, F.col("id")).alias("v"), "id")
    r = df.agg(F.avg(F.col("v")[0]).alias("m"), F.variance(F.col("v")[1]).alias("s"), F.corr(F.col("v")[0], F.col("v")[1]).alias("c")).first()
    assert r.m == pytest.approx(2.0, abs=0.05) and r.s == pytest.approx(4.0, rel=0.05) and abs(r.c) < 0.03
    again = df.repartition(3).select(keyed_normal_vector(F.array(F.lit(2.0), F.lit(-1.0)), F.lit(4.0), 1, 2, F.col("id")).alias("w"), "v")
    assert again.where("v <> w").count() == 0



def test_carried_residual_equals_join(spark):
    """resid carried through the argmax == residual joined back from the model, in all three plans."""
    from mixshard.operators.evaluate import residual_sum
    from mixshard.operators.score import best_cluster

    rng = np.random.default_rng(6)
    pts = spark.createDataFrame([(i, rng.normal(0, 3, 4).tolist()) for i in range(200)], "point_id BIGINT, x ARRAY<DOUBLE>")
    for k in (5, 80):  # unrolled (K x d = 20) and one-row broadcast (K x d = 320)
        model = spark.createDataFrame([(j, rng.normal(0, 3, 4).tolist(), 3.0, 0.01) for j in range(k)],
                                      "cluster_id INT, phi ARRAY<DOUBLE>, size DOUBLE, beta DOUBLE")
        m = prior_log_weight(model, "local", 1.0)
        for bound in (None, 600):
            kw = {} if bound is None else {"max_model_bytes": bound}
            a = best_cluster(pts, m, 2.0, with_resid=True, **kw)
            carried = a.agg(F.sum("resid")).first()[0]
            joined = residual_sum(a.drop("resid"), model, 2.0).first()["rss"]
            assert carried == pytest.approx(joined, rel=1e-12)


def test_wide_vectors_aggregate_alike(spark, monkeypatch):
    """The Summarizer form above WIDE_DIM equals one aggregate per coordinate."""
    import mixshard.functions.vectors as V

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(rng.integers(3)), float(rng.integers(1, 9)), rng.normal(size=5).tolist()) for _ in range(100)], "g INT, w DOUBLE, y ARRAY<DOUBLE>")
    got = []
    for wide in (256, 2):
        monkeypatch.setattr(V, "WIDE_DIM", wide)
        a = {r.g: (r["size"], r.y_mean) for r in V.vector_mean(df, ["g"], "y", 5).collect()}
        b = {r.g: (r["size"], r.y_mean, r.top) for r in V.vector_weighted_mean(df, ["g"], "y", "w", 5, extra=[F.max("w").alias("top")]).collect()}
        got.append((a, b))
    for g in range(3):
        assert got[0][0][g][0] == got[1][0][g][0] and got[0][0][g][1] == pytest.approx(got[1][0][g][1])
        assert got[0][1][g][0] == pytest.approx(got[1][1][g][0]) and got[0][1][g][1] == pytest.approx(got[1][1][g][1]) and got[0][1][g][2] == got[1][1][g][2]
