"""Operator 13 against plain numpy and exact fractions."""

from fractions import Fraction

import numpy as np
import pytest

from mixshard.llm import whitening as W


def brute(rows):
    """{row position: (n, deviation)}, covariance in extended precision, fit list."""
    keep = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = {tuple(int(np.floor(64.0 * float(c))) + 1000000 for c in v) for _, v in keep}
    n, d = len(x), len(next(iter(x)))
    s = [sum(v[k] for v in x) for k in range(d)]
    z = np.array([[n * v[k] - s[k] for k in range(d)] for v in x], object)
    cov = np.array([[W._wide(Fraction(g, n**3)) for g in row] for row in z.T @ z])
    return keep, x, n, s, cov


def check(got, rows, components=W.COMPONENTS):
    keep, x, n, s, cov = brute(rows)
    d = len(s)
    k = min(d, components)
    lam, vec = np.linalg.eigh(cov.astype(np.float64))
    lam, vec = lam[::-1], vec[:, ::-1]
    assert len(got) == len(keep) * k
    by = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c, found in by.items():
        sign = None
        for i, v in keep:
            g = [int(np.floor(64.0 * float(e))) + 1000000 for e in v]
            r = found[i][0]
            assert r["n"] == n
            assert r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(g, s))
            assert abs(r["explained"] - lam[c - 1] / lam.sum()) <= 1e-10
            want = float(np.array([float(Fraction(a) - Fraction(b, n)) for a, b in zip(g, s)]) @ vec[:, c - 1] / np.sqrt(lam[c - 1]))
            if sign is None and abs(want) > 1e-3:
                sign = np.sign(want * r["whitened"])
            assert abs(r["whitened"] * (sign or 1) - want) < 1e-8
            assert r["identity_error"] < 1e-10


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS x", "'q' AS component", "2.0 AS n")


def test_against_numpy(spark):
    r = np.random.default_rng(1)
    rows = [(i, (r.normal(size=6) * [5, 4, 3, 2, 1, .5] + 3).astype(np.float32).tolist()) for i in range(200)]
    rows += [(300 + i, rows[i][1]) for i in range(50)] + [(400, None), (401, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (402, [float("nan")] + [0.0] * 5), (403, [float("inf")] + [0.0] * 5)]
    check(W.whiten(spark, table(spark, rows)).collect(), rows)
    check(W.whiten(spark, table(spark, rows), components=2).collect(), rows, 2)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(W.q_whitening(spark, "/root/testdata/sf0.001").collect(), [(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_fit_does_not_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = W.usable(df).select(W.grid().alias("x")).distinct()
    one, many = (W.fit(x.repartition(k), 64) for k in (1, 23))
    assert one.sums == many.sums
    assert (one.projection == many.projection).all()


def test_refinement_reaches_extended_precision():
    r = np.random.default_rng(4)
    for d in (1, 2, 7, 64):
        q = np.linalg.qr(r.normal(size=(d, d)))[0].astype(W.Wide)
        a = (q * np.linspace(1, 100, d).astype(W.Wide)) @ q.T
        a = (a + a.T) / 2
        lam, x = W.eigen(a)
        assert np.abs(a @ x - x * lam).max() < 1e-15 * 100
        assert np.abs(x.T @ x - np.eye(d)).max() < 1e-16
        assert (np.diff(lam) <= 0).all()


@pytest.mark.parametrize("gap", [0.0, 1e-14, 1e-11, 1e-9, 1e-7, 1e-5])
def test_clustered_eigenvalues(gap):
    """Three clusters, one of them the whole lower half: vectors stay orthonormal and exact."""
    r = np.random.default_rng(2)
    lam = np.array([9, 9 + gap, 9 + 2 * gap, 5, 5 + gap, 4] + [1 + i * gap for i in range(10)], np.float64).astype(W.Wide)
    q = np.linalg.qr(r.normal(size=(16, 16)))[0].astype(W.Wide)
    for _ in range(3):
        q = q + q @ (np.eye(16, dtype=W.Wide) - q.T @ q) / 2
    a = (q * lam) @ q.T
    a = (a + a.T) / 2
    got, x = W.eigen(a)
    assert np.abs(np.sort(got) - np.sort(lam)).max() < 1e-16
    assert np.abs(x.T @ x - np.eye(16)).max() < 1e-16
    assert np.abs(a @ x - x * got).max() < 1e-16


def test_edge_cases(spark):
    assert W.whiten(spark, table(spark, [])).collect() == []
    assert W.whiten(spark, table(spark, [(1, None), (2, []), (3, [None])])).collect() == []
    got = W.whiten(spark, table(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, None, None, None)] * 4
    # two points: one direction with variance, one without
    got = W.whiten(spark, table(spark, [(1, [0.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0])])).collect()
    assert {(r["vec_id"], r["component"], None if r["whitened"] is None else abs(r["whitened"]), r["explained"]) for r in got} == {
        (1, 1, 1.0, 1.0), (1, 2, None, 0.0), (2, 1, 1.0, 1.0), (2, 2, None, 0.0)}
    # lengths are fitted by themselves
    got = W.whiten(spark, table(spark, [(1, [0.0]), (2, [2.0]), (3, [1.0, 1.0])])).collect()
    assert {(r["vec_id"], r["n"]) for r in got} == {(1, 2), (2, 2), (3, 1)}


def test_products_are_exact():
    r = np.random.default_rng(3)
    for top in (3, 10**5, 10**7, 10**9):
        z = r.integers(-top, top, (300, 4))
        w = z.astype(object)
        assert (W.products(z).astype(object) == w.T @ w).all()


def test_deviation_beyond_a_long():
    m = W.Fit(10**6, [0, 0], np.eye(2), np.array([1.0, 1.0]), 2.0)
    assert m.deviation(np.array([[1000, 2000]])).tolist() == [5 * 10**18]
    with pytest.raises(OverflowError):
        m.deviation(np.array([[10**6, 0]]))
