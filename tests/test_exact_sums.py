"""Means that are the same bits for every partitioning."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixshard.functions import vectors as V


def table(spark, n=800, d=3, seed=0, spread=12.0):
    r = np.random.default_rng(seed)
    rows = [(int(r.integers(0, 3)), (r.normal(size=d) * 10.0 ** r.uniform(-spread, spread, d)).tolist(), float(r.integers(1, 50)) / 7.0) for _ in range(n)]
    rows += [(g, [-v for v in x], w) for g, x, w in rows[: n // 2]]  # most of it cancels
    return rows, spark.createDataFrame(rows, "g int, x array<double>, w double")


@pytest.mark.parametrize("weighted,wide", [(False, 256), (True, 256), (True, 1)])
def test_same_bits_over_partitions_and_orders(spark, monkeypatch, weighted, wide):
    rows, df = table(spark)
    monkeypatch.setattr(V, "WIDE_DIM", wide)
    seen = set()
    for parts in (1, 7, 40):
        for seed in (1, 2):
            shuffled = df.repartition(parts, F.rand(seed)).sortWithinPartitions(F.rand(seed + 10))
            m = V.exact_vector_mean(shuffled, ["g"], "x", 3, w="w" if weighted else None)
            seen.add(tuple(sorted((r["g"], r["size"], tuple(v.hex() for v in r["y_mean"])) for r in m.collect())))
    assert len(seen) == 1
    for g, size, mean in next(iter(seen)):
        own = [(x, w if weighted else 1.0) for k, x, w in rows if k == g]
        assert size == pytest.approx(sum(w for _, w in own))
        for i, v in enumerate(mean):
            exact = sum(Fraction(w * x[i]) for x, w in own)
            largest = max(abs(w * x[i]) for x, w in own)
            assert abs(Fraction(float.fromhex(v)) * Fraction(size) - exact) <= Fraction(largest) * Fraction(2) ** -50


def test_plain_sums_do_depend_on_the_order(spark):
    """What the exact form is for."""
    _, df = table(spark)
    seen = {tuple(sorted((r["g"], tuple(v.hex() for v in r["y_mean"])) for r in V.vector_mean(df.repartition(p, F.rand(1)), ["g"], "x", 3).collect())) for p in (1, 7, 40)}
    assert len(seen) > 1


def test_extremes(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (1, [-1e300, 0.0]), (1, [3.0, 5e-324])], "g int, x array<double>")
    assert V.exact_vector_mean(df, ["g"], "x", 2).first()["y_mean"][0] == pytest.approx(0.0, abs=1e285)
    zero = spark.createDataFrame([(1, [0.0, 0.0])], "g int, x array<double>")
    assert V.exact_vector_mean(zero, ["g"], "x", 2).first()["y_mean"] == [0.0, 0.0]
    odd = spark.createDataFrame([(1, [float("inf"), 1.0]), (1, [2.0, 2.0])], "g int, x array<double>")
    assert V.exact_vector_mean(odd, ["g"], "x", 2).first()["y_mean"] == [float("inf"), 1.5]
    assert V.exact_vector_mean(zero.where("false"), ["g"], "x", 2).count() == 0
