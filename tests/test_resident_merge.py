"""The merge with one job a sweep against the merge through written tables."""

import numpy as np
import pytest

from mixshard.operators import resident_merge as R
from mixshard.operators.global_merge import global_merge
from mixshard.params import DPMParams

SCHEMA = "ind_id INT, size DOUBLE, y_mean ARRAY<DOUBLE>, phi ARRAY<DOUBLE>, prior_mean ARRAY<DOUBLE>, prior_var DOUBLE"


def individuals(spark, m=150, d=2, seed=0, gaps=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(m):
        y = rng.normal(0, 4.0, d)
        rows.append((i * gaps, float(rng.integers(1, 40)), y.tolist(), (y + rng.normal(0, 0.3, d)).tolist(), rng.normal(0, 1, d).tolist(), float(rng.uniform(5, 20))))
    return spark.createDataFrame(rows, SCHEMA)


def result(ind, p, **kw):
    model, mem, gamma = global_merge(ind, p, 1.0, 4000, 0, **kw)
    return sorted(map(tuple, mem.collect())), sorted(model.collect(), key=lambda r: r.cluster_id), gamma


def same(a, b, tol=1e-10):
    assert a[0] == b[0]
    assert a[2] == pytest.approx(b[2], rel=1e-12)
    for x, y in zip(a[1], b[1], strict=True):
        assert x.cluster_id == y.cluster_id and x.size == y.size
        for f in ("y_mean", "phi", "prior_mean", "prior_var"):
            assert np.allclose(x[f], y[f], rtol=0, atol=tol)


@pytest.mark.parametrize("seed", range(4))
def test_same_model_as_the_written_form(spark, seed):
    ind = individuals(spark, seed=seed, d=1 + seed, gaps=1 + seed % 2)
    p = DPMParams(E=1.0, S=20.0, seed=seed, global_sweeps=4, assign="sample" if seed == 3 else "argmax")
    same(result(ind, p), result(ind, p, resident_max=0))


def test_bit_equal_for_every_partitioning_and_window(spark, monkeypatch):
    ind = individuals(spark, m=120, seed=7)
    p = DPMParams(E=1.0, S=20.0, seed=7, global_sweeps=6)
    got = []
    for products, window in ((10**9, 8), (500, 1), (4000, 3)):
        monkeypatch.setattr(R, "TASK_PRODUCTS", products)
        monkeypatch.setattr(R, "WINDOW", window)
        got.append(result(ind.repartition(5), p))
    assert got[0] == got[1] == got[2]


def test_one_job_a_sweep(spark, monkeypatch):
    """A sweep is one collect; only every WINDOW sweeps the assignment is written."""
    calls = {"refresh": 0, "write": 0}
    for name in calls:
        f = getattr(R.ResidentMerge, name)
        monkeypatch.setattr(R.ResidentMerge, name, lambda self, *a, f=f, name=name: calls.__setitem__(name, calls[name] + 1) or f(self, *a))
    model, _, _ = global_merge(individuals(spark, m=30), DPMParams(E=1.0, S=20.0, seed=1, global_sweeps=20), 1.0, 4000, 0)
    assert calls == {"refresh": 21, "write": 3}  # twice on the way (after 8 and 16 sweeps) and at the end
    assert model.count() > 0


def test_quiet_sweeps_end_early(spark, monkeypatch):
    ind = spark.createDataFrame([(i, 10.0, [100.0 * i, 0.0], [100.0 * i, 0.0], [0.0, 0.0], 1e4) for i in range(4)], SCHEMA)
    steps = []
    add = R.ResidentMerge.add
    monkeypatch.setattr(R.ResidentMerge, "add", lambda self, *a: steps.append(1) or add(self, *a))
    for quiet, want in ((None, 5), (2, 2)):
        steps.clear()
        model, _, _ = global_merge(ind, DPMParams(E=1.0, S=1e4, seed=1, global_sweeps=5, quiet_sweeps=quiet), 1.0, 40, 0)
        assert len(steps) == want and model.count() == 4


def test_byte_bound_admits_the_form():
    assert R.resident_bytes(200, 2) < R.RESIDENT_BYTES < R.resident_bytes(10**6, 64)


def test_no_individuals(spark):
    with pytest.raises(ValueError, match="no individuals"):
        global_merge(individuals(spark, m=1).where("false"), DPMParams(), 1.0, 1, 0)


def test_one_individual(spark):
    model, mem, _ = global_merge(individuals(spark, m=1), DPMParams(E=1.0, S=20.0, global_sweeps=3), 1.0, 1, 0)
    assert model.count() == 1 and [tuple(r) for r in mem.collect()] == [(0, 0)]
