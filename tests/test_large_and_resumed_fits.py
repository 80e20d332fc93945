"""Fits whose model the driver does not hold, fits that end and go on, and repeated writes."""

import numpy as np
import pytest
from library_support import planted
from pyspark.sql import functions as F

from mixshard.operators import large_sweep as L
from mixshard.operators.sweep import point_labels, run_sweep
from mixshard.params import DPMParams
from mixshard.plans import fit as fit_module
from mixshard.plans.fit import fit, prepare_points
from mixshard.sources.sinks import committed_rounds, read_rounds, write_round


def rows(res):
    rep = [(r["round"], r["n_clusters"], round(r["gamma"], 12), r["ari"], round(r["rss"], 6)) for r in res.report.orderBy("round").collect()]
    model = [(r["cluster_id"], r["size"], *np.round(r["phi"], 9), round(r["beta"], 12)) for r in res.model.orderBy("cluster_id").collect()]
    states = sorted((r["round"], r["shard"], round(r["alpha"], 12), round(r["beta_u"], 12), r["n"]) for r in res.round_states.collect())
    return rep, model, states, sorted(map(tuple, res.assignments.select("point_id", "shard", "cluster_id").collect()))


@pytest.mark.parametrize("K,E,factor", [(40, 1.0, 1e3), (300, 0.2, 1e3), (300, 0.2, 1.0)])
def test_a_sweep_with_parts_of_the_model_is_the_sweep_with_all(spark, monkeypatch, K, E, factor):
    """Labels, summaries and states; a factor of 1 makes every shard leave the range and report it."""
    r = np.random.default_rng(K)
    cent = r.normal(0, 12.0, (K, 2))
    X = cent[r.integers(0, K, 900)] + r.normal(0, E**0.5, (900, 2))
    pts = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(X)], "point_id BIGINT, x ARRAY<DOUBLE>, label INT")
    table, _, _ = prepare_points(pts, shards=3)
    beta = r.dirichlet(np.ones(K + 1))
    beta[:3] = 0.0  # clusters that no weight allows
    model = spark.createDataFrame([(i, c.tolist(), float(b)) for i, (c, b) in enumerate(zip(cent, beta))], "cluster_id int, phi array<double>, beta double")
    p = DPMParams(E=E, S=150.0, seed=3, local_sweeps=3)
    shared = spark.sparkContext.broadcast((cent, beta[:K]))
    one = run_sweep(table.df, None, shared, p, 0, 1.0, float(beta[K])).collect()
    most = table.df.groupBy("shard").count().agg(F.max("count")).first()[0]
    got = L.run_large_sweep(table.df, None, model, p, 0, 1.0, float(beta[K]), (1 / factor, factor), most, max_model_bytes=2000).collect()
    if factor == 1.0:
        assert {x["kind"] for x in got} == {"x"}
    else:
        assert sorted(map(str, got)) == sorted(map(str, one))
        # the second sweep starts from labels
        out = spark.createDataFrame(one, run_sweep(table.df, None, shared, p, 0, 1.0, 0.1).schema)
        lab = point_labels(out).where(F.col("local_id") < K).withColumnRenamed("local_id", "cluster_id").withColumn("alpha", F.lit(0.7))
        lab = table.df.select("point_id", "shard").join(lab, ["point_id", "shard"], "left").select("point_id", "shard", F.coalesce("cluster_id", F.lit(5)).alias("cluster_id"), F.coalesce("alpha", F.lit(0.7)).alias("alpha"))
        lab = spark.createDataFrame(lab.collect(), lab.schema)
        for mode in ("sweep", "score"):
            a = run_sweep(table.df, lab, shared, p, 1, 1.0, float(beta[K]), mode).collect()
            b = L.run_large_sweep(table.df, lab, model, p, 1, 1.0, float(beta[K]), (1e-3, 1e3), most, mode, max_model_bytes=2000).collect()
            assert sorted(map(str, a)) == sorted(map(str, b))
        assert L.reachable(table.df, model, E, (1e-3, 1e3), most).count() < 3 * K or K == 40
    table.df.unpersist()
    table.drop()


def test_fit_with_a_model_above_the_driver_bound(spark):
    df = planted(spark, n=600, seed=11)
    p = DPMParams(E=1.0, S=100.0, seed=2)
    assert rows(fit(df, p, k_init=5, rounds=2, shards=3)) == rows(fit(df, p, k_init=5, rounds=2, shards=3, max_driver_bytes=10))


def test_sample_mode_needs_the_whole_model(spark):
    with pytest.raises(ValueError, match="sample"):
        fit(planted(spark, n=60), DPMParams(assign="sample"), k_init=2, rounds=1, shards=1, max_driver_bytes=10)


def test_an_ended_fit_goes_on(spark, monkeypatch, tmp_path):
    """Ended in round 1 after round 0 was committed, in a sweep and in a merge."""
    df, p = planted(spark, n=500, seed=8), DPMParams(E=1.0, S=100.0, seed=4)
    whole = rows(fit(df, p, k_init=3, rounds=3, shards=4))
    for name in ("run_sweep", "global_merge"):
        real, calls = getattr(fit_module, name), []

        def ends(*a, real=real, calls=calls, **k):
            calls.append(1)
            if len(calls) == 2:
                raise RuntimeError("lost")
            return real(*a, **k)

        monkeypatch.setattr(fit_module, name, ends)
        path = str(tmp_path / name)
        with pytest.raises(RuntimeError, match="lost"):
            fit(df, p, k_init=3, rounds=3, shards=4, run_dir=path)
        monkeypatch.setattr(fit_module, name, real)
        assert committed_rounds(spark, path, "manifest") == [0]
        never = spark.createDataFrame([], df.schema)  # points are not read again
        res = fit(never, p, k_init=3, rounds=3, shards=4, resume=path)
        assert rows(res) == whole
        assert rows(fit(never, p, k_init=3, rounds=3, resume=path)) == whole  # it had ended: read back
        with pytest.raises(ValueError, match="other parameters"):
            fit(never, p.with_(seed=5), k_init=3, rounds=4, resume=path)
        with pytest.raises(ValueError, match="rounds already"):
            fit(never, p, k_init=3, rounds=2, resume=path)


def test_resume_without_a_committed_round_starts_over(spark, tmp_path):
    df, p = planted(spark, n=200, seed=8), DPMParams(E=1.0, S=100.0, seed=4)
    assert rows(fit(df, p, k_init=3, rounds=1, shards=2, resume=str(tmp_path / "none"))) == rows(fit(df, p, k_init=3, rounds=1, shards=2))


def test_a_round_written_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "run")
    a = spark.range(5).withColumn("v", F.col("id") * 2.0)
    for _ in range(2):
        assert write_round(a, path, "model", 0).count() == 5
        write_round(a.where("id < 2"), path, "model", 1)
    assert sorted(map(tuple, read_rounds(spark, path, "model").groupBy("round").count().collect())) == [(0, 5), (1, 2)]
    (tmp_path / "run" / "model" / "round=1" / "_SUCCESS").unlink()  # a write that did not commit
    assert [r["round"] for r in read_rounds(spark, path, "model").select("round").distinct().collect()] == [0]
    with pytest.raises(FileNotFoundError):
        read_rounds(spark, path, "nothing")
