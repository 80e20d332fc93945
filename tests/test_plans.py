"""Plan-shape regressions: the properties the design relies on at scale."""

import numpy as np
from pyspark.sql import functions as F

from library_support import SF_SMALL, planted
from mixshard.operators.score import best_cluster, prior_log_weight
from mixshard.operators.sweep import point_labels, run_sweep
from mixshard.params import DPMParams
from mixshard.plans.fit import prepare_points
from mixshard.sources.points import points_from_table
from mixshard.sources.storage import write_bucketed


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_steady_state_sweep_has_no_shuffle(spark):
    table, n, s = prepare_points(planted(spark, n=300, seed=3), shards=3)
    pts = table.df
    b = spark.sparkContext.broadcast((np.array([[0.0, 0.0], [5.0, 5.0]]), np.array([0.4, 0.4])))
    p = DPMParams(E=1.0, S=100.0, seed=1, local_sweeps=1)
    out = write_bucketed(run_sweep(pts, None, b, p, 0, 1.0, 0.2), s, "plan_test").df
    lab = point_labels(out).withColumnRenamed("local_id", "cluster_id")
    lab = lab.withColumn("cluster_id", F.least(F.col("cluster_id"), F.lit(1))).withColumn("alpha", F.lit(1.0))
    plan = _plan(run_sweep(pts, lab, b, p, 1, 1.0, 0.2))
    assert "FlatMapCoGroupsInPandas" in plan
    assert "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan


def test_source_scan_reads_only_needed_columns(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    p = points_from_table(li, cols=["l_quantity", "l_discount"], id_col="l_orderkey")
    plan = _plan(p)
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_discount:double>" in plan


def test_small_model_scoring_is_join_free_and_codegen(spark):
    pts = planted(spark, n=200, seed=4)
    model = spark.createDataFrame([(0, [0.0, 0.0], 5.0, 0.3), (1, [9.0, 1.0], 5.0, 0.3)],
                                  "cluster_id INT, phi ARRAY<DOUBLE>, size DOUBLE, beta DOUBLE")
    df = best_cluster(pts, prior_log_weight(model, "local", 1.0), 1.0)
    plan = _plan(df)
    assert "Join" not in plan and "ArrayTransform" not in plan and "transform(" not in plan
    assert plan.lstrip().startswith("*(")  # the scoring projection is inside a codegen stage


def test_model_queries_scan_the_points_at_most_twice(spark):
    """The K-row model and the summaries are written once; what is returned reads those."""
    from mixshard.plans import catalog

    for q in (catalog.q_score_model, catalog.q_merge_same_id, catalog.q_posterior_params):
        files = q(spark, SF_SMALL).inputFiles()
        assert not any("embeddings.parquet" in f for f in files), q.__name__


def test_large_model_scoring_is_one_pass_without_exchange(spark):
    pts = planted(spark, n=200, seed=4)
    model = spark.createDataFrame([(k, [float(k), 1.0], 5.0, 0.001) for k in range(300)], "cluster_id INT, phi ARRAY<DOUBLE>, size DOUBLE, beta DOUBLE")
    plan = _plan(best_cluster(pts, prior_log_weight(model, "local", 1.0), 1.0))
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan
