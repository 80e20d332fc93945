"""Print the executed physical plans of the hot operators (after one action each).

usage: python tools/show_plans.py [sf_dir]
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")

import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from mixshard.functions.vectors import vector_mean  # noqa: E402
from mixshard.operators.evaluate import adjusted_rand_index, residual_sum  # noqa: E402
from mixshard.operators.merge import relabel  # noqa: E402
from mixshard.operators.score import best_cluster, map_assign, prior_log_weight  # noqa: E402
from mixshard.operators.summarize import expected_weights, shard_summaries  # noqa: E402
from mixshard.operators.sweep import point_labels, run_sweep  # noqa: E402
from mixshard.params import DPMParams  # noqa: E402
from mixshard.plans.catalog import emb_points, label_model  # noqa: E402
from mixshard.plans.fit import prepare_points  # noqa: E402
from mixshard.session import get_session  # noqa: E402
from mixshard.sources.points import points_from_table  # noqa: E402
from mixshard.sources.storage import write_bucketed  # noqa: E402


def show(title, df):
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = re.sub(r"#\d+L?", "", plan)
    print(f"\n=== {title}\n{plan}")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session()
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    raw = points_from_table(li, cols=["l_quantity", "l_discount"], label_col="l_linenumber", scale=True, ids="unique")
    table, n, s = prepare_points(raw, shards=4)
    pts = table.df
    cm = vector_mean(pts, ["label"], "x", 2).select((F.col("label") - 1).alias("cluster_id"),
                                                    F.col("size").cast("double"), F.col("y_mean").alias("phi"))
    model = expected_weights(cm, 1.0).cache()
    show("MAP assignment, small model (unrolled, codegen, no join)", map_assign(pts, model, 0.05))
    emb = emb_points(spark, sf)
    em = prior_log_weight(label_model(emb), "local", 1.0)
    show("MAP assignment, 64-d model (one-row broadcast, higher-order functions)", best_cluster(emb, em, 0.015))
    a = map_assign(pts, model, 0.05)
    show("per-(shard, cluster) means (partial aggregation)", shard_summaries(a, 2))
    show("residual sum (broadcast model join)", residual_sum(a, model.withColumnRenamed("x", "x"), 0.05))
    show("adjusted Rand index (contingency, then one cube)", adjusted_rand_index(a))
    rows = model.orderBy("cluster_id").collect()
    b = spark.sparkContext.broadcast((np.array([r.phi for r in rows]), np.array([r.beta for r in rows])))
    p = DPMParams(E=0.05, S=1.0, seed=1, local_sweeps=1)
    out = write_bucketed(run_sweep(pts, None, b, p, 0, 1.0, 0.1), s, "plans_sweep").df
    m = (out.where("kind = 'c'").select("shard", "local_id")
         .withColumn("cluster_id", F.least(F.col("local_id"), F.lit(len(rows) - 1))))
    lab = relabel(point_labels(out), m).withColumn("alpha", F.lit(1.0))
    show("next-round sweep: co-group of two bucketed tables (no exchange)", run_sweep(pts, lab, b, p, 1, 1.0, 0.1))


if __name__ == "__main__":
    main()
