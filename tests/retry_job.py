"""Run by test_task_retry: every sweep task fails on its first attempt; the retried
output must equal a run without failures (keyed seeds make recomputation exact)."""

import os
import sys

import numpy as np
from pyspark import TaskContext
from pyspark.sql import SparkSession

sys.path.insert(0, sys.argv[1])

import mixshard.operators.sweep as sw  # noqa: E402
from mixshard.params import DPMParams  # noqa: E402
from mixshard.plans.fit import prepare_points  # noqa: E402
from mixshard.session import prepare_session  # noqa: E402

spark = (SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
spark.sparkContext.setCheckpointDir(sys.argv[2])
prepare_session(spark)
rng = np.random.default_rng(0)
X = np.r_[rng.normal(-5, 1, (300, 2)), rng.normal(5, 1, (300, 2))]
df = spark.createDataFrame([(i, X[i].tolist(), None) for i in range(600)], "point_id BIGINT, x ARRAY<DOUBLE>, label INT")
table, n, s = prepare_points(df, shards=3)
pts = table.df
b = spark.sparkContext.broadcast((np.array([[0.0, 0.0]]), np.array([0.5])))
p = DPMParams(E=1.0, S=50.0, seed=3)


def rows():
    out = sw.run_sweep(pts, None, b, p, 0, 1.0, 0.5)
    return sorted(map(tuple, sw.point_labels(out).collect()))


clean = rows()
orig = sw.make_sweep_fn
marks = os.path.join(sys.argv[2], "failed-attempts")
os.makedirs(marks, exist_ok=True)


def flaky(*a, **k):
    fn = orig(*a, **k)

    def run(points, labels):
        if TaskContext.get().attemptNumber() == 0:
            open(os.path.join(marks, f"p{TaskContext.get().partitionId()}"), "w").close()
            raise RuntimeError("simulated executor loss")
        return fn(points, labels)

    return run


sw.make_sweep_fn = flaky
retried = rows()
print("SAME" if retried == clean and len(clean) == 600 else "DIFFERENT", "failures", len(os.listdir(marks)))
