"""Sinks: tables of one partition a round, safe to write again, and plain-text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_round(df: DataFrame, run_dir: str, name: str, round_: int) -> DataFrame:
    """One round's rows of the table ``name`` (SNK-1, SNK-3): its partition is replaced as a whole,
    so writing a round again leaves one copy. Returns the rows read back."""
    path = f"{run_dir}/{name}/round={round_}"
    df.drop("round").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.drop("round").schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def committed_rounds(spark: SparkSession, run_dir: str, name: str) -> list[int]:
    """Rounds of the table whose write was committed (its marker is there), ascending."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{run_dir}/{name}")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()]
    return sorted(int(n[6:]) for n in names if n.startswith("round=") and _exists(spark, f"{run_dir}/{name}/{n}/_SUCCESS"))


def read_rounds(spark: SparkSession, run_dir: str, name: str) -> DataFrame:
    """Every committed round of the table, with its ``round`` as the first column. Raises if there is none."""
    rounds = committed_rounds(spark, run_dir, name)
    if not rounds:
        raise FileNotFoundError(f"no committed round of {name} under {run_dir}")
    df = spark.read.option("basePath", f"{run_dir}/{name}").parquet(*[f"{run_dir}/{name}/round={r}" for r in rounds])
    return df.select(F.col("round").cast("int").alias("round"), *[c for c in df.columns if c != "round"])


def write_assignments_text(assignments: DataFrame, path: str) -> None:
    """One ``point_id cluster_id`` line per point (SNK-2's text form)."""
    (assignments.select(F.concat_ws(" ", F.col("point_id").cast("string"),
                                    F.col("cluster_id").cast("string")).alias("value"))
     .write.mode("overwrite").text(path))


def _joined(v: str):
    return F.array_join(F.transform(v, lambda t: t.cast("string")), " ")


def write_model_text(model: DataFrame, path: str) -> None:
    """One ``cluster_id size phi_1 .. phi_d`` line per cluster (SNK-3's text form)."""
    (model.select(F.concat_ws(" ", F.col("cluster_id").cast("string"), F.col("size").cast("string"), _joined("phi")).alias("value"))
     .write.mode("overwrite").text(path))


def write_rounds_text(models: DataFrame, states: DataFrame, path: str) -> None:
    """The state of every round as text (SNK-3): ``round model cluster_id size gamma | phi | y_mean``
    for each merged cluster and ``round shard shard_id alpha`` for each shard."""
    m = models.select(F.concat(F.concat_ws(" ", F.col("round"), F.lit("model"), "cluster_id", "size", "gamma"), F.lit(" | "), _joined("phi"),
                               F.lit(" | "), _joined("y_mean")).alias("value"))
    s = states.select(F.concat_ws(" ", F.col("round"), F.lit("shard"), "shard", "alpha").alias("value"))
    m.unionByName(s).write.mode("overwrite").text(path)
