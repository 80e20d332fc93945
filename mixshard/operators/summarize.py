"""Cluster summaries: sizes, per-shard means, expected weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixshard.functions.vectors import vector_mean


def center_sizes(assigned: DataFrame, centers: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Points per centre, 0 for a centre nobody chose (AGG-1, JN-4).

    Joined on the id, never matched by position.
    """
    counts = assigned.groupBy(F.col(cluster).alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"))
    return (centers.join(counts, "cluster_id", "left")
            .withColumn("size", F.coalesce(F.col("size"), F.lit(0)).cast("double")))


def shard_summaries(assigned: DataFrame, dim: int, cluster: str = "cluster_id", x: str = "x") -> DataFrame:
    """``(shard, local_id, size, y_mean)``: one row per non-empty (shard, cluster) (AGG-2, FLT-1).

    All shards' summaries are one DataFrame (SET-1); a cluster with no points has no row.
    """
    df = assigned.withColumnRenamed(cluster, "local_id")
    res = vector_mean(df, ["shard", "local_id"], x, dim)
    return res.select("shard", F.col("local_id").cast("int"), F.col("size").cast("double"), "y_mean")


def cluster_points(assigned: DataFrame, cluster_id: int, cluster: str = "cluster_id") -> DataFrame:
    """Members of one cluster (FLT-3); in bulk use ``groupBy(cluster)``."""
    return assigned.where(F.col(cluster) == cluster_id)


def expected_weights(sizes: DataFrame, gamma: float) -> DataFrame:
    """Mean of the Dirichlet draw of RND-1: beta_k = size_k/(n+gamma), beta_u = gamma/(n+gamma)."""
    tot = sizes.agg(F.sum("size").alias("_n")).withColumn("_k", F.lit(0))
    j = sizes.withColumn("_k", F.lit(0)).join(F.broadcast(tot), "_k").drop("_k")
    den = F.col("_n") + F.lit(float(gamma))
    return (j.withColumn("beta", F.col("size") / den)
            .withColumn("beta_u", F.lit(float(gamma)) / den).drop("_n"))
