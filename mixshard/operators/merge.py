"""Deterministic half of the global step: same-id merge, priors, posteriors,
relabelling and dense renumbering.

Summaries are ``(shard, local_id, size, y_mean, phi)``. Ids below K are clusters
of the current global model (the same id in two shards is the same cluster);
ids from K up are clusters a shard opened itself, so they are keyed by
``(shard, local_id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mixshard.functions.vectors import exact_vector_mean, posterior_mean, posterior_var, zero_vector
from mixshard.operators.model import check_broadcast, model_stats
from mixshard.sources.points import _checked

# sub_to_global maps above this many rows are joined by shuffle, not broadcast
MAX_BROADCAST_MAP_ROWS = 5_000_000


def split_known_new(summaries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(known, new): summaries of existing global ids (< K) and of new local clusters (FLT-2)."""
    return summaries.where(F.col("local_id") < k), summaries.where(F.col("local_id") >= k)


def unabsorbed(summaries: DataFrame, absorbed: DataFrame) -> DataFrame:
    """Summaries whose (shard, local_id) is not in ``absorbed`` (JN-6, SET-3)."""
    return summaries.join(absorbed.select("shard", "local_id"), ["shard", "local_id"], "left_anti")


def _dense_new_ids(new: DataFrame, base) -> DataFrame:
    """Ids ``base + rank`` for new summaries in (shard, local_id) order, without a
    single-partition window: per-shard counts (one row per shard) give the offsets."""
    per = new.groupBy("shard").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select("shard", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    rk = F.row_number().over(Window.partitionBy("shard").orderBy("local_id")) - 1
    return (new.join(_checked(offs), "shard")
            .withColumn("ind_id", (base + F.col("_off") + rk).cast("int")).drop("_off"))


def merge_same_id(summaries: DataFrame, k: int, dim: int, model: DataFrame | None, S: float,
                  ) -> tuple[DataFrame, DataFrame]:
    """Same-id merge across shards (CLU-5, AGG-3, AGG-4, SET-2).

    Returns ``individuals(ind_id, size, y_mean, phi, prior_mean, prior_var)`` and the
    flat map ``ind_subs(ind_id, shard, local_id)`` (AGG-9). Known ids are merged by
    a size-weighted mean and take their prior from ``model`` (JN-3), new ones keep
    their own summary with the base prior (0, S). Ids: merged known ids first in id
    order, then new summaries in (shard, local_id) order.
    """
    known, new = split_known_new(summaries, k)
    # the same bits however the summaries are partitioned: later ties rest on these means
    kmerged = exact_vector_mean(known, ["local_id"], "y_mean", dim, w="size", extra=[F.min_by("phi", "shard").alias("phi")])
    if model is not None:
        pri = model.select(F.col("cluster_id").alias("local_id"), "prior_mean", "prior_var")
        if check_broadcast(model_stats(model, "prior_mean")) == 1:  # K rows, size checked
            pri = F.broadcast(pri)
        kmerged = kmerged.join(pri, "local_id", "left")
    else:
        kmerged = (kmerged.withColumn("prior_mean", F.lit(None).cast("array<double>"))
                   .withColumn("prior_var", F.lit(None).cast("double")))
    kmerged = (kmerged.withColumn("prior_mean", F.coalesce("prior_mean", zero_vector(dim)))
               .withColumn("prior_var", F.coalesce("prior_var", F.lit(float(S)))))
    # known ids: at most K rows, so this ranking window is bounded by the model size
    kmerged = kmerged.withColumn("ind_id", (F.dense_rank().over(Window.orderBy("local_id")) - 1).cast("int"))
    n_known = kmerged.agg(F.count(F.lit(1)).alias("_nk")).withColumn("_k", F.lit(0))
    newj = new.withColumn("_k", F.lit(0)).join(F.broadcast(n_known), "_k").drop("_k")
    newi = _dense_new_ids(newj, F.col("_nk")).drop("_nk")
    cols = ["ind_id", "size", "y_mean", "phi", "prior_mean", "prior_var"]
    newi_rows = (newi.withColumn("prior_mean", zero_vector(dim))
                 .withColumn("prior_var", F.lit(float(S))))
    individuals = kmerged.select(*cols).unionByName(newi_rows.select(*cols))
    ksubs = known.join(kmerged.select("local_id", "ind_id"), "local_id").select("ind_id", "shard", "local_id")
    ind_subs = ksubs.unionByName(newi.select("ind_id", "shard", "local_id"))
    return individuals, ind_subs


def posterior_params(df: DataFrame, E: float) -> DataFrame:
    """Posterior variance and mean of each centre given (size, y_mean, prior) (SC-5, SC-6)."""
    v = posterior_var(F.col("size"), E, F.col("prior_var"))
    return (df.withColumn("post_var", v)
            .withColumn("post_mean", posterior_mean("y_mean", "prior_mean", "size", E, "prior_var", "post_var")))


def relabel(assignments: DataFrame, sub_to_global: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_MAP_ROWS
            ) -> DataFrame:
    """Map each point's (shard, local_id) to its global cluster id (CLU-7, JN-2, FLT-4).

    The map has one row per summary; it is broadcast below a checked row count,
    else joined by shuffle.
    """
    m = sub_to_global.select("shard", "local_id", "cluster_id")
    if sub_to_global.count() <= max_broadcast_rows:
        m = F.broadcast(m)
    return assignments.join(m, ["shard", "local_id"]).drop("local_id")


def dense_cluster_ids(model: DataFrame, size: str = "size") -> DataFrame:
    """Drop empty clusters and renumber ids densely from 0 (FLT-1, WIN-3, AGG-10).

    The model has one row per cluster, so the global ranking window stays small.
    """
    keep = model.where(F.col(size) > 0)
    return keep.withColumn("new_id", (F.dense_rank().over(Window.orderBy("cluster_id")) - 1).cast("int"))


def cluster_members(sub_to_global: DataFrame) -> DataFrame:
    """Members of every cluster, one row per (cluster, shard, local_id) with the cluster's number
    of members (AGG-9). The counts are a map-side combined aggregate; no list is built."""
    n = sub_to_global.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_subs"))
    return sub_to_global.select("cluster_id", "shard", "local_id").join(n, "cluster_id")
