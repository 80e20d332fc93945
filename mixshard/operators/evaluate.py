"""Quality measures: contingency table, adjusted Rand index, residual sum.

The contingency table is aggregated first (map-side partials, K x R rows), and
all margins come from one ``cube`` over that small table, so the points are
read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixshard.functions.vectors import sqdist
from mixshard.operators.model import MAX_MODEL_BYTES, check_broadcast, model_stats
from mixshard.session import cut


def contingency(assigned: DataFrame, cluster: str = "cluster_id", label: str = "label") -> DataFrame:
    """Long-form contingency table ``(cluster_id, label, n)`` over labelled rows (AGG-5)."""
    return (assigned.where(F.col(label).isNotNull())
            .groupBy(F.col(cluster).alias("cluster_id"), F.col(label).alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))


def contingency_wide(ct: DataFrame, labels: list[int]) -> DataFrame:
    """Wide view of the contingency table: one column for each of the given labels."""
    return ct.groupBy("cluster_id").pivot("label", labels).agg(F.sum("n")).na.fill(0)


def contingency_totals(ct: DataFrame) -> DataFrame:
    """Cells, row totals, column totals and the grand total in one pass (AGG-6).

    ``level``: 0 = cell, 1 = cluster total, 2 = label total, 3 = grand total; the
    rolled-up key reads -1 (not NULL) so the table keeps non-null integer keys.
    """
    t = ct.cube("cluster_id", "label").agg(F.sum("n").cast("long").alias("n"),
                                           F.grouping_id().cast("int").alias("level"))
    return t.select(F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"),
                    F.coalesce("label", F.lit(-1)).alias("label"), "n", "level")


def _c2(n):
    n = n.cast("double")  # pair counts in DOUBLE: no 32-bit overflow
    return n * (n - F.lit(1.0)) / F.lit(2.0)


def ari_from_contingency(ct: DataFrame) -> DataFrame:
    """Adjusted Rand index from a contingency table, one row ``(ari, n)`` (AGG-7, SC-4).

    When both partitions are trivial the denominator is 0; the index is then 1.
    """
    t = contingency_totals(ct)
    r = t.agg(
        F.sum(F.when(F.col("level") == 0, _c2(F.col("n")))).alias("idx"),
        F.sum(F.when(F.col("level") == 1, _c2(F.col("n")))).alias("sa"),
        F.sum(F.when(F.col("level") == 2, _c2(F.col("n")))).alias("sb"),
        F.max(F.when(F.col("level") == 3, F.col("n"))).alias("n"),
    )
    exp = F.col("sa") * F.col("sb") / _c2(F.col("n"))
    den = (F.col("sa") + F.col("sb")) / F.lit(2.0) - exp
    ari = F.when(den == 0, F.lit(1.0)).otherwise((F.col("idx") - exp) / den)
    return r.select(ari.alias("ari"), F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def adjusted_rand_index(assigned: DataFrame, cluster: str = "cluster_id", label: str = "label") -> DataFrame:
    return ari_from_contingency(contingency(assigned, cluster, label))


def residuals(assigned: DataFrame, model: DataFrame, E: float, x: str = "x",
              max_model_bytes: int = MAX_MODEL_BYTES) -> DataFrame:
    """``assigned`` plus ``resid = ||x - phi_c||^2 / E`` for its own cluster c (JN-7).

    The model is broadcast when under the byte bound, else joined by shuffle
    (adaptive skew handling splits a hot cluster).
    """
    m = model.select("cluster_id", F.col("phi").alias("_phi"))
    if check_broadcast(model_stats(model), max_model_bytes) == 1:
        m = F.broadcast(m)
    return assigned.join(m, "cluster_id").withColumn("resid", sqdist(F.col(x), F.col("_phi")) / F.lit(E)).drop("_phi")


def residual_sum(assigned: DataFrame, model: DataFrame, E: float, by: list[str] | None = None,
                 x: str = "x") -> DataFrame:
    """Residual sum of squares over E, total or per group such as ``shard`` (AGG-8)."""
    r = residuals(assigned, model, E, x=x)
    if by:
        return r.groupBy(*by).agg(F.sum("resid").alias("rss"))
    return r.agg(F.sum("resid").alias("rss"))


def score_model(assigned: DataFrame, model: DataFrame, E: float, x: str = "x") -> DataFrame:
    """One row ``(n_clusters, ari, rss)`` for an assignment and its model (CLU-9).

    One pass over the points: counts and residual sums per (cluster, label) with map-side
    partials; the index and the total come from those few rows."""
    cells = cut(residuals(assigned, model, E, x=x).groupBy("cluster_id", "label")
                .agg(F.count(F.lit(1)).alias("n"), F.sum("resid").alias("rss")), "cells")
    ari = ari_from_contingency(cells.where(F.col("label").isNotNull()).select("cluster_id", "label", "n")).select("ari")
    rss = cells.agg(F.sum("rss").alias("rss"))
    k = model.agg(F.count(F.lit(1)).cast("int").alias("n_clusters"))
    one = F.lit(0)
    return (k.withColumn("_k", one).join(ari.withColumn("_k", one), "_k")
            .join(rss.withColumn("_k", one), "_k").drop("_k"))
