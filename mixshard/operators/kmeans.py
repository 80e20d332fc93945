"""K-means initial centres (CLU-1) and their sizes (CLU-2, AGG-1, JN-4)."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixshard.operators.summarize import center_sizes
from mixshard.session import cut


def kmeans_init(points: DataFrame, k: int, iters: int = 10, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Fit K-means (k-means|| init) on ``x``; return ``centres(cluster_id, phi)`` and
    ``sizes(cluster_id, size)`` with 0 for a centre that got no point.

    Only the k centres reach the driver (k is a user parameter); sizes are a
    group-by over the predictions, joined to the centres by id.
    """
    spark = points.sparkSession
    feats = points.select(array_to_vector("x").alias("features"))
    km = KMeans(k=k, maxIter=iters, seed=seed, featuresCol="features", predictionCol="cluster_id").fit(feats)
    centres = spark.createDataFrame(
        [(i, [float(v) for v in c]) for i, c in enumerate(km.clusterCenters())],
        "cluster_id INT, phi ARRAY<DOUBLE>",
    )
    pred = km.transform(feats).select(F.col("cluster_id").cast("int"))
    # k rows, written once: a later read of them is not another pass over the points
    return centres, cut(center_sizes(pred, centres), "kmeans-sizes")
