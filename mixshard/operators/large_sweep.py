"""Local sweeps with a model that the driver does not hold (CLU-4, CLU-8).

A point can only ever choose a cluster near it. While a shard is swept, a cluster's weight
ln(size + alpha beta) lies between ln(a beta) and ln(n + b beta) for n points of the shard and
concentrations within [a, b]. So a cluster whose score under its largest weight stays below
some other's under its smallest is never chosen, in any order of moves. The model goes past
the points in byte-checked blocks, twice: the best smallest score of each point travels in
its row from block to block, then every block names the clusters that reach it. Each shard
gets those rows of the model, and sweeps as it would with all of them.

The range of the concentration is an assumption that every shard checks as it draws; a shard
that leaves it reports so, and the sweep is run again with a wider one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixshard.functions.centre_index import CentreIndex
from mixshard.functions.frames import conform
from mixshard.functions.vectors import safe_log
from mixshard.operators.model import MAX_MODEL_BYTES, ModelStats, model_stats
from mixshard.operators.score import _model_blocks, best_cluster
from mixshard.operators.sweep import SWEEP_SCHEMA, make_sweep_fn
from mixshard.params import DPMParams
from mixshard.session import cut, delete_path, prepare_session

#: The concentration may grow or shrink by this factor before a sweep is run again.
ALPHA_FACTOR = 1e3


def reachable(points: DataFrame, model: DataFrame, E: float, alphas: tuple[float, float], most_points: int,
              max_model_bytes: int = MAX_MODEL_BYTES, stats: ModelStats | None = None) -> DataFrame:
    """(shard, cluster_id): every cluster of ``model`` that a point of the shard may choose while
    its shard of at most ``most_points`` points is swept with concentrations within ``alphas``."""
    spark = points.sparkSession
    low = model.select("cluster_id", "phi", safe_log(F.lit(float(alphas[0])) * F.col("beta")).alias("logw"))
    high = model.select("cluster_id", "phi", safe_log(F.lit(float(most_points)) + F.lit(float(alphas[1])) * F.col("beta")).alias("logw"))
    floor = cut(best_cluster(points.select("shard", "x"), low, E, with_score=True, max_model_bytes=max_model_bytes).select("shard", "x", "score"), "sweep-floor")
    out = None
    for data in _model_blocks(high, stats or model_stats(model), max_model_bytes):
        ids, phi, logw = data.value
        part = floor.mapInArrow(_reached_fn(spark.sparkContext.broadcast((CentreIndex(ids, phi), logw)), E), "shard int, cluster_id int")
        data.destroy()
        out = part if out is None else out.unionByName(part)
    pairs = cut(out.distinct(), "sweep-reach")
    delete_path(spark, floor._cut_path)
    return pairs


def _reached_fn(shared, E: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, logw = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            shard, floor = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            for s in np.unique(shard):
                own = shard == s
                ids = index.reached(x[own], logw, E, floor[own])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), s, np.int32)), pa.array(ids.astype(np.int32))], names=["shard", "cluster_id"])

    return run



def run_large_sweep(points: DataFrame, labels: DataFrame | None, model: DataFrame, p: DPMParams, round_: int, gamma: float, beta_u: float,
                    alphas: tuple[float, float], most_points: int, mode: str = "sweep", max_model_bytes: int = MAX_MODEL_BYTES) -> DataFrame:
    """``run_sweep`` for a model table of any size: same rows. Shards meet their part of the model
    in a co-group; only that side is shuffled, points keep their buckets. A row of kind ``x``
    says that a shard left ``alphas`` (see ``large_sweep``)."""
    if p.assign != "argmax":
        raise ValueError("assign='sample' may choose any cluster: it needs a model within the driver bound")
    prepare_session(points.sparkSession)
    stats = model_stats(model)
    pairs = None if mode == "score" else reachable(points, model, p.E, alphas, most_points, max_model_bytes, stats)
    if labels is not None:
        held = labels.select("shard", "cluster_id").distinct()
        pairs = held if pairs is None else pairs.unionByName(held).distinct()
    none = lambda k: F.lit(None).cast(k)
    other = pairs.join(model.select("cluster_id", "phi", "beta"), "cluster_id").select("shard", "cluster_id", none("long").alias("point_id"), none("double").alias("alpha"), "phi", "beta")
    if labels is not None:
        other = other.unionByName(labels.select("shard", "cluster_id", "point_id", "alpha", none("array<double>").alias("phi"), none("double").alias("beta")))
    fn = make_sweep_fn(None, p, round_, gamma, beta_u, mode, stats.n_clusters, None if mode == "score" else alphas)
    labelled = labels is not None

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        own = b[b["point_id"].isna()].sort_values("cluster_id")
        phi = np.stack(own["phi"].to_numpy()).astype(float) if len(own) else np.empty((0, 0))
        lab = b[b["point_id"].notna()].astype({"point_id": np.int64}) if labelled else None
        return conform(fn(a, lab, (own["cluster_id"].to_numpy(np.int64), phi, own["beta"].to_numpy(float))), SWEEP_SCHEMA)

    pts = points.select("point_id", "shard", "x", "label")
    return pts.groupBy("shard").cogroup(other.groupBy("shard")).applyInPandas(run, SWEEP_SCHEMA)
