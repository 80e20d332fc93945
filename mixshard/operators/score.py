"""Scoring points (or summaries) against a model: argmax, softmax, distances.

A score is ``logw_k - ||x - phi_k||^2 / (2E)``; ``logw`` is the prior log-weight
of the cluster (``prior_log_weight``). The terms the reference adds that are
equal for every k (``-ln(n-1+alpha)``, the Gaussian constant) cancel in the
argmax and in the softmax and are left out.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from mixshard.functions.centre_index import INDEX_CENTRES, CentreIndex
from mixshard.functions.centre_tree import TREE_DIMS, CentreTree
from mixshard.functions.matrix import best_of_block, exact_sq_distances
from mixshard.functions.vectors import safe_log
from mixshard.operators.model import MAX_MODEL_BYTES, ModelStats, check_broadcast, collect_model, model_arrays, model_stats
from mixshard.session import prepare_session

# Models with at most this many centre coordinates (K x d) are scored with
# unrolled literal arithmetic: plain expressions stay inside whole-stage codegen.
# Above a few hundred terms the optimizer's time on the expression tree outweighs
# the gain, and a matrix product per Arrow batch is faster.
UNROLL_MAX_VALUES = 256


def prior_log_weight(model: DataFrame, mode: str, alpha: float = 1.0) -> DataFrame:
    """Add ``logw`` to a model table (SC-3).

    - ``local``: ln(size + alpha*beta), a point inside a shard (Gibbs weight);
    - ``initial``: ln(alpha*beta), the first pass where every size is 0 (CLU-3a);
    - ``global``: ln(size), a summary against superclusters;
    - ``none``: 0, plain nearest centre (CLU-2).
    """
    a = F.lit(float(alpha))
    if mode == "local":
        w = safe_log(F.col("size") + a * F.col("beta"))
    elif mode == "initial":
        w = safe_log(a * F.col("beta"))
    elif mode == "global":
        w = safe_log(F.col("size"))
    elif mode == "none":
        w = F.lit(0.0)
    else:
        raise ValueError(f"unknown weight mode {mode!r}")
    return model.withColumn("logw", w.cast("double"))


def _unrolled(points: DataFrame, rows: list, E: float, x: str
              ) -> tuple[DataFrame, Column, Column, Column, Column]:
    """Per-cluster distance and score columns over literal centres, then (best id,
    best score, log-sum-exp, best squared distance) over those columns. Staged
    projections, so no score expression is repeated inside another (the optimizer
    does not inline an expensive expression that is used more than once)."""
    xc = F.col(x)
    dcols = []
    for j, r in enumerate(rows):
        d2 = None
        for i, v in enumerate(r["phi"]):
            t = xc[i] - F.lit(float(v))
            t = t * t
            d2 = t if d2 is None else d2 + t
        dcols.append((d2 if d2 is not None else F.lit(0.0)).alias(f"_d{j}"))
    staged = points.select("*", *dcols)
    scols = [(F.lit(float(r["logw"])) - F.col(f"_d{j}") / F.lit(2.0 * E)).alias(f"_s{j}") for j, r in enumerate(rows)]
    staged = staged.select("*", *scols)
    sts = [F.struct(F.col(f"_s{j}").alias("s"), F.lit(-int(r["cluster_id"])).alias("nid"), F.col(f"_d{j}").alias("d2"))
           for j, r in enumerate(rows)]
    best = sts[0] if len(sts) == 1 else F.greatest(*sts)
    staged = staged.withColumn("_best", best)
    bs = F.col("_best.s")
    tot = None
    for j in range(len(rows)):
        e = F.exp(F.col(f"_s{j}") - bs)
        tot = e if tot is None else tot + e
    return staged, (-F.col("_best.nid")).cast("int"), bs, bs + F.ln(tot), F.col("_best.d2")


def _model_blocks(model: DataFrame, stats: ModelStats, max_model_bytes: int):
    """The model's (ids, phi, logw) as broadcast arrays, in blocks that each stay under the
    byte bound: one block at a time is on the driver."""
    blocks = check_broadcast(stats, max_model_bytes)
    m = model.select("cluster_id", "phi", F.col("logw") if "logw" in model.columns else F.lit(0.0).alias("logw"))
    for b in range(blocks):
        part = m if blocks == 1 else m.where(F.pmod(F.col("cluster_id"), F.lit(blocks)) == b)
        arrays = model_arrays(part)
        if len(arrays[0]):
            yield model.sparkSession.sparkContext.broadcast(arrays)


_BEST = "_bs double, _bid long, _bd double, _lse double"


def _indexed(points: DataFrame, model: DataFrame, E: float, x: str, max_model_bytes: int, stats: ModelStats) -> DataFrame:
    """``points`` plus the best cluster's (_bs, _bid, _bd), through an index over each block's
    centres that skips what cannot win; a block starts from the best of the blocks before."""
    cols = points.columns
    at_x = cols.index(x)
    schema = StructType([*points.schema.fields, StructField("_bs", DoubleType()), StructField("_bid", LongType()), StructField("_bd", DoubleType())])
    out = points
    for b, data in enumerate(_model_blocks(model, stats, max_model_bytes)):
        ids, phi, logw = data.value
        shared = points.sparkSession.sparkContext.broadcast(_index_of(ids, phi, logw, E))
        data.destroy()
        out = out.mapInArrow(_index_fn(shared, at_x, len(cols), b == 0, schema.names), schema)
    return out


def _index_of(ids: np.ndarray, phi: np.ndarray, logw: np.ndarray, E: float):
    """The search over a block's centres, a function of points and the scores they have already:
    down a tree in few dimensions, through cells around pivots in many."""
    if phi.shape[1] <= TREE_DIMS and np.isfinite(phi).all() and (logw < np.inf).all():
        return partial(CentreTree(ids, phi, logw).best, E=E)
    return partial(CentreIndex(ids, phi).best, logw=logw, E=E)


def _index_fn(shared, at_x, n_cols, first, names):
    def run(batches):
        best = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            pts = batch.column(at_x).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            old = None if first else [batch.column(n_cols + i).to_numpy(zero_copy_only=False) for i in range(3)]
            bs, bid, bd, _ = best(pts, score=None if first else old[0])
            if not first:
                keep = (bid < 0) | (old[0] > bs) | ((old[0] == bs) & (old[1] < bid)) | (np.isnan(old[0]) & ~np.isnan(bs))
                bs, bid, bd = (np.where(keep, o, v) for o, v in zip(old, (bs, bid, bd)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], pa.array(bs), pa.array(bid, pa.int64()), pa.array(bd)], names=names)

    return run


def pruning_report(points: DataFrame, model: DataFrame, E: float, x: str = "x") -> DataFrame:
    """One row (points, centres, products, computed): how many of the point x centre products the
    index leaves (``model`` as for ``best_cluster``, within the broadcast bound)."""
    stats = model_stats(model)
    ids, phi, logw = next(_model_blocks(model, stats, stats.est_bytes + 1)).value
    shared = points.sparkSession.sparkContext.broadcast(_index_of(ids, phi, logw, E))

    def run(batches):
        best = shared.value
        for b in batches:
            if b.num_rows:
                done = best(b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1))[3]
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([done], pa.int64())], names=["points", "computed"])

    got = points.select(F.col(x).alias("x")).mapInArrow(run, "points long, computed long").agg(F.sum("points").alias("points"), F.sum("computed").alias("computed"))
    return got.select("points", F.lit(stats.n_clusters).alias("centres"), (F.col("points") * stats.n_clusters).alias("products"), "computed")


def _with_model(points: DataFrame, model: DataFrame, E: float, x: str, max_model_bytes: int, stats: ModelStats,
                arrays: bool = False) -> DataFrame:
    """``points`` plus the best cluster's (_bs, _bid, _bd) and _lse over the whole model, and
    with ``arrays`` every cluster's (id, score, squared distance) as ``_all`` in id order.

    Each block of the model is one matrix product per Arrow batch; the best so far and the
    running log-sum-exp travel in the row from block to block, so there is no shuffle, no
    join back and no key."""
    every = StructType([StructField("cluster_id", IntegerType()), StructField("s", DoubleType()), StructField("d2", DoubleType())])
    extra = [StructField(f.split()[0], LongType() if f.endswith("long") else DoubleType()) for f in _BEST.split(", ")]
    extra += [StructField("_all", ArrayType(every))] if arrays else []
    cols = points.columns
    at_x = cols.index(x)
    schema = StructType([*points.schema.fields, *extra])
    out = points
    for b, data in enumerate(_model_blocks(model, stats, max_model_bytes)):
        out = out.mapInArrow(_block_fn(data, E, at_x, len(cols), b == 0, arrays, every, schema.names), schema)
    if arrays:
        out = out.withColumn("_all", F.array_sort("_all"))
    return out


def _block_fn(data, E, at_x, n_cols, first, arrays, every, names):
    """One block of ``_with_model`` (a function of its own: a loop's closure would see the last block)."""

    def run(batches):
        ids, phi, logw = data.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            xs = batch.column(at_x)
            pts = xs.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            lists = []
            got = [np.empty(n) for _ in range(4)]
            step = max(1, (32 << 20) // (8 * max(1, len(ids))))  # 32 MB of scores at once
            for lo in range(0, n, step):
                part = best_of_block(pts[lo: lo + step], phi, logw, ids, E)
                for g, v in zip(got, part):
                    g[lo: lo + step] = v
                if arrays:
                    d2 = exact_sq_distances(pts[lo: lo + step], phi)
                    s = logw[None, :] - d2 / (2.0 * E)
                    k, m = len(d2), len(ids)
                    st = pa.StructArray.from_arrays([pa.array(np.tile(ids, k).astype(np.int32)), pa.array(s.ravel()), pa.array(d2.ravel())],
                                                    fields=[pa.field("cluster_id", pa.int32()), pa.field("s", pa.float64()), pa.field("d2", pa.float64())])
                    lists.append(pa.ListArray.from_arrays(pa.array(np.arange(0, k * m + 1, m, dtype=np.int32)), st))
            bs, bid, bd, lse = got
            bid = bid.astype(np.int64)
            if not first:
                obs, obid, obd, olse = (batch.column(n_cols + i).to_numpy(zero_copy_only=False) for i in range(4))
                old = (obs > bs) | ((obs == bs) & (obid < bid)) | (np.isnan(obs) & ~np.isnan(bs))
                bs, bid, bd = np.where(old, obs, bs), np.where(old, obid, bid), np.where(old, obd, bd)
                lse = np.logaddexp(olse, lse)
            new = [pa.array(bs), pa.array(bid, pa.int64()), pa.array(bd), pa.array(lse)]
            if arrays:
                a = pa.concat_arrays(lists)
                if not first:
                    old = batch.column(n_cols + 4)
                    a = pa.array([u + v for u, v in zip(old.to_pylist(), a.to_pylist())], a.type)
                new.append(a)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], *new], names=names)

    return run


def best_cluster(points: DataFrame, model: DataFrame, E: float, x: str = "x",
                 out: str = "cluster_id", with_score: bool = False, with_prob: bool = False,
                 max_model_bytes: int = MAX_MODEL_BYTES, with_resid: bool = False) -> DataFrame:
    """Argmax of the score per row (TOP-1 / TOP-2); optional score and posterior probability.

    ``model`` needs ``cluster_id, phi, logw``. Small models (K x d <= UNROLL_MAX_VALUES)
    become literal arithmetic, fully code-generated; larger ones are one matrix product per
    Arrow batch against byte-bounded broadcast blocks (see ``_with_model``), with many centres
    only against those that can still win (``functions.centre_tree`` in few dimensions, else
    ``functions.centre_index``; probabilities need all). All give the direct form's labels. ``with_resid`` adds ``resid`` = ||x - phi_c||^2 / E of the chosen
    cluster, so a residual sum of the MAP assignment needs no second pass or join.
    """
    prepare_session(points.sparkSession)
    stats = model_stats(model)
    if stats.n_clusters == 0:
        raise ValueError("empty model")
    cols = points.columns
    if check_broadcast(stats, max_model_bytes) == 1 and stats.n_clusters * max(stats.dim, 1) <= UNROLL_MAX_VALUES:
        rows = collect_model(model.select("cluster_id", "phi", "logw"))
        staged, bid, bs, lse, bd = _unrolled(points, rows, E, x)
        res = staged.select(*cols, bid.alias(out), bs.alias("_bs"), lse.alias("_lse"), bd.alias("_bd"))
    elif stats.n_clusters >= INDEX_CENTRES and not with_prob:
        res = _indexed(points, model, E, x, max_model_bytes, stats).withColumn(out, F.col("_bid").cast("int")).select(*cols, out, "_bs", "_bd")
    else:
        res = _with_model(points, model, E, x, max_model_bytes, stats).withColumn(out, F.col("_bid").cast("int"))
        res = res.select(*cols, out, "_bs", "_lse", "_bd")
    if with_score:
        res = res.withColumnRenamed("_bs", "score")
    if with_prob:
        res = res.withColumn("prob", F.exp((F.col("score") if with_score else F.col("_bs")) - F.col("_lse")))
    if with_resid:
        res = res.withColumn("resid", F.col("_bd") / F.lit(E))
    return res.drop("_bs", "_lse", "_bd")


def membership(points: DataFrame, model: DataFrame, E: float, x: str = "x",
               max_model_bytes: int = MAX_MODEL_BYTES) -> DataFrame:
    """Posterior membership probabilities per row as ``probs ARRAY<DOUBLE>`` in id order,
    aligned with ``cluster_ids`` (WIN-1 / WIN-2): a stable softmax inside the row."""
    prepare_session(points.sparkSession)
    sc = _with_model(points, model, E, x, max_model_bytes, model_stats(model), arrays=True)
    return sc.select(*points.columns, F.transform("_all", lambda t: t["cluster_id"]).alias("cluster_ids"),
                     F.transform("_all", lambda t: F.exp(t["s"] - F.col("_lse"))).alias("probs"))


def squared_distances(points: DataFrame, model: DataFrame, x: str = "x", max_model_bytes: int = MAX_MODEL_BYTES) -> DataFrame:
    """Squared distance of each row to every centre, ``sqdists`` in id order (JN-1, SC-1)."""
    prepare_session(points.sparkSession)
    j = _with_model(points, model.select("cluster_id", "phi"), 1.0, x, max_model_bytes, model_stats(model), arrays=True)
    return j.select(*points.columns, F.transform("_all", lambda t: t["cluster_id"]).alias("cluster_ids"),
                    F.transform("_all", lambda t: t["d2"]).alias("sqdists"))


def log_densities(points: DataFrame, model: DataFrame, E: float, x: str = "x", max_model_bytes: int = MAX_MODEL_BYTES) -> DataFrame:
    """ln N(x; phi_k, E I) of each row for every centre, ``log_densities`` in id order (SC-2)."""
    j = squared_distances(points, model, x, max_model_bytes)
    constant = F.size(x).cast("double") / 2.0 * F.lit(math.log(2.0 * math.pi * E))
    return j.withColumn("log_densities", F.transform("sqdists", lambda t: -t / F.lit(2.0 * E) - constant)).drop("sqdists")


def nearest_center(points: DataFrame, centers: DataFrame, x: str = "x", out: str = "cluster_id") -> DataFrame:
    """K-means style predict on given centres: argmin distance, lowest id on ties (CLU-2)."""
    return best_cluster(points, prior_log_weight(centers, "none"), 1.0, x=x, out=out)


def map_assign(points: DataFrame, model: DataFrame, E: float, alpha: float = 1.0,
               initial: bool = False, with_score: bool = False, with_resid: bool = False) -> DataFrame:
    """Batch MAP assignment of points to a weighted model (SC-3, TOP-1, CLU-3a).

    ``initial=True`` uses the round-0 weights where every size is still 0.
    """
    m = prior_log_weight(model, "initial" if initial else "local", alpha)
    return best_cluster(points, m, E, with_score=with_score, with_resid=with_resid)
