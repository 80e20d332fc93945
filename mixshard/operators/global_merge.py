"""Global merge (CLU-6): Gibbs sweeps over cluster summaries, never over points.

Input: ``individuals(ind_id, size, y_mean, phi, prior_mean, prior_var)`` from the
same-id merge. Each starts as its own supercluster (centre drawn from its
posterior). Each sweep moves every individual to the best supercluster or to a
fresh one (weight gamma, centre = its own phi), then refreshes every
supercluster's mean, centre (a posterior draw) and gamma.

Two forms, chosen by the caller and never by the number of rows:

- ``batch`` (default): a sweep is one distributed step, one Spark job where the summaries'
  sums fit the driver (``resident_merge``), two written tables beyond. All individuals are scored
  against the superclusters of the sweep's start by a matrix product per batch, and
  one aggregate refreshes the superclusters. Given the centres the moves are
  independent, so the result does not depend on partitioning. Sweeps take turns: in
  one individuals may only join larger superclusters (smaller ids on equal sizes), in
  the next only smaller ones, else neighbours would swap places for ever; one that is
  alone only joins a larger one. All ``global_sweeps`` run:
  centres are drawn anew in each, so one after quiet sweeps can still move (``quiet_sweeps`` ends early).
- ``sequential``: one individual after the other, centres as they stand, in one task
  (the reference's form). It raises above ``MAX_SEQUENTIAL`` individuals.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mixshard.functions.draws import concentration_of, keyed_normal_vector, rng_for
from mixshard.functions.frames import conform
from mixshard.functions.matrix import centred, sq_distances
from mixshard.functions.vectors import posterior_mean, posterior_var, safe_log, vector_weighted_mean, zero_vector
from mixshard.operators.model import MAX_MODEL_BYTES, ModelStats, model_stats
from mixshard.operators.resident_merge import RESIDENT_BYTES, merge_resident, resident_bytes
from mixshard.operators.score import _model_blocks
from mixshard.params import DPMParams
from mixshard.session import cut, prepare_session

# Individuals the sequential form takes; its cost is quadratic in them, in one task.
MAX_SEQUENTIAL = 5000

MERGE_SCHEMA = (
    "kind STRING, ind_id INT, sc_id INT, size DOUBLE, y_mean ARRAY<DOUBLE>, "
    "phi ARRAY<DOUBLE>, prior_mean ARRAY<DOUBLE>, prior_var DOUBLE, post_mean ARRAY<DOUBLE>, "
    "post_var DOUBLE, gamma DOUBLE"
)


def _posterior(size: float, ybar: np.ndarray, m0: np.ndarray, v0: float, E: float):
    v = 1.0 / (size / E + 1.0 / v0)
    return v * (size / E * ybar + m0 / v0), v


def merge_sequential(pdf: pd.DataFrame, p: DPMParams, gamma: float, n_total: int, round_: int) -> pd.DataFrame:
    """Sequential merge (numpy over at most MAX_SEQUENTIAL summaries)."""
    pdf = pdf.sort_values("ind_id", kind="stable")
    ids = pdf["ind_id"].to_numpy(np.int64)
    s = pdf["size"].to_numpy(float)
    Y = np.stack(pdf["y_mean"].to_numpy()).astype(float)
    P0 = np.stack(pdf["phi"].to_numpy()).astype(float)
    PM = np.stack(pdf["prior_mean"].to_numpy()).astype(float)
    PV = pdf["prior_var"].to_numpy(float)
    M, d = Y.shape
    E, S = p.E, p.S
    rng = rng_for(p.seed, 31, round_, 0, 0)
    zero = np.zeros(d)

    # supercluster table (row = id); members tracked through c
    size = s.copy()
    count = np.ones(M, dtype=np.int64)
    ybar = Y.copy()
    pm = PM.copy()
    pv = PV.copy()
    phi = np.empty((M, d))
    for k in range(M):
        mu, v = _posterior(size[k], ybar[k], pm[k], pv[k], E)
        phi[k] = mu + math.sqrt(v) * rng.standard_normal(d)
    c = np.arange(M)
    K = M
    for t in range(p.global_sweeps):
        for i in range(M):
            ko = int(c[i])
            if count[ko] == 1:  # its own supercluster: remove it, ids above shift down
                keep = np.arange(K) != ko
                size, count, ybar, pm, pv, phi = (a[:K][keep] for a in (size, count, ybar, pm, pv, phi))
                c[c > ko] -= 1
                c[i] = -1
                K -= 1
            else:
                size[ko] -= s[i]
                count[ko] -= 1
            diff = phi[:K] - Y[i]
            with np.errstate(divide="ignore"):
                sc = np.log(size[:K]) - (diff * diff).sum(1) / (2.0 * E)
            dc = P0[i] - Y[i]
            cand = math.log(gamma) - float(dc @ dc) / (2.0 * E) if gamma > 0 else -math.inf
            if p.assign == "sample":
                allsc = np.append(sc, cand)
                pr = np.exp(allsc - allsc.max())
                best = int(rng.choice(K + 1, p=pr / pr.sum()))
                new = best == K
            else:
                best = int(np.argmax(sc)) if K else -1
                new = K == 0 or cand > sc[best]
            if new:
                size = np.append(size[:K], s[i])
                count = np.append(count[:K], 1)
                ybar = np.vstack([ybar[:K], Y[i]])
                pm = np.vstack([pm[:K], zero])
                pv = np.append(pv[:K], S)
                phi = np.vstack([phi[:K], P0[i]])
                c[i] = K
                K += 1
            else:
                size[best] += s[i]
                count[best] += 1
                c[i] = best
        # refresh means and centres from the members (current sizes)
        w = np.zeros((K, d))
        np.add.at(w, c, Y * s[:, None])
        tot = np.bincount(c, weights=s, minlength=K)
        size = tot
        ybar = w / tot[:, None]
        for k in range(K):
            mu, v = _posterior(size[k], ybar[k], pm[k], pv[k], E)
            phi[k] = mu + math.sqrt(v) * rng.standard_normal(d)
        gamma = concentration_of(gamma, K, n_total, p.conc_a, p.conc_b, p.concentration, p.seed, 32, round_, t)
    rows = []
    for k in range(K):
        mu, v = _posterior(size[k], ybar[k], pm[k], pv[k], E)
        rows.append({"kind": "k", "sc_id": k, "size": float(size[k]), "y_mean": ybar[k],
                     "phi": phi[k], "prior_mean": pm[k], "prior_var": float(pv[k]), "post_mean": mu,
                     "post_var": float(v)})
    rows.append({"kind": "g", "gamma": float(gamma)})
    out = pd.DataFrame(rows)
    mem = pd.DataFrame({"kind": "m", "ind_id": ids.astype(np.int32), "sc_id": c.astype(np.int32)})
    return conform(pd.concat([out, mem], ignore_index=True), MERGE_SCHEMA)


def _sequential(individuals: DataFrame, p: DPMParams, gamma: float, n_total: int, round_: int
                ) -> tuple[DataFrame, DataFrame, float]:
    m = individuals.count()
    if m > MAX_SEQUENTIAL:
        raise ValueError(f"{m} individuals are above the bound {MAX_SEQUENTIAL} of the sequential merge; use method='batch'")
    one = individuals.withColumn("_one", F.lit(0)).groupBy("_one")
    res = cut(one.applyInPandas(lambda pdf: merge_sequential(pdf.drop(columns="_one"), p, gamma, n_total, round_), MERGE_SCHEMA), "merge")  # a few rows
    model = res.where("kind = 'k'").select(F.col("sc_id").alias("cluster_id"), "size", "y_mean", "phi",
                                           F.col("post_mean").alias("prior_mean"), F.col("post_var").alias("prior_var"))
    mem = res.where("kind = 'm'").select("ind_id", F.col("sc_id").alias("cluster_id"))
    return model, mem, float(res.where("kind = 'g'").first()["gamma"])


def _move_fn(data, E: float, sample: tuple | None, first: bool, up: bool):
    """One block of superclusters in a batch sweep: the best so far travels in the row."""
    names = ["ind_id", "size", "y_mean", "phi", "c", "members", "own_size", "own_logw", "best_s", "best"]

    def run(batches):
        ids, centres, logw = data.value
        c0, p, pn = centred(centres)
        for b in batches:
            if not b.num_rows:
                continue
            col = lambda k: b.column(names.index(k))
            y = col("y_mean").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            c, members = col("c").to_numpy(), col("members").to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                own = np.log(col("own_size").to_numpy() - col("size").to_numpy())
            alone = col("own_logw").to_numpy()
            best_s, best = np.full(b.num_rows, -np.inf), c.copy()
            if not first:
                best_s, best = col("best_s").to_numpy().copy(), col("best").to_numpy().copy()
            step = max(1, (32 << 20) // (8 * max(1, len(ids))))  # 32 MB of scores at once
            for lo in range(0, b.num_rows, step):
                q = slice(lo, lo + step)
                d2, _ = sq_distances(y[q], c0, p, pn)
                w = np.broadcast_to(logw, d2.shape).copy()
                mine = c[q, None] == ids[None, :]
                single = members[q] == 1
                a = alone[q][:, None]
                larger = (logw[None, :] > a) | ((logw[None, :] == a) & (ids[None, :] < c[q, None]))
                w[~larger if up else larger | single[:, None]] = -np.inf
                w[mine] = np.broadcast_to(np.where(single, -np.inf, own[q])[:, None], w.shape)[mine]
                s = w - d2 / (2.0 * E)
                if sample:
                    for r, i in enumerate(col("ind_id").to_numpy()[q]):  # the largest score plus Gumbel noise is a draw
                        s[r] += rng_for(*sample, int(i)).gumbel(size=s.shape[1])
                k = s.argmax(axis=1)
                top = s[np.arange(len(k)), k]
                better = (top > best_s[q]) | ((top == best_s[q]) & (ids[k] < best[q]))
                best_s[q] = np.where(better, top, best_s[q])
                best[q] = np.where(better, ids[k], best[q])
            yield pa.RecordBatch.from_arrays([*b.columns[:8], pa.array(best_s), pa.array(best, pa.int64())], names=names)

    return run


_ROW = "ind_id long, size double, y_mean array<double>, phi array<double>, c long, members long, own_size double, own_logw double, best_s double, best long"


def batch_moves(cur: DataFrame, supers: DataFrame, p: DPMParams, gamma: float, fresh, up: bool = True, sample: tuple | None = None,
                max_model_bytes: int = MAX_MODEL_BYTES, stats: ModelStats | None = None) -> DataFrame:
    """One batch sweep's moves: ``cur(ind_id, size, y_mean, phi, c)`` with the new ``c``.

    ``supers(sc_id, size, members, phi)`` are the superclusters at the start; ``fresh`` is
    the id of the supercluster an individual opens (a column); ``up`` the sweep's direction. An individual stays fresh when
    its own candidate scores above every supercluster it may join; one that is alone and
    would open a fresh one keeps its supercluster's id."""
    own = supers.select(F.col("sc_id").alias("c"), "members", F.col("size").alias("own_size"))
    rows = cur.join(own, "c").select("ind_id", "size", "y_mean", "phi", "c", "members", "own_size", safe_log(F.col("own_size")).alias("own_logw"),
                                     F.lit(0.0).alias("best_s"), F.col("c").alias("best"))
    model = supers.select(F.col("sc_id").alias("cluster_id"), "phi", safe_log(F.col("size")).alias("logw"))
    for b, data in enumerate(_model_blocks(model, stats or model_stats(model), max_model_bytes)):
        rows = rows.mapInArrow(_move_fn(data, p.E, (*sample, b) if sample else None, b == 0, up), _ROW)
    gap = F.aggregate(F.zip_with("phi", "y_mean", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda a, t: a + t)
    own_new = F.lit(math.log(gamma) if gamma > 0 else -math.inf) - gap / F.lit(2.0 * p.E)
    if sample:
        from mixshard.functions.draws import keyed_uniforms

        u, _ = keyed_uniforms(*[F.lit(int(x)) for x in sample], F.lit(-1), F.col("ind_id"))
        own_new = own_new - F.ln(-F.ln(u))
    new = (own_new > F.col("best_s")) | (F.col("best_s") == F.lit(float("-inf")))
    return rows.select("ind_id", "size", "y_mean", "phi", F.col("c").alias("was"),
                       F.when(new, F.when(F.col("members") == 1, F.col("c")).otherwise(fresh)).otherwise(F.col("best")).alias("c"))


def _refresh(cur: DataFrame, priors: DataFrame, dim: int, p: DPMParams, draw: tuple | None) -> DataFrame:
    """Superclusters of an assignment: sizes, means, priors, posteriors and centres (posterior
    draws keyed by ``draw``, or posterior means)."""
    s = vector_weighted_mean(cur.withColumnRenamed("c", "sc_id"), ["sc_id"], "y_mean", "size", dim, extra=[F.count(F.lit(1)).alias("members")])
    s = s.join(priors, "sc_id", "left").withColumn("prior_mean", F.coalesce("prior_mean", zero_vector(dim)))
    s = s.withColumn("prior_var", F.coalesce("prior_var", F.lit(float(p.S))))
    s = s.withColumn("post_var", posterior_var(F.col("size"), p.E, F.col("prior_var")))
    s = s.withColumn("post_mean", posterior_mean("y_mean", "prior_mean", "size", p.E, "prior_var", "post_var"))
    phi = F.col("post_mean") if draw is None else keyed_normal_vector(F.col("post_mean"), F.col("post_var"), draw[0], draw[1], *[F.lit(int(x)) for x in draw[2:]], F.col("sc_id"))
    return s.withColumn("phi", phi)


def _batch(individuals: DataFrame, p: DPMParams, gamma: float, n_total: int, round_: int, resident_max: int) -> tuple[DataFrame, DataFrame, float]:
    base = cut(individuals.select(F.col("ind_id").cast("long").alias("ind_id"), "size", "y_mean", "phi", "prior_mean", "prior_var"), "merge-base")
    r = base.agg(F.max("ind_id").alias("m"), F.first(F.size("y_mean")).alias("d"), F.count(F.lit(1)).alias("k")).first()
    if r["m"] is None:
        raise ValueError("no individuals to merge")
    span, dim, k = int(r["m"]) + 1, int(r["d"]), int(r["k"])
    if resident_bytes(k, dim) <= resident_max:
        return merge_resident(base, k, dim, span, p, gamma, n_total, round_)
    priors = base.select(F.col("ind_id").alias("sc_id"), "prior_mean", "prior_var")
    cur = base.select("ind_id", "size", "y_mean", "phi", F.col("ind_id").alias("c"))
    supers = cut(_refresh(cur, priors, dim, p, (p.seed, 31, round_, -1)), "merge-supers")
    moved, quiet = None, 0
    for t in range(p.global_sweeps):
        sample = (p.seed, 33, round_, t) if p.assign == "sample" else None
        moved = cut(batch_moves(cur, supers, p, gamma, F.col("ind_id") + F.lit(span * (t + 1)), t % 2 == 0, sample, stats=ModelStats(k, dim)), "merge-moves", after=moved)
        supers = cut(_refresh(moved, priors, dim, p, (p.seed, 31, round_, t)), "merge-supers", after=supers)
        k = supers.count()
        gamma = concentration_of(gamma, k, n_total, p.conc_a, p.conc_b, p.concentration, p.seed, 32, round_, t)
        if p.quiet_sweeps and not sample:
            quiet = quiet + 1 if moved.where("c <> was").isEmpty() else 0
        cur = moved.drop("was")
        if p.quiet_sweeps and quiet >= p.quiet_sweeps:
            break
    # dense ids in id order: one row per supercluster, a table of the model's size
    dense = supers.withColumn("cluster_id", (F.row_number().over(Window.orderBy("sc_id")) - 1).cast("int"))
    model = dense.select("cluster_id", "size", "y_mean", "phi", F.col("post_mean").alias("prior_mean"), F.col("post_var").alias("prior_var"))
    mem = cur.select("ind_id", F.col("c").alias("sc_id")).join(dense.select("sc_id", "cluster_id"), "sc_id")
    return cut(model, "merge-model"), mem.select(F.col("ind_id").cast("int").alias("ind_id"), "cluster_id"), gamma


def global_merge(individuals: DataFrame, p: DPMParams, gamma: float, n_total: int, round_: int,
                 method: str = "batch", resident_max: int = RESIDENT_BYTES) -> tuple[DataFrame, DataFrame, float]:
    """Merge individuals into superclusters. Returns (model, ind_to_cluster, gamma).

    ``model``: (cluster_id, size, y_mean, phi, prior_mean, prior_var) where the prior
    for the next round is the posterior computed here (the reference's choice);
    ``ind_to_cluster``: (ind_id, cluster_id). ``method``: ``batch`` or ``sequential``. A
    batch merge whose individuals' sums fit ``resident_max`` bytes is one job a sweep; beyond
    it every sweep writes its moves and superclusters as tables (same model, tested).
    """
    if method not in ("batch", "sequential"):
        raise ValueError("method must be 'batch' or 'sequential'")
    prepare_session(individuals.sparkSession)
    cur = individuals.select("ind_id", "size", "y_mean", "phi", "prior_mean", "prior_var")
    if method == "batch":
        return _batch(cur, p, gamma, n_total, round_, resident_max)
    return _sequential(cur, p, gamma, n_total, round_)
