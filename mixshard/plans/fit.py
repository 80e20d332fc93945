"""The whole fit (CLU-8): K-means start, then rounds of local sweeps and a global merge.

Per round:

1. the current model (K centres, weights) goes to the shards as a broadcast;
2. one grouped job runs the sweeps of every shard (``points`` are cached and
   hash-partitioned by shard, so only the small label table is shuffled) and
   emits point labels, non-empty cluster summaries, shard state and the quality
   partials (contingency cells, residual sum) of the model it received;
3. the output is written to the checkpoint folder and read back: lineage is
   cut every round and a lost executor never loses round state;
4. same-id merge, global merge and relabelling run on summaries only;
5. new weights are a keyed Dirichlet draw over the K' merged sizes.

Only scalars and, within a byte bound, the K-row model reach the driver. Each round's tables
are partitions replaced as a whole, and a manifest commits the round, so an ended run resumes.
"""

from __future__ import annotations

import json
import logging
import time
from contextlib import contextmanager
from dataclasses import asdict, dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixshard.functions.draws import dirichlet_weights
from mixshard.functions.vectors import zero_vector
from mixshard.operators.evaluate import ari_from_contingency
from mixshard.operators.global_merge import global_merge
from mixshard.operators.kmeans import kmeans_init
from mixshard.operators.large_sweep import ALPHA_FACTOR, run_large_sweep
from mixshard.operators.merge import merge_same_id, relabel
from mixshard.operators.model import MAX_DRIVER_BYTES, ModelStats, model_arrays
from mixshard.operators.sweep import SWEEP_SCHEMA, point_labels, run_sweep
from mixshard.params import DPMParams
from mixshard.session import cut, delete_path, prepare_session, scratch_path
from mixshard.sources.points import MAX_SHARD_BYTES, MAX_SHARD_POINTS, _checked, assign_bounded_shards, shard_count_for
from mixshard.sources.sinks import committed_rounds, read_rounds, write_round
from mixshard.sources.storage import Bucketed, bucket_count, open_bucketed, write_bucketed

log = logging.getLogger("mixshard.fit")


@contextmanager
def _step(name: str, r: int):
    t = time.time()
    yield
    log.info("round %d %-14s %.2fs", r, name, time.time() - t)


REPORT_SCHEMA = "round INT, n_clusters INT, gamma DOUBLE, ari DOUBLE, rss DOUBLE, seconds DOUBLE"


@dataclass
class FitResult:
    assignments: DataFrame  # (point_id, shard, cluster_id) for the last merge
    model: DataFrame  # (cluster_id, size, y_mean, phi, prior_mean, prior_var, beta)
    report: DataFrame  # REPORT_SCHEMA, one row per round
    sub_to_global: DataFrame  # (shard, local_id, cluster_id) of the last round
    shard_state: DataFrame  # (shard, alpha, beta_u, n) after the last round
    gamma: float
    run_dir: str
    round_models: DataFrame  # every round's merged model with its ``round`` and ``gamma``
    round_states: DataFrame  # every round's (round, shard, alpha, beta_u, n)


POINTS_SCHEMA = "point_id BIGINT, x ARRAY<DOUBLE>, label INT, shard INT"


def prepare_points(points: DataFrame, shards: int | None = None, max_shard_points: int = MAX_SHARD_POINTS, path: str | None = None
                   ) -> tuple[Bucketed, int, int]:
    """Shard, hash-partition by shard and cache the points; returns (written table, n, shards).

    The caller drops the table (and unpersists its frame) when it is done."""
    n = points.count()
    first = points.select(F.size("x").alias("d")).first()
    dim = int(first["d"]) if first is not None else 1
    s = shard_count_for(n, shards, max_shard_points, dim=dim)
    rows = points.select(F.col("point_id").cast("long").alias("point_id"), "x", F.col("label").cast("int").alias("label"))
    sharded, s = assign_bounded_shards(rows, s, min(max_shard_points, MAX_SHARD_BYTES // (8 * max(dim, 1))))
    # written once, bucketed by shard (each bucket = one shard): every later read is
    # already partitioned by shard, and a lost cache block is rebuilt from its bucket
    pts = write_bucketed(sharded.repartition(bucket_count(points.sparkSession, s), "shard"), s, "points", sort_by="point_id", path=path)
    pts.df.persist(StorageLevel.MEMORY_AND_DISK).count()
    return pts, n, s


@dataclass
class _Model:
    """The current model: its table, K, d, ``beta_u``, and its arrays where the driver may hold them."""

    table: DataFrame
    stats: ModelStats
    beta_u: float
    arrays: tuple[np.ndarray, np.ndarray] | None


def _model(table: DataFrame, max_driver_bytes: int) -> _Model:
    r = table.agg(F.count(F.lit(1)).alias("k"), F.min("cluster_id").alias("lo"), F.max("cluster_id").alias("hi"),
                  F.countDistinct("cluster_id").alias("ids"), F.max(F.size("phi")).alias("d"), F.first("beta_u").alias("bu")).first()
    if not r["k"] or (r["lo"], r["hi"], r["ids"]) != (0, r["k"] - 1, r["k"]):
        raise ValueError("model ids must be dense from 0")
    stats = ModelStats(int(r["k"]), int(r["d"]))
    arrays = model_arrays(table, "beta")[1:] if stats.est_bytes <= max_driver_bytes else None
    return _Model(table, stats, float(r["bu"]), arrays)


def _with_weights(model: DataFrame, gamma: float, seed: int, round_: int) -> DataFrame:
    """Model plus keyed Dirichlet weights ``beta`` and ``beta_u``."""
    betas, bu = dirichlet_weights(model.select("cluster_id", "size"), gamma, seed, round_)
    w = betas.select("cluster_id", "beta").withColumn("_k", F.lit(0)).join(
        F.broadcast(bu.withColumn("_k", F.lit(0))), "_k").drop("_k")
    return model.drop("beta", "beta_u").join(w, "cluster_id")


def _report(spark, run_dir: str, row: dict) -> None:
    """SNK-1: one round's report row, written as soon as its scores are known."""
    cols = [c.split()[0] for c in REPORT_SCHEMA.split(", ")]
    write_round(spark.createDataFrame([tuple(row[c] for c in cols)], REPORT_SCHEMA), run_dir, "report", row["round"])


def _sweep_once(pts: DataFrame, labels: DataFrame | None, state: DataFrame | None, m: _Model, p: DPMParams, r: int, gamma: float, n_shards: int, path: str) -> Bucketed:
    """The sweep of round ``r``, written as a table bucketed by shard."""
    spark = pts.sparkSession
    if m.arrays is not None:
        data = spark.sparkContext.broadcast(m.arrays)
        out = write_bucketed(run_sweep(pts, labels, data, p, r, gamma, m.beta_u), n_shards, f"sweep_r{r}", path=path)
        data.unpersist()
        return out
    most = pts.groupBy("shard").count().agg(F.max("count")).first()[0]
    lo = hi = p.alpha0
    if state is not None:
        lo, hi = state.agg(F.min("alpha"), F.max("alpha")).first()
    while True:
        lo, hi = lo / ALPHA_FACTOR, hi * ALPHA_FACTOR
        out = write_bucketed(run_large_sweep(pts, labels, m.table, p, r, gamma, m.beta_u, (lo, hi), most), n_shards, f"sweep_r{r}", path=path)
        seen = out.df.where("kind = 'x'").agg(F.min("alpha"), F.max("beta_u")).first()
        if seen[0] is None:
            return out
        lo, hi = min(lo, seen[0]), max(hi, seen[1])
        out.drop()


def _quality(out: DataFrame) -> tuple[float | None, float]:
    ct = (out.where("kind = 'q'").groupBy(F.col("local_id").alias("cluster_id"), "label")
          .agg(F.sum("cnt").alias("n")))
    r = ari_from_contingency(ct).first()
    rss = out.where("kind = 's0'").agg(F.sum("rss").alias("r")).first()["r"]
    ari = r["ari"] if r is not None and r["n"] else None
    return ari, float(rss or 0.0)


def _labels(sweep: DataFrame, sub_to_global: DataFrame, state: DataFrame) -> DataFrame:
    """(point_id, shard, cluster_id, alpha): what the next round starts from."""
    return relabel(point_labels(sweep), sub_to_global).join(_checked(state.select("shard", "alpha")), "shard")


def _facts(p: DPMParams, k_init: int, merge: str) -> str:
    return json.dumps({**asdict(p), "k_init": k_init, "merge": merge}, sort_keys=True)


def fit(points: DataFrame, params: DPMParams, k_init: int, rounds: int, shards: int | None = None,
        max_shard_points: int = MAX_SHARD_POINTS, merge: str = "batch", max_driver_bytes: int = MAX_DRIVER_BYTES,
        run_dir: str | None = None, resume: str | None = None) -> FitResult:
    """Fit a DP mixture to ``points(point_id, x, label)``; ``label`` may be NULL.

    ``k_init``: K-means centres to start from; ``rounds``: local-sweep + merge
    rounds; ``shards``: minimum shard count (raised so that no shard exceeds
    ``max_shard_points``); ``merge``: form of the global merge (``batch`` or
    ``sequential``). Point ids must be unique. The tables of points and sweeps are
    dropped as soon as they are no longer read.

    A model above ``max_driver_bytes`` never reaches the driver as a whole: its sweeps run
    block by block (``operators.large_sweep``), with the same labels.

    Every round ends with a manifest in ``run_dir`` (a fresh folder of the checkpoint folder
    unless given), written after all that it names. ``resume``: the folder of a run that was
    ended; it goes on after its last committed round and gives the rows that an unbroken run
    would have given. ``points`` is then read only if no round was committed; parameters must
    be the same, ``rounds`` may be larger.
    """
    if rounds < 1 or k_init < 1:
        raise ValueError("need rounds >= 1 and k_init >= 1")
    p = params.validate()
    spark = points.sparkSession
    prepare_session(spark)
    run_dir = resume or run_dir or scratch_path(spark, "fit")
    facts = _facts(p, k_init, merge)
    done = committed_rounds(spark, run_dir, "manifest") if resume else []
    labels = state = sub_to_global = sweep = None
    reports: list[dict] = []
    if done:
        last = read_rounds(spark, run_dir, "manifest").where(F.col("round") == done[-1]).first()
        if last["facts"] != facts:
            raise ValueError(f"the run in {run_dir} has other parameters: {last['facts']}")
        if rounds <= done[-1]:
            raise ValueError(f"the run in {run_dir} has {done[-1] + 1} rounds already")
        n, n_shards, gamma = last["n"], last["shards"], last["gamma"]
        if committed_rounds(spark, run_dir, "assignments") == [rounds - 1]:  # it had ended
            return _result(spark, run_dir, rounds - 1, gamma)
        table = open_bucketed(spark, f"{run_dir}/points", POINTS_SCHEMA, n_shards, "points")
        pts = table.df.persist(StorageLevel.MEMORY_AND_DISK)
        model = _model(_round(spark, run_dir, "model", done[-1]), max_driver_bytes)
        state, sub_to_global = (_round(spark, run_dir, t, done[-1]) for t in ("state", "sub_to_global"))
        sweep = open_bucketed(spark, last["sweep"], SWEEP_SCHEMA, n_shards, "sweep")
        labels = _labels(sweep.df, sub_to_global, state)
        reports.append(dict(round=done[-1], n_clusters=model.stats.n_clusters, gamma=gamma, ari=None, rss=None, seconds=last["seconds"]))
    else:
        with _step("prepare", 0):
            table, n, n_shards = prepare_points(points, shards, max_shard_points, path=f"{run_dir}/points")
            pts = table.df
        with _step("kmeans", 0):
            centres, sizes = kmeans_init(pts, k_init, p.kmeans_iters, p.seed)
            gamma = p.gamma0
            start = (centres.join(sizes.select("cluster_id", "size"), "cluster_id")
                     .withColumn("prior_mean", zero_vector(F.size("phi"))).withColumn("prior_var", F.lit(float(p.S))))
            model = _model(write_round(_with_weights(start, gamma, p.seed, 0), run_dir, "start", 0), max_driver_bytes)
    for r in range(done[-1] + 1 if done else 0, rounds):
        t0 = time.time()
        with _step("sweep", r):
            # one bucket per shard: next round's labels come back partitioned by shard
            before, sweep = sweep, _sweep_once(pts, labels, state, model, p, r, gamma, n_shards, scratch_path(spark, f"sweep_r{r}"))
            out = sweep.df
        if r > 0:
            with _step("quality", r):
                ari, rss = _quality(out)
                reports[-1].update(ari=ari, rss=rss)
                _report(spark, run_dir, reports[-1])
        k, dim = model.stats.n_clusters, model.stats.dim
        summaries = out.where("kind = 'c'").select("shard", "local_id", "size", "y_mean", "phi")
        state = write_round(out.where("kind = 's'").select("shard", "alpha", "beta_u", "n"), run_dir, "state", r)
        with _step("same_id_merge", r):
            individuals, ind_subs = merge_same_id(summaries, k, dim, model.table, p.S)
            individuals = cut(individuals, "individuals")
        with _step("global_merge", r):
            new_model, ind_to_c, gamma = global_merge(individuals, p, gamma, n, r, merge)
        with _step("relabel", r):
            sub_to_global = write_round(ind_subs.join(ind_to_c, "ind_id").select("shard", "local_id", "cluster_id"), run_dir, "sub_to_global", r)
            delete_path(spark, individuals._cut_path)
            labels = _labels(out, sub_to_global, state)
        with _step("weights", r):
            # the merged model of round r, with the weights the next round uses
            weighted = _with_weights(new_model.withColumn("gamma", F.lit(float(gamma))), gamma, p.seed, r + 1)
            model = _model(write_round(weighted, run_dir, "model", r), max_driver_bytes)
        reports.append(dict(round=r, n_clusters=model.stats.n_clusters, gamma=float(gamma), ari=None, rss=None, seconds=time.time() - t0))
        # the round counts from here on; what the one before needed can go
        write_round(spark.createDataFrame([(float(gamma), n, n_shards, sweep.path, facts, reports[-1]["seconds"])],
                                          "gamma double, n long, shards int, sweep string, facts string, seconds double").coalesce(1), run_dir, "manifest", r)
        if before is not None:
            before.drop()
    # score the last merge too (the reference never does)
    with _step("final_score", rounds):
        if model.arrays is not None:
            fin = run_sweep(pts, labels, spark.sparkContext.broadcast(model.arrays), p, rounds, gamma, model.beta_u, mode="score")
        else:
            fin = run_large_sweep(pts, labels, model.table, p, rounds, gamma, model.beta_u, (p.alpha0, p.alpha0), 1, mode="score")
        fin = cut(fin, "final-score")  # a few rows a shard, read twice
        ari, rss = _quality(fin)
        delete_path(spark, fin._cut_path)
        reports[-1].update(ari=ari, rss=rss)
        _report(spark, run_dir, reports[-1])
    with _step("write_labels", rounds):
        write_round(labels.select("point_id", "shard", "cluster_id"), run_dir, "assignments", rounds - 1)
    pts.unpersist()
    sweep.drop()
    table.drop()
    return _result(spark, run_dir, rounds - 1, gamma)


def _round(spark, run_dir: str, name: str, r: int) -> DataFrame:
    return read_rounds(spark, run_dir, name).where(F.col("round") == r).drop("round")


def _result(spark, run_dir: str, r: int, gamma: float) -> FitResult:
    every = lambda name: read_rounds(spark, run_dir, name)
    return FitResult(_round(spark, run_dir, "assignments", r), _round(spark, run_dir, "model", r).drop("gamma"), every("report"), _round(spark, run_dir, "sub_to_global", r),
                     _round(spark, run_dir, "state", r), gamma, run_dir, every("model"), every("state"))
