"""Registered queries: each Spark builder next to its DuckDB oracle SQL.

Every query reads the given tables at ``sf_dir`` in full. The deterministic
ones (``oracle_sql`` has an entry) use one fixed "current model": the label
centroids of ``embeddings`` (the build plan's minimum slice); the random and
iterative ones have no SQL twin and are checked by properties in the tests.

Outputs are scalar columns: vectors are reported as (sum, sum of squares)
fingerprints, doubles rounded to 6 places, so two engines can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixshard.functions.vectors import fingerprint
from mixshard.operators import evaluate as ev
from mixshard.operators import merge as mg
from mixshard.operators import score as sc
from mixshard.operators import summarize as sm
from mixshard.session import cut
from mixshard.sources.points import dense_ids, parse_points, points_from_table

# Fixed query parameters (the oracle SQL repeats them as literals).
E = 0.015  # variance inside a cluster for the embeddings (unit-norm, d = 64)
E_SOFT = 0.5  # a wider kernel for the probability queries, so they are not all 1.0
S = 1.0  # variance between centres
GAMMA = 1.0
ALPHA = 1.0
SHARDS = 4
DIM = 64
K_KNOWN = 6  # ids below this count as "known" in the merge queries
FAR = 10.0  # coordinate of the extra centre nobody is nearest to
R = 6  # rounding places of reported doubles


def _r(c, places: int = R):
    return F.round(c, places)


# ---------------------------------------------------------------- Spark inputs
def emb_points(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    p = points_from_table(e, id_col="vec_id", vector_col="embedding", label_col="label")
    return p.withColumn("shard", F.pmod(F.col("point_id"), F.lit(SHARDS)).cast("int"))


def label_model(pts: DataFrame) -> DataFrame:
    """Label centroids as a model: phi = y_mean, beta = size/(n+gamma), prior = (centroid, 0.5)."""
    from mixshard.functions.vectors import vector_mean

    cm = vector_mean(pts, ["label"], "x", DIM).withColumnRenamed("label", "cluster_id")
    cm = cm.withColumn("size", F.col("size").cast("double")).withColumn("phi", F.col("y_mean"))
    w = sm.expected_weights(cm, GAMMA)
    # K rows, written once: every use below reads them back instead of the points
    return cut(w.withColumn("prior_mean", F.col("y_mean")).withColumn("prior_var", F.lit(0.5)), "label-model")


def nearest_assigned(pts: DataFrame, model: DataFrame) -> DataFrame:
    return sc.nearest_center(pts, model.select("cluster_id", "phi"))


def summaries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pts = emb_points(spark, d)
    model = label_model(pts)
    a = nearest_assigned(pts, model)
    s = sm.shard_summaries(a, DIM)
    s = s.join(F.broadcast(model.select(F.col("cluster_id").alias("local_id"), "phi")), "local_id")
    return s, model, a


def merged(spark: SparkSession, d: str):
    s, model, a = summaries(spark, d)
    s = cut(s, "summaries")  # shards x K rows, read several times below
    ind, subs = mg.merge_same_id(s, K_KNOWN, DIM, model, S)
    return ind, subs, s, model, a


# ------------------------------------------------------------------ builders
def q_parse_points_text(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    lines = li.select(F.concat(F.lit("  "), F.concat_ws("   ", "l_quantity", "l_discount", "l_linenumber"),
                               F.lit(" ")).alias("value"))
    p = parse_points(lines, 2, True)
    return p.select(F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2"), "label")


def q_parse_counts(spark, d):
    """Faulty lines of a text form of the line items, counted while the points are summed."""
    from pyspark.sql import Observation

    li = spark.read.parquet(f"{d}/lineitem.parquet")
    key, text = F.col("l_orderkey"), lambda c: F.col(c).cast("string")
    line = (F.when(key % 13 == 0, F.lit("   ")).when(key % 11 == 0, text("l_quantity")).when(key % 7 == 0, F.concat_ws(" ", text("l_quantity"), F.lit("x1"), text("l_linenumber")))
            .when(key % 5 == 0, F.concat_ws(" ", text("l_quantity"), text("l_discount"), F.lit("none"))).otherwise(F.concat_ws("  ", text("l_quantity"), text("l_discount"), text("l_linenumber"))))
    seen = Observation("lines")
    pts = parse_points(li.select(line.alias("value")), 2, True, on_error="drop", counts=seen)
    total = pts.agg(F.sum(F.col("x")[0]).alias("s")).first()["s"]
    got = {**seen.get, "quantity": round(float(total), 6)}
    return spark.createDataFrame([tuple(got[c] for c in ("lines", "blank", "short", "number", "label", "kept", "quantity"))],
                                 "lines long, blank long, short long, number long, label long, kept long, quantity double")


def q_bounded_shards(spark, d):
    """Shards of the line items under a bound that hash buckets would break: how many points they
    hold, whether the bound holds, and whether equal order keys share one."""
    from mixshard.sources.points import assign_bounded_shards

    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.xxhash64("l_orderkey", "l_linenumber").alias("point_id"))
    n = li.count()
    limit = -(-n // 16)
    out, _ = assign_bounded_shards(li, 16, limit)
    per = out.groupBy("shard").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.sum("c").alias("n_points"), (F.max("c") <= limit).alias("within"), (F.count(F.lit(1)) <= 32).alias("few"))


def q_points_from_table(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    p = points_from_table(part, id_col="p_partkey", cols=["p_size", "p_retailprice"], scale=True)
    return p.select("point_id", _r(F.col("x")[0]).alias("x1"), _r(F.col("x")[1]).alias("x2"))


def q_dense_point_ids(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_retailprice")
    return dense_ids(part, order_by=["p_retailprice", "p_partkey"]).select("p_partkey", "point_id")


def q_point_count(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    p = points_from_table(li, cols=["l_quantity", "l_discount"], id_col="l_orderkey")
    return p.agg(F.count(F.lit(1)).alias("n_points"))


def q_shard_sizes(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    p = points_from_table(part, id_col="p_partkey", cols=["p_size", "p_retailprice"])
    from mixshard.sources.points import assign_shards

    return assign_shards(p, 7, method="mod").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


def q_center_sizes_zero_filled(spark, d):
    pts = emb_points(spark, d)
    model = label_model(pts).select("cluster_id", "phi")
    far = spark.range(1).select(F.lit(10).cast("int").alias("cluster_id"),
                                F.array_repeat(F.lit(FAR), DIM).alias("phi"))
    centres = model.unionByName(far)
    a = sc.nearest_center(pts, centres)
    return sm.center_sizes(a, centres.select("cluster_id")).select("cluster_id", F.col("size").cast("long"))


def q_expected_weights(spark, d):
    m = label_model(emb_points(spark, d))
    return m.select("cluster_id", F.col("size").cast("long").alias("size"), _r(F.col("beta")).alias("beta"),
                    _r(F.col("beta_u")).alias("beta_u"))


def _each(df: DataFrame, keys: list[str], values: str, out: str) -> DataFrame:
    """One row per (row, cluster) of the aligned arrays ``cluster_ids`` and ``values``."""
    z = df.select(*keys, F.explode(F.arrays_zip("cluster_ids", values)).alias("t"))
    return z.select(*keys, F.col("t.cluster_ids").alias("cluster_id"), _r(F.col(f"t.{values}")).alias(out))


def q_squared_distances(spark, d):
    pts = emb_points(spark, d)
    return _each(sc.squared_distances(pts, label_model(pts)), ["point_id"], "sqdists", "sqdist")


def q_log_density(spark, d):
    pts = emb_points(spark, d)
    return _each(sc.log_densities(pts, label_model(pts), E), ["point_id"], "log_densities", "log_density")


def q_nearest_center(spark, d):
    pts = emb_points(spark, d)
    return nearest_assigned(pts, label_model(pts)).select("point_id", "cluster_id")


def q_map_assign(spark, d):
    pts = emb_points(spark, d)
    a = sc.map_assign(pts, label_model(pts), E, alpha=ALPHA, with_score=True)
    return a.select("point_id", "cluster_id", _r(F.col("score")).alias("score"))


def q_initial_assign(spark, d):
    pts = emb_points(spark, d)
    a = sc.map_assign(pts, label_model(pts), E, alpha=ALPHA, initial=True, with_score=True)
    return a.select("point_id", "cluster_id", _r(F.col("score")).alias("score"))


def q_cluster_points(spark, d):
    pts = emb_points(spark, d)
    a = nearest_assigned(pts, label_model(pts))
    return sm.cluster_points(a, 3).select("point_id", "shard", "label")


def q_membership_probabilities(spark, d):
    pts = emb_points(spark, d)
    m = sc.prior_log_weight(label_model(pts), "local", ALPHA)
    return _each(sc.membership(pts, m, E_SOFT), ["point_id"], "probs", "prob")


def q_shard_cluster_summaries(spark, d):
    s, _, _ = summaries(spark, d)
    ys, yq = fingerprint("y_mean")
    return s.select("shard", "local_id", F.col("size").cast("long").alias("size"), _r(ys).alias("y_sum"),
                    _r(yq).alias("y_sq"))


def q_split_known_new(spark, d):
    s, _, _ = summaries(spark, d)
    known, _ = mg.split_known_new(s, K_KNOWN)
    new = mg.unabsorbed(s, known)
    out = known.withColumn("kind", F.lit("known")).unionByName(new.withColumn("kind", F.lit("new")))
    return out.select("shard", "local_id", F.col("size").cast("long").alias("size"), "kind")


def q_merge_same_id(spark, d):
    ind, subs, _, _, _ = merged(spark, d)
    ns = subs.groupBy("ind_id").agg(F.count(F.lit(1)).alias("n_subs"))
    ys, yq = fingerprint("y_mean")
    return ind.join(ns, "ind_id").select("ind_id", F.col("size").cast("long").alias("size"), "n_subs",
                                         _r(ys).alias("y_sum"), _r(yq).alias("y_sq"), "prior_var")


def q_posterior_params(spark, d):
    ind, _, _, _, _ = merged(spark, d)
    pp = mg.posterior_params(ind, E)
    ms, mq = fingerprint("post_mean")
    return pp.select("ind_id", _r(F.col("post_var"), 9).alias("post_var"), _r(ms).alias("pm_sum"),
                     _r(mq).alias("pm_sq"))


def _supers(ind: DataFrame) -> DataFrame:
    pp = mg.posterior_params(ind, E)
    return pp.select(F.col("ind_id").alias("cluster_id"), "size", F.col("post_mean").alias("phi"))


def q_summary_map_assign(spark, d):
    ind, _, s, _, _ = merged(spark, d)
    m = sc.prior_log_weight(_supers(ind), "global")
    a = sc.best_cluster(s.select("shard", "local_id", "y_mean"), m, E, x="y_mean")
    return a.select("shard", "local_id", "cluster_id")


def q_summary_probabilities(spark, d):
    ind, _, s, _, _ = merged(spark, d)
    m = sc.prior_log_weight(_supers(ind), "global")
    return _each(sc.membership(s.select("shard", "local_id", "y_mean"), m, E_SOFT, x="y_mean"), ["shard", "local_id"], "probs", "prob")


def q_relabel_points(spark, d):
    ind, subs, _, _, a = merged(spark, d)
    asg = a.select("point_id", "shard", F.col("cluster_id").alias("local_id"))
    return mg.relabel(asg, subs.withColumnRenamed("ind_id", "cluster_id")).select("point_id", "cluster_id")


def q_dense_cluster_ids(spark, d):
    sizes = q_center_sizes_zero_filled(spark, d)
    return mg.dense_cluster_ids(sizes).select("cluster_id", "new_id")


def q_cluster_members(spark, d):
    _, subs, _, _, _ = merged(spark, d)
    return mg.cluster_members(subs.withColumnRenamed("ind_id", "cluster_id"))


def q_contingency(spark, d):
    pts = emb_points(spark, d)
    return ev.contingency(nearest_assigned(pts, label_model(pts)))


def q_contingency_totals(spark, d):
    pts = emb_points(spark, d)
    return ev.contingency_totals(ev.contingency(nearest_assigned(pts, label_model(pts))))


def q_adjusted_rand_index(spark, d):
    pts = emb_points(spark, d)
    r = ev.adjusted_rand_index(nearest_assigned(pts, label_model(pts)))
    return r.select(_r(F.col("ari")).alias("ari"), "n")


def q_residual_sum(spark, d):
    pts = emb_points(spark, d)
    model = label_model(pts)
    r = ev.residual_sum(nearest_assigned(pts, model), model, E, by=["shard"])
    return r.select("shard", _r(F.col("rss")).alias("rss"))


def q_score_model(spark, d):
    pts = emb_points(spark, d)
    model = label_model(pts)
    r = ev.score_model(nearest_assigned(pts, model), model, E)
    return r.select("n_clusters", _r(F.col("ari")).alias("ari"), _r(F.col("rss")).alias("rss"))


def q_aligned_shards(spark, d):
    """The shard keys that the fit uses: all points in exactly the wanted number of shards."""
    from mixshard.sources.points import assign_shards

    part = spark.read.parquet(f"{d}/part.parquet")
    p = points_from_table(part, id_col="p_partkey", cols=["p_size", "p_retailprice"])
    return assign_shards(p, 7, method="aligned").agg(F.countDistinct("shard").alias("n_shards"), F.count(F.lit(1)).alias("n_points"))


def q_kmeans_step(spark, d):
    """One K-means update from the label centroids."""
    from mixshard.functions.vectors import vector_mean

    pts = emb_points(spark, d)
    c = vector_mean(nearest_assigned(pts, label_model(pts)), ["cluster_id"], "x", DIM, out="phi")
    ps, pq = fingerprint("phi")
    return c.select("cluster_id", "size", _r(ps).alias("phi_sum"), _r(pq).alias("phi_sq"))


def q_merge_sweep(spark, d):
    """One batch sweep of the global merge over the merged individuals, centres at their
    posterior means."""
    from mixshard.operators.global_merge import batch_moves
    from mixshard.params import DPMParams

    ind, _, _, _, _ = merged(spark, d)
    pp = cut(mg.posterior_params(ind, E))
    supers = pp.select(F.col("ind_id").cast("long").alias("sc_id"), "size", F.lit(1).cast("long").alias("members"), F.col("post_mean").alias("phi"))
    cur = pp.select(F.col("ind_id").cast("long").alias("ind_id"), "size", "y_mean", "phi", F.col("ind_id").cast("long").alias("c"))
    moved = batch_moves(cur, supers, DPMParams(E=E, S=S), GAMMA, F.lit(-1).cast("long"))
    return moved.select("ind_id", F.col("c").alias("cluster_id"))


def q_posterior_centers(spark, d):
    from mixshard.functions.draws import keyed_normal_vector

    ind, _, _, _, _ = merged(spark, d)
    pp = mg.posterior_params(ind, E)
    phi = keyed_normal_vector(F.col("post_mean"), F.col("post_var"), 7, 41, F.lit(0), F.col("ind_id"))
    ps, _ = fingerprint("phi")
    return pp.withColumn("phi", phi).select(F.col("ind_id").alias("cluster_id"), _r(F.col("post_var"), 9).alias("post_var"), _r(ps).alias("phi_sum"))


def q_nearest_of_many(spark, d):
    """Every line item to the nearest of all parts by (quantity or size, unit price): many centres,
    so an index over them skips the cells that cannot win."""
    part = spark.read.parquet(f"{d}/part.parquet")
    centres = points_from_table(part, id_col="p_partkey", cols=["p_size", "p_retailprice"]).select(F.col("point_id").alias("cluster_id"), F.col("x").alias("phi"))
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    x = F.array(F.col("l_quantity").cast("double"), (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")))
    out = sc.nearest_center(li.select("l_orderkey", "l_linenumber", "l_partkey", x.alias("x")), centres)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "cluster_id")


def _coverage(labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(n_points, n_ids, total_size): what an assignment covers and what its clusters hold."""
    a = labels.agg(F.count(F.lit(1)).alias("n_points"), F.countDistinct("point_id").alias("n_ids"))
    return a.crossJoin(sizes.agg(F.round(F.sum("size")).cast("long").alias("total_size")))


def q_sequential_first_pass(spark, d):
    """The first pass of the sweep: points of a shard placed one after the other, sizes growing."""
    from mixshard.operators.sweep import point_labels, run_sweep
    from mixshard.params import DPMParams

    pts, bmodel, _, beta_u = _sweep_inputs(spark, d)
    out = run_sweep(pts, None, bmodel, DPMParams(E=E, S=S, seed=7, local_sweeps=0), 0, GAMMA, beta_u)
    return point_labels(out).select("point_id", F.col("local_id").alias("cluster_id"))


def q_sweep_coverage(spark, d):
    from mixshard.operators.sweep import point_labels

    out = _swept(spark, d)[0]
    return _coverage(point_labels(out), out.where("kind = 'c'"))


def q_merge_coverage(spark, d):
    from mixshard.operators.sweep import point_labels

    out, model, ind_subs, mem = _merged_sweep(spark, d)
    sub = ind_subs.join(mem, "ind_id").select("shard", "local_id", "cluster_id")
    return _coverage(mg.relabel(point_labels(out), sub), model)


def q_fit_coverage(spark, d):
    from mixshard.params import DPMParams
    from mixshard.plans.fit import fit

    res = fit(emb_points(spark, d).drop("shard"), DPMParams(E=E, S=S, seed=7), k_init=10, rounds=1, shards=SHARDS)
    return _coverage(res.assignments, res.model)


DETERMINISTIC = {
    "parse_points_text": q_parse_points_text,
    "points_from_table": q_points_from_table,
    "parse_counts": q_parse_counts,
    "bounded_shards": q_bounded_shards,
    "dense_point_ids": q_dense_point_ids,
    "point_count": q_point_count,
    "shard_sizes": q_shard_sizes,
    "center_sizes_zero_filled": q_center_sizes_zero_filled,
    "expected_weights": q_expected_weights,
    "squared_distances": q_squared_distances,
    "log_density": q_log_density,
    "nearest_center": q_nearest_center,
    "map_assign": q_map_assign,
    "initial_assign": q_initial_assign,
    "cluster_points": q_cluster_points,
    "membership_probabilities": q_membership_probabilities,
    "shard_cluster_summaries": q_shard_cluster_summaries,
    "split_known_new": q_split_known_new,
    "merge_same_id": q_merge_same_id,
    "posterior_params": q_posterior_params,
    "summary_map_assign": q_summary_map_assign,
    "summary_probabilities": q_summary_probabilities,
    "relabel_points": q_relabel_points,
    "dense_cluster_ids": q_dense_cluster_ids,
    "cluster_members": q_cluster_members,
    "contingency": q_contingency,
    "contingency_totals": q_contingency_totals,
    "adjusted_rand_index": q_adjusted_rand_index,
    "residual_sum": q_residual_sum,
    "score_model": q_score_model,
    "aligned_shards": q_aligned_shards,
    "kmeans_step": q_kmeans_step,
    "merge_sweep": q_merge_sweep,
    "posterior_centers": q_posterior_centers,
    "sequential_first_pass": q_sequential_first_pass,
    "nearest_of_many": q_nearest_of_many,
    "sweep_coverage": q_sweep_coverage,
    "merge_coverage": q_merge_coverage,
    "fit_coverage": q_fit_coverage,
}


# ------------------------------------------------- random / iterative queries
# No SQL twin: the driver checks rows only; tests check their properties.
def q_kmeans_init(spark, d):
    from mixshard.operators.kmeans import kmeans_init

    _, sizes = kmeans_init(emb_points(spark, d), 10, iters=10, seed=7)
    return sizes.select("cluster_id", F.col("size").cast("long").alias("size"))


def q_dirichlet_weights(spark, d):
    from mixshard.functions.draws import dirichlet_weights

    m = label_model(emb_points(spark, d)).select("cluster_id", "size")
    betas, bu = dirichlet_weights(m, GAMMA, seed=7, round_=0)
    both = betas.select("cluster_id", "beta").unionByName(bu.select(F.lit(-1).alias("cluster_id"), F.col("beta_u").alias("beta")))
    return both.select("cluster_id", _r(F.col("beta"), 9).alias("beta"))


def q_concentration_step(spark, d):
    """One concentration update per shard, in both parametrisations."""
    from mixshard.functions.draws import concentration_step

    per = emb_points(spark, d).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("k"))
    step = lambda form: concentration_step(F.lit(0.25) + F.col("shard"), F.col("k"), F.col("n"), 1.0, 0.5, form, F.lit(7), F.lit(21), F.lit(0), F.col("shard"), F.lit(0))
    return per.select("shard", _r(step("rate"), 9).alias("rate"), _r(step("scale")).alias("scale"))


def q_exact_means(spark, d):
    """Weighted means of the line items by line number, summed without rounding."""
    from mixshard.functions.vectors import exact_vector_mean

    li = spark.read.parquet(f"{d}/lineitem.parquet")
    price = F.col("l_extendedprice").cast("double")
    rows = li.select("l_linenumber", F.array(price, price / 1e6).alias("x"), F.col("l_quantity").cast("double").alias("w"))
    m = exact_vector_mean(rows, ["l_linenumber"], "x", 2, w="w")
    return m.select("l_linenumber", F.col("size").cast("long").alias("weight"), _r(F.col("y_mean")[0]).alias("price"), _r(F.col("y_mean")[1], 9).alias("small"))


def q_full_sweep(spark, d):
    """First pass and one whole sweep (leave, score, open, place) over the standardised parts,
    from the centroids of four size classes."""
    from mixshard.functions.vectors import vector_mean
    from mixshard.operators.model import model_arrays
    from mixshard.operators.sweep import point_labels, run_sweep
    from mixshard.params import DPMParams

    part = spark.read.parquet(f"{d}/part.parquet")
    n = part.count()
    shards = max(8, -(-n // 250))  # a task's points are bounded
    pts = points_from_table(part.withColumn("class", F.floor(F.col("p_size") / 13).cast("int")), id_col="p_partkey", cols=["p_size", "p_retailprice"], label_col="class", scale=True)
    pts = cut(pts.withColumn("shard", F.pmod("point_id", F.lit(shards)).cast("int")), "sweep-points")
    cm = vector_mean(pts, ["label"], "x", 2, out="phi").select(F.col("label").alias("cluster_id"), F.col("size").cast("double").alias("size"), "phi")
    _, phi, beta, beta_u = model_arrays(sm.expected_weights(cm, GAMMA), "beta", "beta_u")
    p = DPMParams(E=0.05, S=1.0, seed=7, local_sweeps=1)
    out = cut(run_sweep(pts, None, spark.sparkContext.broadcast((phi, beta)), p, 0, GAMMA, float(beta_u[0])), "sweep")
    state = out.where("kind = 's'").select("shard", _r(F.col("alpha")).alias("alpha"), _r(F.col("beta_u"), 9).alias("beta_u"), F.col("local_id").alias("clusters"))
    return point_labels(out).withColumnRenamed("local_id", "cluster_id").join(state, "shard").select("point_id", "shard", "cluster_id", "alpha", "beta_u", "clusters")


def _sweep_inputs(spark, d):
    import numpy as np

    from mixshard.operators.model import collect_model
    from mixshard.sources.points import shard_count_for

    pts = emb_points(spark, d)
    shards = shard_count_for(pts.count(), SHARDS, dim=DIM)  # a task's points are bounded
    pts = pts.withColumn("shard", F.pmod(F.col("point_id"), F.lit(shards)).cast("int"))
    rows = collect_model(label_model(pts).select("cluster_id", "phi", "beta", "beta_u"))
    phi = np.array([r["phi"] for r in rows])
    beta = np.array([r["beta"] for r in rows])
    return pts, spark.sparkContext.broadcast((phi, beta)), len(rows), float(rows[0]["beta_u"])


def _swept(spark, d):
    """(sweep output, points, number of clusters before it) of one round over ``embeddings``."""
    from mixshard.operators.sweep import run_sweep
    from mixshard.params import DPMParams

    pts, bmodel, k, beta_u = _sweep_inputs(spark, d)
    return cut(run_sweep(pts, None, bmodel, DPMParams(E=E, S=S, seed=7), 0, GAMMA, beta_u), "sweep"), pts, k


def q_local_sweep(spark, d):
    out, _, _ = _swept(spark, d)
    return out.where("kind = 'c'").select("shard", "local_id", F.col("size").cast("long").alias("size"))


def _merged_sweep(spark, d):
    """(sweep output, merged model, map of summaries, map of individuals) after one round."""
    from mixshard.operators.global_merge import global_merge
    from mixshard.params import DPMParams

    out, pts, k = _swept(spark, d)
    summ = out.where("kind = 'c'").select("shard", "local_id", "size", "y_mean", "phi")
    ind, subs = mg.merge_same_id(summ, k, DIM, None, S)
    ind = cut(ind)
    model, mem, _ = global_merge(ind, DPMParams(E=E, S=S, seed=7), GAMMA, pts.count(), 0)
    return out, model, subs, mem


def q_global_merge(spark, d):
    return _merged_sweep(spark, d)[1].select("cluster_id", F.col("size").cast("long").alias("size"))


def _fit(spark, d):
    from mixshard.params import DPMParams
    from mixshard.plans.fit import fit

    li = spark.read.parquet(f"{d}/lineitem.parquet")
    pts = points_from_table(li, cols=["l_quantity", "l_discount"], scale=True)
    return fit(pts, DPMParams(E=0.05, S=1.0, seed=7), k_init=8, rounds=2, shards=SHARDS)


def q_dpm_fit(spark, d):
    res = _fit(spark, d)
    return res.assignments.select("point_id", "cluster_id")


def q_round_report(spark, d):
    from mixshard.params import DPMParams
    from mixshard.plans.fit import fit

    res = fit(emb_points(spark, d).drop("shard"), DPMParams(E=E, S=S, seed=7), k_init=10, rounds=2, shards=SHARDS)
    return res.report


#: Draws keyed by hashes that DuckDB computes alike.
DETERMINISTIC |= {"dirichlet_weights": q_dirichlet_weights, "concentration_step": q_concentration_step, "full_sweep": q_full_sweep, "exact_means": q_exact_means}

RANDOM = {
    "kmeans_init": q_kmeans_init,
    "local_sweep": q_local_sweep,
    "global_merge": q_global_merge,
    "dpm_fit": q_dpm_fit,
    "round_report": q_round_report,
}
