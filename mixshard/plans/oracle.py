"""DuckDB twins of the deterministic queries in ``catalog`` (same column names).

Written independently in plain SQL over the raw tables: vectors are unnested to
(i, v) rows, centroids are ``avg`` per coordinate, argmax/argmin ties go to the
lowest id. Constants repeat ``catalog``'s fixed query parameters.
"""

from __future__ import annotations


def _sqd(a: str, b: str) -> str:
    return f"list_sum(list_transform(generate_series(1, len({a})), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


PTS = """pts AS (SELECT vec_id AS point_id, CAST(embedding AS DOUBLE[]) AS x, label,
                    CAST(vec_id % 4 AS INTEGER) AS shard FROM embeddings),
el AS (SELECT point_id, unnest(generate_series(1, len(x))) AS i, unnest(x) AS v FROM pts),
cen AS (SELECT p.label AS cluster_id, e.i, avg(e.v) AS v FROM el e JOIN pts p USING (point_id) GROUP BY p.label, e.i),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM pts),
model AS (SELECT c.cluster_id, list(c.v ORDER BY c.i) AS phi, s.size,
                 s.size / (t.n + 1.0) AS beta, 1.0 / (t.n + 1.0) AS beta_u
          FROM cen c
          JOIN (SELECT label AS cluster_id, CAST(count(*) AS DOUBLE) AS size FROM pts GROUP BY label) s USING (cluster_id)
          CROSS JOIN tot t GROUP BY c.cluster_id, s.size, t.n),
dist AS (SELECT p.point_id, p.shard, p.label, m.cluster_id, m.size, m.beta, """ + _sqd("p.x", "m.phi") + """ AS d
         FROM pts p CROSS JOIN model m),
near AS (SELECT point_id, shard, label, cluster_id, d FROM dist
         QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, cluster_id) = 1)"""

# per-shard summaries (long form), their sizes, and the merged individuals (long form)
SUMM = PTS + """,
ys AS (SELECT n.shard, n.cluster_id AS local_id, e.i, avg(e.v) AS y, count(*) AS c
       FROM near n JOIN el e USING (point_id) GROUP BY n.shard, n.cluster_id, e.i),
summ AS (SELECT shard, local_id, max(c) AS size FROM ys GROUP BY shard, local_id)"""

IND = SUMM + """,
kn AS (SELECT local_id, i, sum(c * y) / sum(c) AS y, sum(c) AS size, count(*) AS n_subs
       FROM ys WHERE local_id < 6 GROUP BY local_id, i),
knr AS (SELECT local_id, CAST(dense_rank() OVER (ORDER BY local_id) - 1 AS INTEGER) AS ind_id
        FROM (SELECT DISTINCT local_id FROM kn)),
nk AS (SELECT count(*) AS nk FROM knr),
nwr AS (SELECT shard, local_id,
               CAST((SELECT nk FROM nk) + row_number() OVER (ORDER BY shard, local_id) - 1 AS INTEGER) AS ind_id
        FROM summ WHERE local_id >= 6),
ind AS (SELECT r.ind_id, k.i, k.y, CAST(k.size AS DOUBLE) AS size, k.n_subs, c.v AS m0, CAST(0.5 AS DOUBLE) AS v0
        FROM kn k JOIN knr r USING (local_id) JOIN cen c ON c.cluster_id = k.local_id AND c.i = k.i
        UNION ALL
        SELECT r.ind_id, y.i, y.y, CAST(y.c AS DOUBLE) AS size, 1 AS n_subs, CAST(0.0 AS DOUBLE) AS m0,
               CAST(1.0 AS DOUBLE) AS v0
        FROM nwr r JOIN ys y USING (shard, local_id)),
post AS (SELECT ind_id, i, size, v0, 1.0 / (size / CAST(0.015 AS DOUBLE) + 1.0 / v0) AS pv, y, m0 FROM ind),
subs AS (SELECT s.shard, s.local_id, r.ind_id FROM summ s JOIN knr r USING (local_id)
         UNION ALL SELECT shard, local_id, ind_id FROM nwr)"""

# summaries as vectors, scored against the superclusters (individuals with phi = posterior mean)
SUPER = IND + """,
sv AS (SELECT shard, local_id, list(y ORDER BY i) AS yv FROM ys GROUP BY shard, local_id),
sup AS (SELECT ind_id AS cluster_id, max(size) AS size,
               list(pv * (size / CAST(0.015 AS DOUBLE) * y + m0 / v0) ORDER BY i) AS phi
        FROM post GROUP BY ind_id),
sdist AS (SELECT s.shard, s.local_id, u.cluster_id, u.size, """ + _sqd("s.yv", "u.phi") + """ AS d
          FROM sv s CROSS JOIN sup u)"""


def _w(body: str, ctes: str = PTS) -> str:
    return "WITH " + ctes + "\n" + body


SQL: dict[str, str] = {}

SQL["parse_points_text"] = """
WITH l AS (SELECT regexp_split_to_array(trim('  ' || concat_ws('   ', l_quantity, l_discount, l_linenumber) || ' '),
                                        '\\s+') AS t FROM lineitem)
SELECT CAST(t[1] AS DOUBLE) AS x1, CAST(t[2] AS DOUBLE) AS x2, CAST(t[3] AS INTEGER) AS label FROM l"""

SQL["points_from_table"] = """
SELECT p_partkey AS point_id,
       round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS x1,
       round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS x2
FROM part"""

SQL["dense_point_ids"] = """
SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS point_id FROM part"""

SQL["point_count"] = "SELECT count(*) AS n_points FROM lineitem"

SQL["shard_sizes"] = "SELECT CAST(p_partkey % 7 AS INTEGER) AS shard, count(*) AS n FROM part GROUP BY 1"

CENTRES = PTS + """,
centres AS (SELECT cluster_id, phi FROM model
            UNION ALL SELECT 10 AS cluster_id, list_transform(generate_series(1, 64), lambda i: CAST(10.0 AS DOUBLE)) AS phi),
cd AS (SELECT p.point_id, c.cluster_id, """ + _sqd("p.x", "c.phi") + """ AS d FROM pts p CROSS JOIN centres c),
cn AS (SELECT point_id, cluster_id FROM cd QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, cluster_id) = 1),
csz AS (SELECT c.cluster_id, CAST(count(n.point_id) AS BIGINT) AS size
        FROM centres c LEFT JOIN cn n USING (cluster_id) GROUP BY c.cluster_id)"""

SQL["center_sizes_zero_filled"] = _w("SELECT cluster_id, size FROM csz", CENTRES)

SQL["expected_weights"] = _w("""
SELECT cluster_id, CAST(size AS BIGINT) AS size, round(beta, 6) AS beta, round(beta_u, 6) AS beta_u FROM model""")

SQL["squared_distances"] = _w("SELECT point_id, cluster_id, round(d, 6) AS sqdist FROM dist")

SQL["log_density"] = _w("""
SELECT point_id, cluster_id,
       round(-d / (2.0 * CAST(0.015 AS DOUBLE)) - 64 / 2.0 * ln(2.0 * pi() * CAST(0.015 AS DOUBLE)), 6) AS log_density
FROM dist""")

SQL["nearest_center"] = _w("SELECT point_id, cluster_id FROM near")

SQL["map_assign"] = _w("""
SELECT point_id, cluster_id, round(s, 6) AS score FROM (
  SELECT point_id, cluster_id, ln(size + 1.0 * beta) - d / (2.0 * CAST(0.015 AS DOUBLE)) AS s FROM dist)
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY s DESC, cluster_id) = 1""")

SQL["initial_assign"] = _w("""
SELECT point_id, cluster_id, round(s, 6) AS score FROM (
  SELECT point_id, cluster_id, ln(1.0 * beta) - d / (2.0 * CAST(0.015 AS DOUBLE)) AS s FROM dist)
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY s DESC, cluster_id) = 1""")

SQL["cluster_points"] = _w("SELECT point_id, shard, label FROM near WHERE cluster_id = 3")

SQL["membership_probabilities"] = _w("""
sc AS (SELECT point_id, cluster_id, ln(size + 1.0 * beta) - d / (2.0 * 0.5) AS s FROM dist),
mx AS (SELECT point_id, max(s) AS m FROM sc GROUP BY point_id),
z AS (SELECT point_id, sum(exp(s - m)) AS z FROM sc JOIN mx USING (point_id) GROUP BY point_id)
SELECT point_id, cluster_id, round(exp(s - (m + ln(z))), 6) AS prob FROM sc JOIN mx USING (point_id) JOIN z USING (point_id)""", PTS + ",")

SQL["shard_cluster_summaries"] = _w("""
SELECT shard, local_id, CAST(max(c) AS BIGINT) AS size, round(sum(y), 6) AS y_sum, round(sum(y * y), 6) AS y_sq
FROM ys GROUP BY shard, local_id""", SUMM)

SQL["split_known_new"] = _w("""
SELECT shard, local_id, CAST(size AS BIGINT) AS size, CASE WHEN local_id < 6 THEN 'known' ELSE 'new' END AS kind
FROM summ""", SUMM)

SQL["merge_same_id"] = _w("""
SELECT ind_id, CAST(max(size) AS BIGINT) AS size, CAST(max(n_subs) AS BIGINT) AS n_subs,
       round(sum(y), 6) AS y_sum, round(sum(y * y), 6) AS y_sq, max(v0) AS prior_var
FROM ind GROUP BY ind_id""", IND)

SQL["posterior_params"] = _w("""
SELECT ind_id, round(max(pv), 9) AS post_var,
       round(sum(pv * (size / CAST(0.015 AS DOUBLE) * y + m0 / v0)), 6) AS pm_sum,
       round(sum(pow(pv * (size / CAST(0.015 AS DOUBLE) * y + m0 / v0), 2)), 6) AS pm_sq
FROM post GROUP BY ind_id""", IND)

SQL["summary_map_assign"] = _w("""
SELECT shard, local_id, cluster_id FROM (
  SELECT shard, local_id, cluster_id, ln(size) - d / (2.0 * CAST(0.015 AS DOUBLE)) AS s FROM sdist)
QUALIFY row_number() OVER (PARTITION BY shard, local_id ORDER BY s DESC, cluster_id) = 1""", SUPER)

SQL["summary_probabilities"] = _w("""
sc AS (SELECT shard, local_id, cluster_id, ln(size) - d / (2.0 * 0.5) AS s FROM sdist),
mx AS (SELECT shard, local_id, max(s) AS m FROM sc GROUP BY shard, local_id),
z AS (SELECT shard, local_id, sum(exp(s - m)) AS z FROM sc JOIN mx USING (shard, local_id) GROUP BY shard, local_id)
SELECT shard, local_id, cluster_id, round(exp(s - (m + ln(z))), 6) AS prob FROM sc JOIN mx USING (shard, local_id) JOIN z USING (shard, local_id)""", SUPER + ",")

SQL["relabel_points"] = _w("""
SELECT n.point_id, s.ind_id AS cluster_id FROM near n JOIN subs s ON s.shard = n.shard AND s.local_id = n.cluster_id""",
                           IND)

SQL["dense_cluster_ids"] = _w("""
SELECT cluster_id, CAST(dense_rank() OVER (ORDER BY cluster_id) - 1 AS INTEGER) AS new_id FROM csz WHERE size > 0""",
                              CENTRES)

SQL["cluster_members"] = _w("""
SELECT ind_id AS cluster_id, shard, local_id, count(*) OVER (PARTITION BY ind_id) AS n_subs FROM subs""", IND)

CT = PTS + """,
ct AS (SELECT cluster_id, label, count(*) AS n FROM near WHERE label IS NOT NULL GROUP BY cluster_id, label),
ari AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM ct) AS idx,
               (SELECT sum(a * (a - 1) / 2.0) FROM (SELECT sum(n) AS a FROM ct GROUP BY cluster_id)) AS sa,
               (SELECT sum(b * (b - 1) / 2.0) FROM (SELECT sum(n) AS b FROM ct GROUP BY label)) AS sb,
               (SELECT sum(n) FROM ct) AS n),
ari2 AS (SELECT idx, sa, sb, n, sa * sb / (n * (n - 1) / 2.0) AS ex FROM ari)"""

SQL["contingency"] = _w("SELECT cluster_id, label, n FROM ct", CT)

SQL["contingency_totals"] = _w("""
SELECT coalesce(cluster_id, -1) AS cluster_id, coalesce(label, -1) AS label, CAST(sum(n) AS BIGINT) AS n, CAST(grouping(cluster_id, label) AS INTEGER) AS level
FROM ct GROUP BY CUBE (cluster_id, label)""", CT)

ARI_EXPR = "round(CASE WHEN (sa + sb) / 2.0 - ex = 0 THEN 1.0 ELSE (idx - ex) / ((sa + sb) / 2.0 - ex) END, 6)"

SQL["adjusted_rand_index"] = _w(f"SELECT {ARI_EXPR} AS ari, CAST(n AS BIGINT) AS n FROM ari2", CT)

SQL["residual_sum"] = _w("""
SELECT shard, round(sum(d / CAST(0.015 AS DOUBLE)), 6) AS rss FROM near GROUP BY shard""")

SQL["score_model"] = _w(f"""
SELECT CAST((SELECT count(*) FROM model) AS INTEGER) AS n_clusters, {ARI_EXPR} AS ari,
       round((SELECT sum(d / CAST(0.015 AS DOUBLE)) FROM near), 6) AS rss
FROM ari2""", CT)

SQL["aligned_shards"] = "SELECT CAST(7 AS BIGINT) AS n_shards, count(*) AS n_points FROM part"

SQL["kmeans_step"] = _w("""
SELECT cluster_id, max(c) AS size, round(sum(v), 6) AS phi_sum, round(sum(v * v), 6) AS phi_sq
FROM (SELECT n.cluster_id, e.i, avg(e.v) AS v, count(*) AS c FROM near n JOIN el e USING (point_id) GROUP BY n.cluster_id, e.i)
GROUP BY cluster_id""")

SQL["merge_sweep"] = _w("""
iv AS (SELECT ind_id, list(y ORDER BY i) AS yv, max(size) AS size FROM ind GROUP BY ind_id),
own AS (SELECT r.ind_id, list(c.v ORDER BY c.i) AS p0
        FROM (SELECT ind_id, local_id FROM knr UNION ALL SELECT ind_id, local_id FROM nwr) r JOIN cen c ON c.cluster_id = r.local_id GROUP BY r.ind_id),
ms AS (SELECT a.ind_id, u.cluster_id, ln(u.size) - """ + _sqd("a.yv", "u.phi") + """ / (2.0 * CAST(0.015 AS DOUBLE)) AS s
       FROM iv a JOIN sup u ON u.size > a.size OR (u.size = a.size AND u.cluster_id < a.ind_id)),
mb AS (SELECT * FROM ms QUALIFY row_number() OVER (PARTITION BY ind_id ORDER BY s DESC, cluster_id) = 1)
SELECT CAST(a.ind_id AS BIGINT) AS ind_id,
       CAST(CASE WHEN b.s IS NULL OR -""" + _sqd("o.p0", "a.yv") + """ / (2.0 * CAST(0.015 AS DOUBLE)) > b.s THEN a.ind_id ELSE b.cluster_id END AS BIGINT) AS cluster_id
FROM iv a JOIN own o USING (ind_id) LEFT JOIN mb b USING (ind_id)""", SUPER + ",")

SQL["posterior_centers"] = _w("""
zs AS (SELECT *, md5('7:41:0:' || ind_id || ':' || (i - 1)) AS h FROM post)
SELECT ind_id AS cluster_id, round(max(pv), 9) AS post_var,
       round(sum(pv * (size / CAST(0.015 AS DOUBLE) * y + m0 / v0)
           + sqrt(pv) * sqrt(-2.0 * ln((CAST('0x' || substr(h, 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0))
             * cos(2.0 * pi() * ((CAST('0x' || substr(h, 14, 13) AS BIGINT) + 0.5) / 4503599627370496.0))), 6) AS phi_sum
FROM zs GROUP BY ind_id""", IND + ",")

_COVERED = "SELECT count(*) AS n_points, count(DISTINCT vec_id) AS n_ids, count(*) AS total_size FROM embeddings"
SQL["sweep_coverage"] = SQL["merge_coverage"] = SQL["fit_coverage"] = _COVERED

SQL["sequential_first_pass"] = "WITH RECURSIVE " + PTS + """,
steps AS (SELECT shard, point_id, row_number() OVER (PARTITION BY shard ORDER BY point_id) AS k, list(d ORDER BY cluster_id) AS ds
          FROM dist GROUP BY shard, point_id),
w AS (SELECT list(beta ORDER BY cluster_id) AS betas FROM model),
run(shard, k, point_id, c, sizes) AS (
  SELECT s.shard, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(-1 AS BIGINT), list_transform(w.betas, lambda b: CAST(0 AS DOUBLE))
  FROM (SELECT DISTINCT shard FROM pts) s CROSS JOIN w
  UNION ALL
  SELECT shard, k, point_id, c, list_transform(generate_series(1, len(sizes)), lambda i: sizes[i] + CASE WHEN i - 1 = c THEN 1.0 ELSE 0.0 END)
  FROM (SELECT shard, k, point_id, sizes, CAST(list_position(sc, list_max(sc)) - 1 AS BIGINT) AS c
        FROM (SELECT r.shard, o.k, o.point_id, r.sizes, list_transform(generate_series(1, len(r.sizes)),
                lambda i: ln(r.sizes[i] + 1.0 * w.betas[i]) - o.ds[i] / (2.0 * CAST(0.015 AS DOUBLE))) AS sc
              FROM run r JOIN steps o ON o.shard = r.shard AND o.k = r.k + 1 CROSS JOIN w)))
SELECT point_id, CAST(c AS INTEGER) AS cluster_id FROM run WHERE point_id IS NOT NULL"""

SQL["nearest_of_many"] = """
WITH x AS (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS a, CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS b FROM lineitem),
near AS (SELECT a, b, arg_min(CAST(p_partkey AS INTEGER), (d, p_partkey)) AS cluster_id FROM (
  SELECT a, b, p_partkey, (a - CAST(p_size AS DOUBLE)) * (a - CAST(p_size AS DOUBLE)) + (b - CAST(p_retailprice AS DOUBLE)) * (b - CAST(p_retailprice AS DOUBLE)) AS d
  FROM x CROSS JOIN part) GROUP BY a, b)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, n.cluster_id
FROM lineitem l JOIN near n ON n.a = CAST(l_quantity AS DOUBLE) AND n.b = CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE)"""

# the sweep's shards are as many as bound a task's points and bytes
SQL["sequential_first_pass"] = SQL["sequential_first_pass"].replace(
    "vec_id % 4", "vec_id % greatest(4, CAST(ceil((SELECT count(*) FROM embeddings) / 250000.0) AS BIGINT), CAST(ceil((SELECT count(*) FROM embeddings) * 64 * 8 / 268435456.0) AS BIGINT))")

SQL["parse_counts"] = """
WITH l AS (SELECT CASE WHEN l_orderkey % 13 = 0 THEN [] WHEN l_orderkey % 11 = 0 THEN [CAST(l_quantity AS VARCHAR)]
    WHEN l_orderkey % 7 = 0 THEN [CAST(l_quantity AS VARCHAR), 'x1', CAST(l_linenumber AS VARCHAR)]
    WHEN l_orderkey % 5 = 0 THEN [CAST(l_quantity AS VARCHAR), CAST(l_discount AS VARCHAR), 'none']
    ELSE [CAST(l_quantity AS VARCHAR), CAST(l_discount AS VARCHAR), CAST(l_linenumber AS VARCHAR)] END AS t FROM lineitem),
f AS (SELECT t, CASE WHEN len(t) = 0 THEN 'blank' WHEN len(t) < 3 THEN 'short' WHEN try_cast(t[1] AS DOUBLE) IS NULL OR try_cast(t[2] AS DOUBLE) IS NULL THEN 'number'
    WHEN try_cast(t[3] AS INTEGER) IS NULL THEN 'label' ELSE 'kept' END AS fault FROM l)
SELECT count(*) AS lines, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'short') AS short, count(*) FILTER (fault = 'number') AS number,
       count(*) FILTER (fault = 'label') AS label, count(*) FILTER (fault = 'kept') AS kept, round(sum(CAST(t[1] AS DOUBLE)) FILTER (fault = 'kept'), 6) AS quantity FROM f"""

SQL["bounded_shards"] = "SELECT count(*) AS n_points, true AS within, true AS few FROM lineitem"
