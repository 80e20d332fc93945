"""DuckDB twins of the queries that draw: the same keyed uniforms, hashed by DuckDB.

Model-sized draws hash their key's text with MD5; draws of single points fold their key's
words through a 32-bit hash. Everything after the uniforms is written out again here.
"""

from __future__ import annotations

from mixshard.plans.oracle import PTS


def _u(h: str, at: int) -> str:
    """Uniform from 13 hex digits of an MD5."""
    return f"((CAST('0x' || substr({h}, {at}, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))"


def _normal(h: str) -> str:
    return f"(sqrt(-2.0 * ln({_u(h, 1)})) * cos(2.0 * pi() * {_u(h, 14)}))"


def _gamma(name: str, src: str) -> str:
    """CTE ``name(key, g)``: the Gamma draw of every (key, shape) of ``src``, first accepted attempt."""
    return f"""
{name}_d AS (SELECT key, greatest(shape, 1e-9) AS a, CASE WHEN greatest(shape, 1e-9) < 1.0 THEN greatest(shape, 1e-9) + 1.0 ELSE shape END - CAST(1 AS DOUBLE) / 3 AS d FROM {src}),
{name}_t AS (SELECT key, a, d, CAST(1 AS DOUBLE) / sqrt(9.0 * d) AS c, j, md5(key || ':' || j) AS h, md5(key || ':' || j || ':a') AS h2
  FROM {name}_d CROSS JOIN generate_series(0, 63) s(j)),
{name}_x AS (SELECT key, a, d, c, j, h2, {_normal("h")} AS x FROM {name}_t),
{name}_w AS (SELECT key, a, d, j, h2, x, CASE WHEN c * x > -1.0 THEN pow(1.0 + c * x, 3.0) END AS w FROM {name}_x),
{name}_f AS (SELECT key, a, arg_min(d * w, j) AS g FROM {name}_w WHERE w IS NOT NULL AND ln({_u("h2", 1)}) < 0.5 * x * x + d - d * w + d * ln(w) GROUP BY key, a),
{name} AS (SELECT key, g * CASE WHEN a < 1.0 THEN pow({_u("md5(key || ':b')", 1)}, 1.0 / a) ELSE 1.0 END AS g FROM {name}_f)"""


def _concentration(src: str, rows: str, a: float = 1.0, b: float = 0.5) -> str:
    """CTE ``conc(key, rate, scale)`` of every (key, conc, k, n) of ``rows``; ``src`` names the step."""
    return (f"{src}_xs AS (SELECT key || ':x' AS key, conc + 1.0 AS shape FROM {rows} UNION ALL SELECT key || ':y', n FROM {rows}),"
            + _gamma(f"{src}_xy", f"{src}_xs") + f""",
{src}_r AS (SELECT r.key, {a} + r.k - 1.0 AS rest, r.n, CAST({b} AS DOUBLE) - ln(greatest(x.g / (x.g + y.g), 1e-300)) AS r
  FROM {rows} r JOIN {src}_xy x ON x.key = r.key || ':x' JOIN {src}_xy y ON y.key = r.key || ':y'),
{src}_gs AS (SELECT key || ':g' AS key, rest + CASE WHEN {_u("md5(key || ':u')", 1)} <= rest / (rest + n * r) THEN 1.0 ELSE 0.0 END AS shape FROM {src}_r),"""
            + _gamma(f"{src}_g", f"{src}_gs") + f""",
conc AS (SELECT r.key, g.g / r.r AS rate, g.g * r.r AS scale FROM {src}_r r JOIN {src}_g g ON g.key = r.key || ':g')""")


SQL: dict[str, str] = {}

SQL["dirichlet_weights"] = "WITH " + PTS + """,
shapes AS (SELECT cluster_id, '7:11:0:' || cluster_id AS key, size AS shape FROM model UNION ALL SELECT -1, '7:11:0:-1', CAST(1 AS DOUBLE)),""" + _gamma("g", "shapes") + """
SELECT CAST(s.cluster_id AS INTEGER) AS cluster_id, round(g.g / (SELECT sum(g) FROM g), 9) AS beta FROM shapes s JOIN g USING (key)"""

SQL["concentration_step"] = """WITH
per AS (SELECT CAST(vec_id % 4 AS INTEGER) AS shard, count(*) AS c, count(DISTINCT label) AS k FROM embeddings GROUP BY 1),
steps AS (SELECT shard, '7:21:0:' || shard || ':0' AS key, 0.25 + shard AS conc, CAST(k AS DOUBLE) AS k, CAST(c AS DOUBLE) AS n FROM per),
""" + _concentration("st", "steps") + """
SELECT s.shard, round(c.rate, 9) AS rate, round(c.scale, 6) AS scale FROM steps s JOIN conc c USING (key)"""


# --- 32-bit words


def _mixed(x: str) -> str:
    one = f"list_transform([{x}], lambda v: (xor(v, v >> 16) * CAST(2146121005 AS UBIGINT)) & CAST(4294967295 AS UBIGINT))"
    two = f"list_transform({one}, lambda v: (xor(v, v >> 15) * CAST(2221713035 AS UBIGINT)) & CAST(4294967295 AS UBIGINT))"
    return f"list_transform({two}, lambda v: xor(v, v >> 16))[1]"


def _counter(start: str, *words: str) -> str:
    for w in words:
        start = _mixed(f"xor({start}, CAST({w} AS UBIGINT))")
    return start


def _cu(h: str, part: int) -> str:
    return f"((CAST({_counter(h, str(part))} AS DOUBLE) + 0.5) / CAST(4294967296 AS DOUBLE))"


def _cn(h: str, part: int) -> str:
    return f"(sqrt(-2.0 * ln({_cu(h, part)})) * cos(2.0 * pi() * {_cu(h, part + 1)}))"


def full_sweep(E: float, S: float, H: int, seed: int) -> str:
    """First pass and one sweep over the parts: points one after the other in each shard."""
    e, s = f"CAST({E} AS DOUBLE)", f"CAST({S} AS DOUBLE)"
    return f"""WITH RECURSIVE
pts AS (SELECT p_partkey AS point_id, (p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER () AS x1,
               (p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER () AS x2, p_size // 13 AS label,
               CAST(p_partkey % greatest(8, CAST(ceil((SELECT count(*) FROM part) / 250.0) AS BIGINT)) AS INTEGER) AS shard FROM part),
cen AS (SELECT label, avg(x1) AS c1, avg(x2) AS c2, count(*) / ((SELECT count(*) FROM pts) + 1.0) AS beta FROM pts GROUP BY label),
model AS (SELECT list(c1 ORDER BY label) AS p1, list(c2 ORDER BY label) AS p2, list(beta ORDER BY label) AS betas FROM cen),
hashed AS (SELECT *, x1 * x1 + x2 * x2 AS xn, row_number() OVER (PARTITION BY shard ORDER BY point_id) AS i, count(*) OVER (PARTITION BY shard) AS n,
  {_counter("CAST(2654435769 AS UBIGINT)", str(seed), "0", "0", "shard", "0", "point_id & 4294967295", "point_id >> 32")} AS h FROM pts),
drawn AS (SELECT *, {_counter("h", "c.c")} AS hc, c.c AS cand FROM hashed CROSS JOIN generate_series(0, {H - 1}) c(c)),
fresh AS (SELECT *, {_cn("hc", 0)} AS z, pow({_cn("hc", 2)}, 2) AS chi FROM drawn),
scored AS (SELECT *, -(xn - 2.0 * sqrt({s}) * sqrt(xn) * z + {s} * (z * z + chi)) / (2.0 * {e}) AS cv FROM fresh),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY cv DESC, cand) = 1),
opening AS (SELECT *, {_counter("h", "2147483647")} AS ho FROM best),
turns AS (SELECT *, 1.0 - {_cu("ho", 0)} AS share, {_cn("ho", 2)} AS w1, {_cn("ho", 4)} AS w2, x1 / sqrt(xn) AS u1, x2 / sqrt(xn) AS u2 FROM opening),
turned AS (SELECT *, w1 - (w1 * u1 + w2 * u2) * u1 AS v1, w2 - (w1 * u1 + w2 * u2) * u2 AS v2 FROM turns),
steps AS (SELECT shard, i, n, point_id, x1, x2, cv, share, sqrt({s}) * (z * u1 + sqrt(chi) * v1 / sqrt(v1 * v1 + v2 * v2)) AS n1,
                 sqrt({s}) * (z * u2 + sqrt(chi) * v2 / sqrt(v1 * v1 + v2 * v2)) AS n2 FROM turned),
run(shard, k, n, sizes, p1, p2, betas, bu, labels) AS (
  SELECT t.shard, CAST(0 AS BIGINT), t.n, list_transform(m.p1, lambda v: CAST(0 AS DOUBLE)), m.p1, m.p2, m.betas, 1.0 / ((SELECT count(*) FROM pts) + CAST(1 AS DOUBLE)), CAST([] AS BIGINT[])
  FROM (SELECT DISTINCT shard, n FROM steps) t CROSS JOIN model m
  UNION ALL
  SELECT shard, k + 1, n, CASE WHEN opens THEN list_append(sz, CAST(1 AS DOUBLE)) ELSE list_transform(generate_series(1, len(sz)), lambda j: sz[j] + CASE WHEN j = top THEN 1.0 ELSE 0.0 END) END,
         CASE WHEN opens THEN list_append(p1, n1) ELSE p1 END, CASE WHEN opens THEN list_append(p2, n2) ELSE p2 END, CASE WHEN opens THEN list_append(betas, share * bu) ELSE betas END,
         CASE WHEN opens THEN bu * (1.0 - share) ELSE bu END,
         CASE WHEN k < n THEN list_append(labels, top) ELSE list_transform(generate_series(1, len(labels)), lambda q: CASE WHEN q = i THEN CASE WHEN opens THEN len(sz) + 1 ELSE top END ELSE labels[q] END) END
  FROM (SELECT *, CAST(list_position(sc, list_max(sc)) AS BIGINT) AS top, k >= n AND cv + ln(bu / {H}) > list_max(sc) AS opens
        FROM (SELECT *, list_transform(generate_series(1, len(sz)), lambda j: ln(sz[j] + betas[j]) - ((x1 - p1[j]) * (x1 - p1[j]) + (x2 - p2[j]) * (x2 - p2[j])) / (2.0 * {e})) AS sc
              FROM (SELECT r.*, o.i, o.x1, o.x2, o.cv, o.share, o.n1, o.n2,
                           list_transform(generate_series(1, len(r.sizes)), lambda j: r.sizes[j] - CASE WHEN r.k >= r.n AND j = r.labels[o.i] THEN 1.0 ELSE 0.0 END) AS sz
                    FROM run r JOIN steps o ON o.shard = r.shard AND o.i = r.k % r.n + 1 WHERE r.k < 2 * r.n)))),
done AS (SELECT shard, n, bu, labels, len(sizes) AS clusters FROM run WHERE k = 2 * n),
alphas AS (SELECT shard, '{seed}:21:0:' || shard || ':0' AS key, CAST(1 AS DOUBLE) AS conc, CAST(clusters AS DOUBLE) AS k, CAST(n AS DOUBLE) AS n FROM done),
{_concentration("st", "alphas")}
SELECT s.point_id, s.shard, CAST(d.labels[s.i] - 1 AS INTEGER) AS cluster_id, round(c.rate, 6) AS alpha, round(d.bu, 9) AS beta_u, CAST(d.clusters AS INTEGER) AS clusters
FROM steps s JOIN done d USING (shard) JOIN alphas a USING (shard) JOIN conc c USING (key)"""


SQL["full_sweep"] = full_sweep(0.05, 1.0, 3, 7)

SQL["exact_means"] = """
SELECT l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS weight, round(sum(CAST(l_quantity AS DOUBLE) * CAST(l_extendedprice AS DOUBLE)) / sum(l_quantity), 6) AS price,
       round(sum(CAST(l_quantity AS DOUBLE) * (CAST(l_extendedprice AS DOUBLE) / 1e6)) / sum(l_quantity), 9) AS small
FROM lineitem GROUP BY l_linenumber"""
