"""Keyed random draws: every value depends only on (seed, stream, key...).

A recomputed task (lost executor, different shuffle partitioning) therefore
draws the same numbers. Used on model-sized tables (one row per cluster) and,
via ``rng_for``, inside the grouped samplers.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MASK = (1 << 63) - 1

# Dirichlet parameters are floored here: a centre of size 0 must not break the draw.
MIN_DIRICHLET_PARAM = 1e-9


def rng_for(*key: int) -> np.random.Generator:
    return np.random.default_rng([int(k) & _MASK for k in key])


def keyed_uniforms(*key: Column) -> tuple[Column, Column]:
    """Two numbers in (0, 1), 52 bits each, from the MD5 of the key's parts joined by colons."""
    h = F.md5(F.concat_ws(":", *[k.cast("string") for k in key]))
    part = lambda at: (F.conv(F.substring(h, at, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return part(1), part(14)


def keyed_uniforms_of(*key) -> tuple[float, float]:
    """``keyed_uniforms`` of one key, outside a column."""
    h = hashlib.md5(":".join(map(str, key)).encode()).hexdigest()
    return (int(h[:13], 16) + 0.5) / float(1 << 52), (int(h[13:26], 16) + 0.5) / float(1 << 52)


def normal_of(*key) -> float:
    """The standard normal that ``keyed_normal_vector`` draws for (seed, stream, keys, coordinate)."""
    u, v = keyed_uniforms_of(*key)
    return math.sqrt(-2.0 * math.log(u)) * math.cos(2.0 * math.pi * v)


def keyed_normal_vector(mean: Column, var: Column, seed: int, stream: int, *keys: Column) -> Column:
    """mean + sqrt(var) * z with z ~ N(0, I), per row (RND-4), in built-in functions: a
    Box-Muller draw from the hash of (seed, stream, keys, coordinate)."""

    def at(m: Column, i: Column) -> Column:
        u, v = keyed_uniforms(F.lit(seed), F.lit(stream), *keys, i)
        return m + F.sqrt(var) * F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0 * math.pi) * v)

    return F.transform(mean, at)


#: Attempts of a rejection draw; each is taken with more than 95 in 100, so the mode that
#: stands in after the last is never seen.
TRIES = 64


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keyed_gamma(shape: Column, *key: Column) -> Column:
    """Gamma(shape, 1) per row in built-in functions (Marsaglia and Tsang's rejection; shapes below 1
    are drawn one higher and scaled by a power of a uniform). Attempt j is keyed by (key, j)."""

    def attempt(d: Column, c: Column, j: Column) -> Column:
        u, v = keyed_uniforms(*key, j)
        x = F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0 * math.pi) * v)

        def judged(t: Column) -> Column:
            w = F.pow(F.lit(1.0) + c * t, F.lit(3.0))
            take = F.ln(keyed_uniforms(*key, j, F.lit("a"))[0]) < F.lit(0.5) * t * t + d - d * w + d * F.ln(w)
            return F.when((c * t > -1.0) & take, d * w)

        return _let(x, judged)

    def drawn(a: Column) -> Column:
        d = F.when(a < 1.0, a + 1.0).otherwise(a) - F.lit(1.0 / 3.0)
        g = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("double"),
                        lambda got, j: F.coalesce(got, attempt(d, F.lit(1.0) / F.sqrt(F.lit(9.0) * d), j)))
        boost = F.when(a < 1.0, F.pow(keyed_uniforms(*key, F.lit("b"))[0], F.lit(1.0) / a)).otherwise(F.lit(1.0))
        return F.coalesce(g, d) * boost

    return _let(F.greatest(shape.cast("double"), F.lit(MIN_DIRICHLET_PARAM)), drawn)


def gamma_of(shape: float, *key) -> float:
    """``keyed_gamma`` of one key, outside a column."""
    a = max(float(shape), MIN_DIRICHLET_PARAM)
    d = (a + 1.0 if a < 1.0 else a) - 1.0 / 3.0
    c, g = 1.0 / math.sqrt(9.0 * d), d
    for j in range(TRIES):
        x = normal_of(*key, j)
        if c * x > -1.0:
            w = (1.0 + c * x) ** 3.0
            if math.log(keyed_uniforms_of(*key, j, "a")[0]) < 0.5 * x * x + d - d * w + d * math.log(w):
                g = d * w
                break
    return g * keyed_uniforms_of(*key, "b")[0] ** (1.0 / a) if a < 1.0 else g


def dirichlet_weights(sizes: DataFrame, gamma: float, seed: int, round_: int) -> tuple[DataFrame, DataFrame]:
    """Draw (beta_1..beta_K, beta_u) ~ Dirichlet(size_1..size_K, gamma) (RND-1).

    ``sizes`` is ``(cluster_id, size)``, one row per cluster. Returns the table with
    ``beta`` added and a one-row ``(beta_u)`` table. Each weight is a keyed
    Gamma draw in built-in functions; the normaliser is a one-row aggregate joined back.
    """
    key = (F.lit(seed), F.lit(11), F.lit(round_))
    g = sizes.withColumn("_g", keyed_gamma(F.col("size"), *key, F.col("cluster_id")))
    u = g.sparkSession.range(1).select(keyed_gamma(F.lit(float(gamma)), *key, F.lit(-1)).alias("_gu"))
    # a sum of decimals has no rounding and so no order
    tot = g.agg(F.sum(F.col("_g").cast("decimal(38,18)")).cast("double").alias("_s")).withColumn("_k", F.lit(0)).join(u.withColumn("_k", F.lit(0)), "_k")
    tot = tot.select("_k", (F.col("_s") + F.col("_gu")).alias("_t"), "_gu")
    j = g.withColumn("_k", F.lit(0)).join(F.broadcast(tot), "_k")
    betas = j.withColumn("beta", F.col("_g") / F.col("_t")).drop("_g", "_k", "_t", "_gu")
    beta_u = tot.select((F.col("_gu") / F.col("_t")).alias("beta_u"))
    return betas, beta_u


def concentration_step(conc: Column, k: Column, n: Column, a: float, b: float, parametrisation: str, *key: Column) -> Column:
    """One auxiliary-variable resampling per row (RND-5 per shard, RND-6 for the merge): the
    concentration of a DP with ``k`` clusters of ``n`` items.

    eta ~ Beta(conc + 1, n) from two Gamma draws; Gamma(a+k, .) and Gamma(a+k-1, .) are mixed with
    odds (a+k-1) : n(b - ln eta). ``rate`` uses b - ln eta as the rate (the standard method),
    ``scale`` as the scale, as the reference does."""
    n = F.greatest(n.cast("double"), F.lit(1.0))
    x, y = keyed_gamma(conc + 1.0, *key, F.lit("x")), keyed_gamma(n, *key, F.lit("y"))

    def mixed(r: Column) -> Column:
        rest = k + (a - 1.0)
        shape = rest + F.when(keyed_uniforms(*key, F.lit("u"))[0] <= rest / (rest + n * r), 1.0).otherwise(0.0)
        g = keyed_gamma(shape, *key, F.lit("g"))
        return g / r if parametrisation == "rate" else g * r

    return _let(F.lit(b) - _let(x, lambda v: F.ln(F.greatest(v / (v + y), F.lit(1e-300)))), mixed)


def concentration_of(conc: float, k: int, n: int, a: float, b: float, parametrisation: str, *key) -> float:
    """``concentration_step`` of one row, outside a column."""
    n = max(float(n), 1.0)
    x, y = gamma_of(conc + 1.0, *key, "x"), gamma_of(n, *key, "y")
    r, rest = b - math.log(max(x / (x + y), 1e-300)), a + k - 1.0
    shape = rest + (1.0 if keyed_uniforms_of(*key, "u")[0] <= rest / (rest + n * r) else 0.0)
    g = gamma_of(shape, *key, "g")
    return g / r if parametrisation == "rate" else g * r


# --- draws of single points: counters through a 32-bit hash, over whole arrays

_WORD = np.uint64(0xFFFFFFFF)
#: First value of the fold (fixed).
_START = np.uint64(0x9E3779B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words in which every bit reaches every other."""
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(0x7FEB352D)) & _WORD
    x = x ^ (x >> np.uint64(15))
    x = (x * np.uint64(0x846CA68B)) & _WORD
    return x ^ (x >> np.uint64(16))


def counter(*words, start=_START) -> np.ndarray:
    """A 32-bit word for the key ``words`` (integers or arrays that broadcast, 32 bits each)."""
    h = np.asarray(start, np.uint64)
    for w in words:
        h = _mixed(h ^ (np.asarray(w, np.int64).astype(np.uint64) & _WORD))
    return h


def counter_uniform(h: np.ndarray, part: int) -> np.ndarray:
    """Number ``part`` of the key whose words were folded into ``h``, within (0, 1)."""
    return (counter(part, start=h) + 0.5) / 4294967296.0


def counter_normal(h: np.ndarray, part: int) -> np.ndarray:
    """Standard normals from parts ``part`` and ``part + 1``."""
    return np.sqrt(-2.0 * np.log(counter_uniform(h, part))) * np.cos(2.0 * math.pi * counter_uniform(h, part + 1))


def counter_chi2(h: np.ndarray, dof: int, part: int) -> np.ndarray:
    """Chi-squares; attempt j of the rejection takes the parts from ``part + 3 j``."""
    if dof <= 0:
        return np.zeros(h.shape)
    if dof == 1:
        return counter_normal(h, part) ** 2
    d = dof / 2.0 - 1.0 / 3.0
    c, flat = 1.0 / math.sqrt(9.0 * d), h.ravel()
    out, left = np.full(len(flat), d), np.arange(len(flat))
    for j in range(TRIES):
        x, u = counter_normal(flat[left], part + 3 * j), counter_uniform(flat[left], part + 3 * j + 2)
        w = np.maximum(1.0 + c * x, 0.0) ** 3
        with np.errstate(divide="ignore", invalid="ignore"):
            take = (w > 0) & (np.log(u) < 0.5 * x * x + d - d * w + d * np.log(w))
        out[left[take]] = d * w[take]
        left = left[~take]
        if not len(left):
            break
    return 2.0 * out.reshape(h.shape)


#: The candidate number that stands for what opening a cluster draws (fixed).
OPENING = 0x7FFFFFFF


class PointDraws:
    """The random numbers of one shard's sweeps: functions of (seed, round, shard, sweep, point,
    candidate), whatever order or engine asks for them."""

    def __init__(self, seed: int, round_: int, shard: int, ids: np.ndarray):
        self.base = counter(seed, seed >> 32, round_, shard)
        self.low, self.high = ids & 0xFFFFFFFF, ids >> 32
        self.rng = rng_for(seed, 21, round_, shard)  # Gumbel noise of assign='sample'
        self.key = (seed, 21, round_, shard)

    def _points(self, sweep: int, at) -> np.ndarray:
        return counter(sweep, self.low[at], self.high[at], start=self.base)

    def candidates(self, sweep: int, at, count: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """(component along the point, squared norm of the rest) of each point's fresh centres (RND-3)."""
        h = counter(np.arange(count)[None, :], start=self._points(sweep, at)[:, None])
        return counter_normal(h, 0), counter_chi2(h, dim - 1, 2)

    def opening(self, sweep: int, i: int, gamma: float, dim: int) -> tuple[float, np.ndarray]:
        """(stick-break share ~ Beta(1, gamma), the normals of the new centre's direction) (RND-2)."""
        h = counter(OPENING, start=self._points(sweep, slice(i, i + 1)))
        share = 1.0 - counter_uniform(h, 0)[0] ** (1.0 / gamma)
        return float(share), counter_normal(np.repeat(h, dim), 2 + 2 * np.arange(dim))

    def concentration(self, sweep: int, alpha: float, k: int, n: int, p) -> float:
        """The shard's concentration after a sweep (RND-5)."""
        return concentration_of(alpha, k, n, p.conc_a, p.conc_b, p.concentration, *self.key, sweep)
