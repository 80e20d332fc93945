"""Vector arithmetic as built-in column expressions (higher-order functions).

All covariances are multiples of the identity, so every density and posterior is
closed-form scalar arithmetic over ``ARRAY<DOUBLE>`` columns; nothing here leaves
the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Above this dimension, element-wise aggregates are done by ML's Summarizer
# instead of one aggregate expression per coordinate.
WIDE_DIM = 256


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sqdist(a, b) -> Column:
    """Squared Euclidean distance of two equal-length arrays (SC-1)."""
    diff2 = F.zip_with(_c(a), _c(b), lambda u, v: (u - v) * (u - v))
    return F.aggregate(diff2, F.lit(0.0), lambda acc, t: acc + t)


def safe_log(w) -> Column:
    """ln(w), with ln(0) = -inf as in IEEE arithmetic (Spark's ln gives NULL)."""
    w = _c(w)
    return F.when(w > 0, F.ln(w)).otherwise(F.lit(float("-inf")))


def log_density(x, mean, E: float) -> Column:
    """ln N(x; mean, E*I) in closed form (SC-2)."""
    d = F.size(_c(x)).cast("double")
    return -sqdist(x, mean) / F.lit(2.0 * E) - d / 2.0 * F.lit(math.log(2.0 * math.pi * E))


def zero_vector(dim) -> Column:
    """Prior mean: the zero vector of length ``dim`` (an int or a column) (SC-7)."""
    d = F.lit(dim) if isinstance(dim, int) else _c(dim)
    return F.array_repeat(F.lit(0.0), d)


def posterior_var(size, E: float, prior_var) -> Column:
    """Posterior variance of a centre: 1 / (size/E + 1/v0) (SC-5)."""
    v0 = F.lit(prior_var) if isinstance(prior_var, (int, float)) else _c(prior_var)
    return F.lit(1.0) / (_c(size) / F.lit(E) + F.lit(1.0) / v0)


def posterior_mean(y_mean, prior_mean, size, E: float, prior_var, post_var) -> Column:
    """Posterior mean: v * (size/E * ybar + m0/v0), element-wise (SC-6)."""
    v0 = F.lit(prior_var) if isinstance(prior_var, (int, float)) else _c(prior_var)
    v = _c(post_var)
    n = _c(size)
    return F.zip_with(_c(y_mean), _c(prior_mean), lambda y, m: v * (n / F.lit(E) * y + m / v0))


def fingerprint(v) -> tuple[Column, Column]:
    """(sum, sum of squares) of a vector: a compact check value for reports."""
    v = _c(v)
    return (
        F.aggregate(v, F.lit(0.0), lambda acc, t: acc + t),
        F.aggregate(v, F.lit(0.0), lambda acc, t: acc + t * t),
    )


#: Parts that ``exact_sum`` cuts a number into; each keeps 52 bits less the bits of the row count.
PARTS = 3


def _grids(df: DataFrame, values: list[Column]) -> list[float] | None:
    """The constant that rounds each part of a number to its grid, from one aggregate over ``df``:
    no sum of parts of one grid can pass 53 bits. None where a value is not finite."""
    largest = F.max(F.greatest(F.lit(0.0), *[F.abs(v) for v in values]))
    r = df.agg(largest.alias("m"), F.count(F.lit(1)).alias("n")).first()
    top, n = r["m"] or 0.0, max(1, r["n"])
    if not math.isfinite(top) or top > 2.0**900:
        return None
    out, e = [], math.frexp(top)[1] + 1
    for _ in range(PARTS):
        e = max(e + n.bit_length() + 1, -900)
        out.append(1.5 * 2.0**e)
        e = e - 52  # what is left is below half the grid
    return out


def exact_sum(value: Column, grids: list[float] | None) -> list[Column]:
    """Aggregates whose sum is the sum of ``value`` over a group, each exact whatever the order of
    its rows: (v + C) - C is v rounded to the grid of C, and sums on one grid do not round."""
    if grids is None:
        return [F.sum(value)]
    out, left = [], value
    for c in grids:
        part = (left + F.lit(c)) - F.lit(c)
        out.append(F.sum(part))
        left = left - part
    return out


def _total(parts: list[Column]) -> Column:
    """Parts of ``exact_sum`` put together, the smallest first."""
    out = parts[-1]
    for p in reversed(parts[:-1]):
        out = p + out
    return out


def exact_vector_mean(df: DataFrame, keys: list[str], y: str, dim: int, w: str | None = None, out: str = "y_mean",
                      extra: list[Column] | None = None) -> DataFrame:
    """``vector_mean`` or, with weights, ``vector_weighted_mean`` whose results are the same bits for
    every partitioning and order of rows, at any spread of magnitudes.

    One more pass finds the largest magnitude; then each number is cut into PARTS on fixed
    grids whose sums are exact. What is below the last grid (about 2^-90 of the largest
    number for a million rows) does not count. Wide vectors are summed a coordinate at a time."""
    weight = F.col(w) if w else F.lit(1.0)
    more = extra or []
    if dim > WIDE_DIM:
        long = df.select(*keys, weight.alias("_w"), F.posexplode(y).alias("_i", "_v"))
        g = _grids(long, [F.col("_w") * F.col("_v"), F.col("_w")])
        sums = long.groupBy(*keys, "_i").agg(_total(exact_sum(F.col("_w") * F.col("_v"), g)).alias("_s"), _total(exact_sum(F.col("_w"), g)).alias("size"))
        vec = sums.groupBy(*keys).agg(F.min("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda t: t["_s"]).alias("_s"))
        if more:
            vec = vec.join(df.groupBy(*keys).agg(*more), keys)
    else:
        cols = [(weight * F.col(y)[i]) for i in range(dim)]
        g = _grids(df, [weight, *cols])
        aggs = [F.array(*exact_sum(c, g)).alias(f"_{i}") for i, c in enumerate(cols)]
        got = df.groupBy(*keys).agg(F.array(*exact_sum(weight, g)).alias("_w"), *aggs, *more)
        parts = range(PARTS if g else 1)
        vec = got.withColumn("size", _total([F.col("_w")[k] for k in parts])).withColumn("_s", F.array(*[_total([F.col(f"_{i}")[k] for k in parts]) for i in range(dim)]))
        vec = vec.drop("_w", *[f"_{i}" for i in range(dim)])
    res = vec.withColumn(out, F.transform("_s", lambda t: t / F.col("size"))).drop("_s")
    return res if w else res.withColumn("size", F.col("size").cast("long"))


def vector_mean(df: DataFrame, keys: list[str], x: str, dim: int, out: str = "y_mean") -> DataFrame:
    """Per-group element-wise mean of an array column plus the group size (AGG-2).

    Partial aggregation runs map-side, so a hot group costs one partial row per
    input partition, not a shuffle of its points.
    """
    if dim <= WIDE_DIM:
        aggs = [F.array(*[F.avg(F.col(x)[i]) for i in range(dim)]).alias(out)]
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), *aggs)
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    g = df.withColumn("_v", array_to_vector(F.col(x))).groupBy(*keys)
    res = g.agg(F.count(F.lit(1)).alias("size"), Summarizer.mean(F.col("_v")).alias("_m"))
    return res.withColumn(out, vector_to_array("_m")).drop("_m")


def vector_weighted_mean(df: DataFrame, keys: list[str], y: str, w: str, dim: int, out: str = "y_mean",
                         extra: list[Column] | None = None) -> DataFrame:
    """Per-group mean of vectors weighted by ``w``: sum(w*y)/sum(w) (AGG-3), with sum(w) (AGG-4)
    and any ``extra`` aggregates of the same groups."""
    more = extra or []
    tot = F.sum(F.col(w))
    if dim <= WIDE_DIM:
        arr = F.array(*[F.sum(F.col(w) * F.col(y)[i]) for i in range(dim)])
        return (
            df.groupBy(*keys)
            .agg(tot.alias("size"), arr.alias("_s"), *more)
            .withColumn(out, F.transform("_s", lambda t: t / F.col("size")))
            .drop("_s")
        )
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    g = df.withColumn("_v", array_to_vector(F.col(y))).groupBy(*keys)
    res = g.agg(tot.alias("size"), Summarizer.mean(F.col("_v"), F.col(w)).alias("_m"), *more)
    return res.withColumn(out, vector_to_array("_m")).drop("_m")
