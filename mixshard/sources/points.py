"""Point sources: text lines and tables -> ``points(point_id, x, label, shard)``.

Text format: ``d`` whitespace-separated decimals, optionally followed by an
integer label (SRC-1). Tables: an array column or a list of numeric columns
(SRC-2). Ids are dense, 0-based, in file (or key) order (SRC-4); shards are a
hash of the id (SRC-6), so shard sizes do not depend on the data values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mixshard.session import cut

# Default bounds per shard: one shard is one pandas frame in one task.
MAX_SHARD_POINTS = 250_000
MAX_SHARD_BYTES = 256 * 1024 * 1024  # coordinates only (n x d x 8 bytes)


def parse_points(lines: DataFrame, dim: int, with_label: bool, value_col: str = "value",
                 on_error: str = "fail", counts: Observation | None = None) -> DataFrame:
    """Parse text lines into ``x ARRAY<DOUBLE>`` (first ``dim`` tokens) and ``label``.

    Tokens are split on runs of whitespace after trimming; extra tokens are ignored
    (PRJ-1). Without a label the column is NULL (PRJ-2). ``on_error='fail'`` raises
    on a malformed line (ANSI cast); ``'drop'`` drops it instead. ``counts``, with ``'drop'``,
    observes ``lines``, ``blank``, ``short`` (too few tokens), ``number`` (a coordinate that is
    none), ``label`` (a label that is no integer) and ``kept`` while the points are computed: no
    second scan. Its ``get`` waits for the first action on the points; each line counts once,
    under its first fault.
    """
    if on_error not in ("fail", "drop"):
        raise ValueError("on_error must be 'fail' or 'drop'")
    if counts is not None and on_error == "fail":
        raise ValueError("counts needs on_error='drop': with 'fail' a malformed line ends the read")
    tok = F.split(F.trim(F.col(value_col)), r"\s+")
    keep = [c for c in lines.columns if c != value_col]
    blank = F.coalesce(F.length(F.trim(F.col(value_col))) == 0, F.lit(True))
    need = dim + int(with_label)
    if on_error == "fail":
        df = lines.where(~blank).select(*keep, tok.alias("_t"))
        x = F.transform(F.slice("_t", 1, dim), lambda s: s.cast("double"))
        label = F.element_at("_t", dim + 1).cast("int") if with_label else F.lit(None).cast("int")
        return df.select(*keep, F.when(F.size("_t") >= need, F.lit(True)).otherwise(
            F.raise_error(F.lit(f"point line has fewer than {need} tokens"))).alias("_ok"),
            x.alias("x"), label.alias("label")).drop("_ok")
    df = lines.select(*keep, F.when(~blank, tok).alias("_t"))
    x = F.transform(F.slice("_t", 1, dim), lambda s: s.try_cast("double"))
    label = F.get("_t", F.lit(dim)).try_cast("int") if with_label else F.lit(None).cast("int")
    df = df.select(*keep, x.alias("x"), label.alias("label"), F.size("_t").alias("_n"))
    fault = (F.when(F.col("x").isNull(), "blank").when(F.col("_n") < need, "short")
             .when(F.exists("x", lambda v: v.isNull()), "number"))
    fault = (fault.when(F.col("label").isNull(), "label") if with_label else fault).otherwise("kept")
    df = df.withColumn("_fault", fault)
    if counts is not None:
        df = df.observe(counts, F.count(F.lit(1)).alias("lines"), *[F.count_if(F.col("_fault") == f).alias(f) for f in FAULTS], F.count_if(F.col("_fault") == "kept").alias("kept"))
    return df.where(F.col("_fault") == "kept").drop("_n", "_fault")


#: Why ``parse_points`` drops a line.
FAULTS = ("blank", "short", "number", "label")


# Largest table of per-partition or per-split offsets that is broadcast.
MAX_OFFSET_BYTES = 64 * 1024 * 1024


def _checked(df: DataFrame, row_bytes: int = 32) -> DataFrame:
    """Marked for a broadcast if its counted rows fit MAX_OFFSET_BYTES; joined by shuffle beyond."""
    return F.broadcast(df) if df.count() * row_bytes <= MAX_OFFSET_BYTES else df


def dense_ids(df: DataFrame, order_by: list[str] | None = None, name: str = "point_id") -> DataFrame:
    """Dense 0-based ids in partition order, or sorted by ``order_by``.

    No single-partition window over rows: each row gets its offset inside its partition
    from ``monotonically_increasing_id``, plus the prefix count of earlier partitions (a
    table with one row per partition). The tagged frame is written once, so both passes see
    the same partitioning and nothing stays cached; ``order_by`` keys must be unique for the
    ids to be reproducible.
    """
    if order_by:
        df = df.orderBy(*order_by)
    tagged = cut(df.withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()), "ids")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: bounded by the partition count, never by the data
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    pos = F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(_checked(offsets), "_pid")
            .withColumn(name, (F.col("_off") + pos).cast("long"))
            .drop("_pid", "_mono", "_off"))


def file_order_ids(df: DataFrame, name: str = "point_id") -> DataFrame:
    """Dense 0-based ids in the order of (``_file``, ``_start``), the file and the first byte of
    the split that a row came from, then of rows inside the split.

    Rows of a split are consecutive in their partition, so a row's place in its split is its
    running number less the split's smallest. The offsets have one row per split.
    """
    tagged = df.withColumn("_mono", F.monotonically_increasing_id()).withColumn("_split", F.xxhash64("_file", "_start"))
    splits = cut(tagged.groupBy("_split", "_file", "_start").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mono").alias("_first")), "splits")
    w = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_split", (F.coalesce(F.sum("_cnt").over(w), F.lit(0)) - F.col("_first")).alias("_off"))
    return (tagged.join(_checked(offsets), "_split")
            .withColumn(name, (F.col("_off") + F.col("_mono")).cast("long")).drop("_mono", "_split", "_off", "_file", "_start"))


def shard_count_for(n: int, requested: int | None = None, max_shard_points: int = MAX_SHARD_POINTS,
                    dim: int = 1, max_shard_bytes: int = MAX_SHARD_BYTES) -> int:
    """At least ``requested`` shards, and enough that no shard exceeds
    ``max_shard_points`` points or ``max_shard_bytes`` of coordinates."""
    need = max(1, math.ceil(n / max_shard_points), math.ceil(n * max(dim, 1) * 8 / max_shard_bytes))
    return max(need, requested or 1)


def shard_expr(point_id: str | Column, shards: int, method: str = "hash") -> Column:
    pid = F.col(point_id) if isinstance(point_id, str) else point_id
    if method == "mod":  # reproducible in any SQL engine; balanced for dense ids
        return F.pmod(pid, F.lit(shards)).cast("int")
    return F.pmod(F.xxhash64(pid), F.lit(shards)).cast("int")


def aligned_shard_keys(spark: SparkSession, shards: int) -> DataFrame:
    """``(shard_index, shard)``: for each partition p of a hash repartition into
    ``shards`` partitions, the smallest int whose Spark partition hash lands on p.

    Hash partitioning of S small ints into S partitions collides (some partitions
    get two or three shards, others none, so the slowest task runs 2-3x longer).
    Keys taken from this table map one-to-one onto partitions. Built with Spark's
    own hash; one row per shard, so it is broadcast.
    """
    span = 32
    while True:
        cand = spark.range(0, shards * span).select(F.col("id").cast("int").alias("v"))
        cand = cand.withColumn("shard_index", F.pmod(F.hash(F.col("v")), F.lit(shards)))
        keys = cand.groupBy("shard_index").agg(F.min("v").alias("shard"))
        if keys.count() == shards:
            return keys.select(F.col("shard_index").cast("int"), F.col("shard").cast("int"))
        span *= 4


def assign_shards(points: DataFrame, shards: int, method: str = "hash") -> DataFrame:
    """Explicit ``shard`` column (SRC-6): a hash of the id, so no key can overload one shard.

    ``method='aligned'`` maps the hashed index onto partition-aligned keys, so that
    ``repartition(shards, 'shard')`` puts exactly one shard in each partition.
    """
    if method != "aligned":
        return points.withColumn("shard", shard_expr("point_id", shards, method))
    keys = aligned_shard_keys(points.sparkSession, shards)
    idx = points.withColumn("shard_index", shard_expr("point_id", shards, "hash"))
    return idx.join(_checked(keys), "shard_index").drop("shard_index")


#: Hash buckets per shard from which bounded shards are put together.
FINE = 64


def assign_bounded_shards(points: DataFrame, shards: int, limit: int) -> tuple[DataFrame, int]:
    """(points with ``shard``, number of shards): no shard above ``limit`` points, whatever the
    hashes (SRC-6). At least ``shards`` of them where one hash bucket each would do.

    If ``shards`` hash buckets keep the limit they are the shards. Otherwise ids fall into
    ``FINE`` times as many hash buckets, and runs of neighbouring buckets make a shard: bucket b
    of a group belongs to shard floor(points before b / (limit - largest bucket)), so a shard
    ends at most one bucket above that quotient's bound. Equal ids still share a shard, and the
    result does not depend on partitions. Aggregates have one row a bucket; the running sums
    are taken inside groups of buckets, never over all of them.
    """
    limit = max(1, limit)
    if _largest(points, shards) <= limit:
        return assign_shards(points, shards, method="aligned"), shards
    fine = shards * FINE
    while (top := _largest(points, fine)) * 4 > limit:
        if points.groupBy("point_id").count().agg(F.max("count")).first()[0] > max(1, limit // 4):
            raise ValueError(f"one point_id has more than a quarter of the {limit} points of a shard: ids must be unique")
        if top <= 1:
            raise ValueError(f"a shard of at most {limit} points cannot be put together from hash buckets")
        fine *= 4
    bucket = points.withColumn("_b", F.pmod(F.xxhash64("point_id"), F.lit(fine)))
    count = bucket.groupBy("_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_g", F.floor(F.col("_b") / (FINE * FINE)))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    own = cut(count.withColumn("_s", F.floor(F.coalesce(F.sum("_c").over(before), F.lit(0)) / (limit - top))), "shard-buckets")
    groups = own.groupBy("_g").agg((F.max("_s") + 1).alias("_k"))
    first = groups.select("_g", F.coalesce(F.sum("_k").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    total = int(groups.agg(F.sum("_k")).first()[0])
    keys = own.join(_checked(first), "_g").select("_b", (F.col("_o") + F.col("_s")).cast("int").alias("shard_index"))
    keys = keys.join(_checked(aligned_shard_keys(points.sparkSession, total)), "shard_index").select("_b", "shard")
    return bucket.join(_checked(keys), "_b").drop("_b"), total


def _largest(points: DataFrame, buckets: int) -> int:
    """Points of the largest hash bucket."""
    return points.groupBy(F.pmod(F.xxhash64("point_id"), F.lit(buckets)).alias("b")).count().agg(F.max("count")).first()[0] or 0


def standardize(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[Column]]:
    """(df, columns) with each numeric column centred and scaled to unit variance.

    The means and deviations are one aggregate row (2 numbers per column).
    """
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.stddev_samp(F.col(c).cast("double")).alias(f"s_{c}")]
    st = df.agg(*aggs).first()
    out = []
    for c in cols:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        s = s if s and s > 0 else 1.0
        out.append((F.col(c).cast("double") - F.lit(m)) / F.lit(s))
    return df, out


def points_from_table(df: DataFrame, *, id_col: str | None = None, vector_col: str | None = None,
                      cols: list[str] | None = None, label_col: str | None = None,
                      scale: bool = False, ids: str = "dense") -> DataFrame:
    """``points(point_id, x, label)`` from a table (SRC-2, PRJ-3).

    Either ``vector_col`` (any numeric array) or ``cols`` (numeric columns, optionally
    standardised). Without ``id_col`` ids are generated in file order: ``dense``
    (0..n-1, one extra pass) or ``unique`` (``monotonically_increasing_id``: no extra
    pass and no cache; what the fit needs, since it freezes them when it writes
    the points table).
    """
    if ids not in ("dense", "unique"):
        raise ValueError("ids must be 'dense' or 'unique'")
    if (vector_col is None) == (cols is None):
        raise ValueError("give exactly one of vector_col / cols")
    if vector_col is not None:
        x = F.col(vector_col).cast("array<double>")
    else:
        if scale:
            df, exprs = standardize(df, cols)
        else:
            exprs = [F.col(c).cast("double") for c in cols]
        x = F.array(*exprs)
    label = F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")
    if id_col is not None:
        return df.select(F.col(id_col).cast("long").alias("point_id"), x.alias("x"), label.alias("label"))
    sel = df.select(x.alias("x"), label.alias("label"))
    if ids == "unique":
        return sel.select(F.monotonically_increasing_id().alias("point_id"), "x", "label")
    return dense_ids(sel).select("point_id", "x", "label")


def read_text_points(spark: SparkSession, path: str, dim: int, with_label: bool,
                     on_error: str = "fail", counts: Observation | None = None) -> DataFrame:
    """Text file(s) -> ``points(point_id, x, label)`` with ids in file order (SRC-1, SRC-4):
    files by name, lines by place, however Spark packs files and splits into partitions.
    ``counts`` reports dropped lines as in ``parse_points``."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    return file_order_ids(parse_points(lines, dim, with_label, on_error=on_error, counts=counts)).select("point_id", "x", "label")
