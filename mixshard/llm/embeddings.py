"""Embedding near-dedup by spherical k-means cells (operator 6).

Equal vectors of a label are one class with a multiplicity. Spherical k-means, fitted on
a bounded sample, puts every class into its nearest cells (``probes_for``); inside a cell the
classes of one label are compared by blocked cosine products. A pair that meets in
several cells counts in the first one only. Blocks return link counts and the smallest
connected class of each vector, never pairs; components finish the groups and the
smallest id of each is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixshard.llm.graph import components, own_key
from mixshard.session import cut, prepare_session

COSINE = 0.93
#: Rows a cell is meant to hold, cells at most (they are broadcast: 8 bytes a component),
#: rows of one block.
CELL_ROWS, MOST_CELLS, BLOCK = 4096, 16384, 1024
#: (most cells, cells a vector is put in). Two vectors at the threshold share a nearest cell
#: the less often the more cells there are; measured recall is in the README.
PROBES = [(1, 1), (5, 3), (20, 4), (200, 6), (2000, 8), (MOST_CELLS, 11)]
#: Vectors that k-means is fitted on, at most (documented bound of the fit).
SAMPLE, ROUNDS, SEED = 65536, 8, 7
#: Bytes of scores (vectors x cells) held at once, in the fit and in a task.
SCORE_BYTES = 32 << 20


def fit_cells(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centres of spherical k-means; ``x`` has unit rows."""
    rng = np.random.default_rng(SEED)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS if k > 1 else 0):
        near = np.concatenate([(x[q] @ centres.T).argmax(axis=1) for q in _rows_at_once(len(x), k)])
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        empty = size < 1e-12
        total[empty], size[empty] = x[rng.choice(len(x), int(empty.sum()))], 1.0
        centres = total / np.maximum(size, 1e-12)[:, None]
    return centres


def probes_for(k: int) -> int:
    """Cells a vector is put in when there are ``k``."""
    return next((p for most, p in PROBES if k <= most), PROBES[-1][1])


def nearest(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest cells of each row, ascending by cell number."""
    p = min(probes, len(centres))
    if p == len(centres) or not len(x):
        return np.tile(np.arange(len(centres)), (len(x), 1))[:, :p]
    return np.concatenate([np.sort(np.argpartition(-(x[q] @ centres.T), p - 1, axis=1)[:, :p], axis=1) for q in _rows_at_once(len(x), len(centres))])


def _rows_at_once(n: int, k: int) -> list[slice]:
    """Blocks of rows whose scores against ``k`` centres stay within SCORE_BYTES."""
    step = max(1, SCORE_BYTES // (8 * max(1, k)))
    return [slice(lo, lo + step) for lo in range(0, n, step)]


def block_links(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, cell: int, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of two blocks at the threshold whose first common cell is ``cell``."""
    i, j = np.nonzero(x @ y.T >= threshold)
    if same:
        up = i < j
        i, j = i[up], j[up]
    earlier = np.zeros(len(i), bool)
    for a in range(cx.shape[1]):
        for b in range(cy.shape[1]):
            earlier |= (cx[i, a] == cy[j, b]) & (cx[i, a] < cell) & (cx[i, a] >= 0)
    return i[~earlier], j[~earlier]


def heads(n: int, i: np.ndarray, j: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Smallest ``rank`` connected with each of n nodes."""
    low = rank.copy()
    while len(i):
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        if (low == before).all():
            break
    return low


def _units(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, norms) of a list column with equal lengths."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(rows), -1)
    # scaled first, so that very small and very large vectors keep their direction
    top = np.abs(m).max(axis=1, keepdims=True) if m.size else np.ones((len(rows), 1))
    m = m / top
    return m / np.linalg.norm(m, axis=1, keepdims=True), top


def near_dedup(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
               threshold: float = COSINE, probes: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept): one row per input row.

    Two rows link when their labels are equal and not null and their cosine in double
    precision reaches ``threshold``. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable, ``kept`` marks the row that stays.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
    and rows without a label or an id, link with nothing (component: their own id; kept
    unless the id is null); vectors of different lengths do not link; repeated rows link
    with each other; other columns are not read; an empty table gives an empty result.
    A pair is missed when its vectors share none of their ``probes`` nearest cells (by default
    as many as ``probes_for`` gives for the number of cells).
    """
    prepare_session(spark)
    v = F.transform(F.col("vec"), lambda e: e.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec")).withColumn("vec", v)
    finite = F.forall("vec", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    sound = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda e: e != 0), F.lit(False))
    classes = cut(rows.where(sound).groupBy("label", "vec").agg(F.min("id").alias("class"), F.count("*").alias("copies")).withColumn("dim", F.size("vec")), "vectors")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row per vector length
    found = None
    for dim, n in sorted(sizes.items()):
        part = _links_of(spark, classes.where(F.col("dim") == dim), dim, n, threshold, probes, cell_rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        known = classes.select("label", "vec", F.col("class").alias("component_id"), F.lit(0).cast("long").alias("n"))
    else:
        found = cut(found, "vector-links")
        near = found.groupBy("class").agg(F.sum("links").alias("links"))
        comps = components(found.where("head != class").select("class", "head").distinct(), "class", "head")
        known = (classes.join(near, "class", "left").join(comps.withColumnRenamed("node", "class"), "class", "left")
                 .select("label", "vec", F.coalesce("component", "class").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n")))
    out = rows.where(sound).join(known, ["label", "vec"]).select("id", F.col("n").alias("n_links"), "component_id")
    alone = rows.where(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def _links_of(spark: SparkSession, classes: DataFrame, dim: int, n: int, threshold: float, probes: int | None, cell_rows: int) -> DataFrame:
    """(class, links, head) of the classes of one vector length, several rows a class."""
    k = max(1, min(MOST_CELLS, -(-n // cell_rows), (256 << 20) // (8 * dim)))
    if k > 1:
        draw = F.pmod(F.xxhash64("class", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        some = classes.where(draw < min(1.0, SAMPLE / n)).select("class", "vec").limit(2 * SAMPLE).toArrow().sort_by("class")
        unit, _ = _units(some.column("vec").combine_chunks())
        centres = fit_cells(unit, k)
    else:
        centres = np.eye(1, dim)
    probes = probes or probes_for(len(centres))
    data = spark.sparkContext.broadcast(centres)  # at most 256 MB by the bound above, in practice a few

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            unit, _ = _units(b.column(1))
            cells = nearest(unit, data.value, probes)
            p = cells.shape[1]
            at = np.repeat(np.arange(len(cells)), p)
            lists = lambda m, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel(), kind))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(2).take(pa.array(at)), b.column(3).take(pa.array(at)), pa.array(cells.ravel(), pa.int64()),
                                              lists(cells[at], pa.int32()), lists(unit[at], pa.float64())], names=["class", "label", "copies", "cell", "cells", "unit"])

    rows = classes.select("class", "vec", "label", "copies").mapInArrow(assign, "class long, label string, copies long, cell long, cells array<int>, unit array<double>")
    rows = cut(rows.withColumn("grp", F.xxhash64("label", "cell")), "vector-cells")
    blocks = own_key(rows.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("blocks")), "grp")
    rows = rows.join(blocks, "grp").withColumn("own", F.pmod(F.xxhash64("class", F.lit(3)), F.col("blocks")))
    rows = (rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .withColumn("task", F.xxhash64("label", "cell", F.least("own", "other"), F.greatest("own", "other"))).withColumn("second", F.col("own") > F.col("other")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        task = None
        for b in batches:
            t = b.column(0).to_numpy()
            cut = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            for lo, hi in zip(cut, np.append(cut[1:], len(t))):
                if held and t[lo] != task:
                    yield block(held)
                    held = []
                task = t[lo]
                held.append(b.slice(int(lo), int(hi - lo)))
        if held:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        col = lambda c: t.column(c).combine_chunks()
        who, cell = col("class").to_numpy(), int(t.column("cell")[0].as_py())
        copies, second = col("copies").to_numpy(), col("second").to_numpy(zero_copy_only=False)
        label = np.array(t.column("label").to_pylist(), object)
        unit = col("unit").flatten().to_numpy().reshape(len(who), -1)
        cells = col("cells").flatten().to_numpy().reshape(len(who), -1)
        links, low = np.zeros(len(who), np.int64), who.copy()
        for name in dict.fromkeys(label.tolist()):  # one, unless hashes collide
            a, b = np.flatnonzero((label == name) & ~second), np.flatnonzero((label == name) & second)
            pairs = []
            for x, y in ([(a, b)] if len(b) else [(a, a)]):
                for i in range(0, len(x), 512):
                    for j in range(0, len(y), 512):
                        if x is y and j < i:
                            continue
                        p, q = x[i: i + 512], y[j: j + 512]
                        u, w = block_links(unit[p], unit[q], cells[p], cells[q], cell, x is y and i == j, threshold)
                        np.add.at(links, p[u], copies[q[w]])
                        np.add.at(links, q[w], copies[p[u]])
                        low_ = heads(len(p) + len(q), u, w + len(p), np.concatenate([low[p], low[q]]))
                        low[p] = np.minimum(low[p], low_[: len(p)])
                        low[q] = np.minimum(low[q], low_[len(p):])
                        pairs.append((p[u], q[w]))
            if pairs:  # the smallest class over all pieces of the block
                low = heads(len(who), np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs]), low)
        seen = links > 0
        return pa.RecordBatch.from_arrays([pa.array(who[seen]), pa.array(links[seen]), pa.array(low[seen])], names=["class", "links", "head"])

    cols = ["task", "class", "label", "copies", "cell", "cells", "unit", "second"]
    return rows.select(*cols).repartition("task").sortWithinPartitions("task").mapInArrow(compare, "class long, links long, head long")


def q_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``embeddings``."""
    return near_dedup(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


SQL_EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.93),
reach(node, low) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.low FROM reach r JOIN links e ON e.a = r.node WHERE r.low < e.b)
SELECT c.node AS vec_id, coalesce(n.n, 0) AS n_links, c.low AS component_id, c.low = c.node AS kept
FROM (SELECT node, min(low) AS low FROM reach GROUP BY node) c LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = c.node
"""
