"""Batch sweeps of the global merge with the superclusters resident on the driver (CLU-6).

One Spark job a sweep. The individuals lie in a written table with the supercluster each had
when the table was written; every sweep since then is a function of that sweep's
superclusters, which the tasks hold as broadcasts, so a task replays those few sweeps, makes
its own and returns one partial sum per supercluster it sees. The sums meet on the driver, at
most one row an individual and therefore within the byte bound that admits this form; the
posterior is refreshed there and goes out with the next sweep. Every ``WINDOW`` sweeps the
assignment is written again, so a task never replays more than that, and a lost executor
costs at most that much.

Sums travel and meet in extended precision (value and remainder): the refreshed means do not
depend on how the individuals are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixshard.functions.draws import concentration_of, keyed_uniforms_of, normal_of, rng_for
from mixshard.functions.matrix import centred, sq_distances
from mixshard.params import DPMParams
from mixshard.session import cut

#: Largest estimated bytes of all individuals' sums and centres for this form.
RESIDENT_BYTES = 64 * 1024 * 1024
#: Sweeps replayed by a task at most before the assignment is written anew.
WINDOW = 8
#: Products of a sweep (individuals x superclusters x coordinates) that one task takes.
TASK_PRODUCTS = 50_000_000
#: Bytes of scores held at once.
SCORE_BYTES = 32 << 20


def resident_bytes(individuals: int, dim: int) -> int:
    """Estimated bytes on the driver: sums with remainders, centres and priors of every individual."""
    return individuals * (4 * dim + 8) * 8


@dataclass
class Superclusters:
    """Superclusters at the start of a sweep, ids ascending."""

    ids: np.ndarray
    members: np.ndarray
    size: np.ndarray
    y_mean: np.ndarray
    phi: np.ndarray
    post_mean: np.ndarray
    post_var: np.ndarray

    def sent(self) -> tuple:
        return self.ids, self.members, self.size, self.phi


def sweep_moves(ind_id, size, y, phi, c, supers: tuple, E: float, gamma: float, up: bool, sample: tuple | None, fresh) -> np.ndarray:
    """The supercluster of every individual after one batch sweep (``batch_moves`` over arrays)."""
    ids, members, sizes, centres = supers
    with np.errstate(divide="ignore", invalid="ignore"):
        logw = np.log(sizes)
        at = np.searchsorted(ids, c)
        held, alone = members[at], logw[at]
        own = np.log(sizes[at] - size)
        gap = ((phi - y) ** 2).sum(axis=1)
        own_new = (math.log(gamma) if gamma > 0 else -math.inf) - gap / (2.0 * E)
    if sample:
        noise = np.array([keyed_uniforms_of(*sample, -1, int(i))[0] for i in ind_id])
        own_new = own_new - np.log(-np.log(noise))
    c0, p, pn = centred(centres)
    out = np.empty(len(c), np.int64)
    step = max(1, SCORE_BYTES // (8 * max(1, len(ids))))
    for lo in range(0, len(c), step):
        q = slice(lo, lo + step)
        d2, _ = sq_distances(y[q], c0, p, pn)
        w = np.broadcast_to(logw, d2.shape).copy()
        single = held[q] == 1
        a = alone[q][:, None]
        larger = (logw[None, :] > a) | ((logw[None, :] == a) & (ids[None, :] < c[q, None]))
        w[~larger if up else larger | single[:, None]] = -np.inf
        w[np.arange(len(at[q])), at[q]] = np.where(single, -np.inf, own[q])
        s = w - d2 / (2.0 * E)
        if sample:
            for r, i in enumerate(ind_id[q]):
                s[r] += rng_for(*sample, 0, int(i)).gumbel(size=s.shape[1])
        k = s.argmax(axis=1)
        top = s[np.arange(len(k)), k]
        new = (own_new[q] > top) | (top == -np.inf)
        out[q] = np.where(new, np.where(single, c[q], fresh[q]), ids[k])
    return out


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Extended sums as doubles and what those leave."""
    high = x.astype(np.float64)
    return high, (x - high).astype(np.float64)


def _grouped(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(distinct keys ascending, sums of each value per key)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    return k[first], [np.add.reduceat(v[order], first, axis=0) if len(k) else v[order] for v in values]


_STATE = ["ind_id", "size", "y_mean", "phi", "c"]
_PARTIAL = "sc_id long, members long, moved long, size double, size_rest double, total array<double>, rest array<double>"


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


class _Replay:
    """What a task does with its rows: the sweeps since the table was written."""

    def __init__(self, steps: list[tuple], E: float, span: int):
        self.steps, self.E, self.span = steps, E, span  # (broadcast, gamma, number, sample)

    def __call__(self, b: pa.RecordBatch):
        col = lambda n: b.column(b.schema.get_field_index(n))
        matrix = lambda n: col(n).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        ind, size, c = (col(n).to_numpy(zero_copy_only=False) for n in ("ind_id", "size", "c"))
        y, phi = matrix("y_mean"), matrix("phi")
        was = c
        for data, gamma, t, sample in self.steps:
            was, c = c, sweep_moves(ind, size, y, phi, c, data.value, self.E, gamma, t % 2 == 0, sample, ind + self.span * (t + 1))
        return ind, size, y, phi, c, was

    def partial(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = [], []
        for b in batches:
            if b.num_rows:
                _, size, y, _, c, was = self(b)
                w = size.astype(np.longdouble)
                k, v = _grouped(c, np.ones(len(c), np.int64), (c != was).astype(np.int64), w, y * w[:, None])
                keys.append(k)
                sums.append(v)
        if keys:
            k, (n, moved, size, total) = _grouped(np.concatenate(keys), *(np.concatenate(x) for x in zip(*sums)))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n), pa.array(moved), *map(pa.array, _split(size)), *map(_lists, _split(total))],
                                             names=[f.split()[0] for f in _PARTIAL.split(", ")])

    def state(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = self(b)[4]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(c)], names=_STATE)


class ResidentMerge:
    """The sweeps of one merge. ``base``: (ind_id, size, y_mean, phi, prior_mean, prior_var)."""

    def __init__(self, base: DataFrame, n: int, dim: int, span: int, p: DPMParams, round_: int):
        self.spark, self.sc, self.p, self.round, self.dim, self.span = base.sparkSession, base.sparkSession.sparkContext, p, round_, dim, span
        priors = base.select("ind_id", "prior_mean", "prior_var").toArrow().combine_chunks()  # within RESIDENT_BYTES
        who = priors.column("ind_id").to_numpy()
        order = np.argsort(who)
        mean = np.asarray(priors.column("prior_mean").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(n, dim)
        self.who, self.prior_mean, self.prior_var = who[order], mean[order], priors.column("prior_var").to_numpy()[order]
        parts = int(min(n, -(-n * n * dim // TASK_PRODUCTS)))
        first = base.select("ind_id", "size", "y_mean", "phi", F.col("ind_id").alias("c"))
        self.table = cut(first.repartition(max(1, parts)), "merge-state")
        self.steps: list[tuple] = []

    def _replay(self) -> _Replay:
        return _Replay(self.steps, self.p.E, self.span)

    def refresh(self, draw: tuple) -> tuple[Superclusters, int]:
        """(superclusters of the present assignment with centres drawn by ``draw``, moves of the last sweep)."""
        t = self.table.mapInArrow(self._replay().partial, _PARTIAL).toArrow().combine_chunks()
        key = t.column("sc_id").to_numpy()
        wide = lambda a, b, shape: (_numbers(t, a, shape).astype(np.longdouble) + _numbers(t, b, shape))
        ids, (members, moved, size, total) = _grouped(key, t.column("members").to_numpy(), t.column("moved").to_numpy(),
                                                      wide("size", "size_rest", (-1,)), wide("total", "rest", (-1, self.dim)))
        y = (total / size[:, None]).astype(np.float64)
        size = size.astype(np.float64)
        at = np.minimum(np.searchsorted(self.who, ids), len(self.who) - 1)
        old = self.who[at] == ids  # a supercluster that an individual opened has the model's own prior
        m0 = np.where(old[:, None], self.prior_mean[at], 0.0)
        v0 = np.where(old, self.prior_var[at], float(self.p.S))
        var = 1.0 / (size / self.p.E + 1.0 / v0)
        mean = var[:, None] * (size[:, None] / self.p.E * y + m0 / v0[:, None])
        z = np.array([[normal_of(*draw, int(k), i) for i in range(self.dim)] for k in ids]).reshape(len(ids), self.dim)
        return Superclusters(ids, members, size, y, mean + np.sqrt(var)[:, None] * z, mean, var), int(moved.sum())

    def add(self, supers: Superclusters, gamma: float, t: int, sample: tuple | None) -> None:
        """Sweep ``t`` from ``supers``; the assignment is written every WINDOW sweeps."""
        if len(self.steps) >= WINDOW:
            self.write()
        self.steps.append((self.sc.broadcast(supers.sent()), gamma, t, sample))

    def write(self) -> DataFrame:
        """The table with the present assignment."""
        self.table = cut(self.table.mapInArrow(self._replay().state, self.table.schema), "merge-state", after=self.table)
        for data, *_ in self.steps:
            data.destroy()
        self.steps = []
        return self.table


def _numbers(t: pa.Table, name: str, shape: tuple) -> np.ndarray:
    col = t.column(name).combine_chunks()
    if pa.types.is_list(col.type):
        col = col.flatten()
    return col.to_numpy(zero_copy_only=False).reshape(shape)


def merge_resident(base: DataFrame, n: int, dim: int, span: int, p: DPMParams, gamma: float, n_total: int, round_: int
                   ) -> tuple[DataFrame, DataFrame, float]:
    """(model, ind_to_cluster, gamma) as ``global_merge`` gives them."""
    run = ResidentMerge(base, n, dim, span, p, round_)
    supers, _ = run.refresh((p.seed, 31, round_, -1))
    quiet = 0
    for t in range(p.global_sweeps):
        sample = (p.seed, 33, round_, t) if p.assign == "sample" else None
        run.add(supers, gamma, t, sample)
        supers, moved = run.refresh((p.seed, 31, round_, t))
        gamma = concentration_of(gamma, len(supers.ids), n_total, p.conc_a, p.conc_b, p.concentration, p.seed, 32, round_, t)
        quiet = quiet + 1 if p.quiet_sweeps and not sample and not moved else 0
        if p.quiet_sweeps and quiet >= p.quiet_sweeps:
            break
    rows = pa.table({"cluster_id": pa.array(np.arange(len(supers.ids)), pa.int32()), "sc_id": pa.array(supers.ids), "size": supers.size, "y_mean": _lists(supers.y_mean),
                     "phi": _lists(supers.phi), "prior_mean": _lists(supers.post_mean), "prior_var": supers.post_var})
    model = cut(run.spark.createDataFrame(rows), "merge-model")  # a row a supercluster, within the bound
    mem = run.write().select("ind_id", F.col("c").alias("sc_id")).join(F.broadcast(model.select("sc_id", "cluster_id")), "sc_id")
    return model.drop("sc_id"), mem.select(F.col("ind_id").cast("int").alias("ind_id"), "cluster_id"), gamma
