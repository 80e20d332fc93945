"""Local sweeps (CLU-4): per shard, sequential Gibbs passes over its points.

A shard is one Spark group (``groupBy('shard')`` / ``cogroup``), one task, and
its size is bounded by how shards are chosen (``shard_count_for``). The model
(K centres) reaches the tasks as a broadcast variable. Inside the task:

* distances to the existing centres are computed per block of points as one
  matrix product (the centres do not move during a sweep);
* the H fresh candidate centres of each point are drawn through their distance
  to the point: for phi = sqrt(S) z, z ~ N(0, I), ``||x - phi||^2`` depends only
  on z's component along x (normal) and the squared norm of the rest
  (chi-square, d-1 degrees of freedom). The full vector is built only when a
  candidate wins; its direction is then drawn uniformly in the complement.
  This is the same distribution as drawing every candidate vector.
* argmax with the lowest id winning ties (reference behaviour), or a draw from
  the posterior when ``assign='sample'``.

Random numbers are hashes of (seed, round, shard, sweep, point, candidate): a retried task
reproduces its rows exactly, and so does another engine that hashes alike.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixshard.functions.draws import PointDraws
from mixshard.functions.frames import conform
from mixshard.params import DPMParams
from mixshard.session import prepare_session

SWEEP_SCHEMA = (
    "kind STRING, shard INT, local_id INT, size DOUBLE, y_mean ARRAY<DOUBLE>, "
    "phi ARRAY<DOUBLE>, alpha DOUBLE, beta_u DOUBLE, n BIGINT, rss DOUBLE, label INT, cnt BIGINT, "
    "point_ids ARRAY<BIGINT>, local_ids ARRAY<INT>"
)

BLOCK = 1024
# above this many clusters the per-point scan over existing clusters is one numpy
# argmax (constant cost) instead of a Python loop (cost grows with K)
VECTOR_K = 48
# point labels leave a task as arrays of this many points per row (exploded on the JVM side)
LABEL_CHUNK = 65536
NEG_INF = float("-inf")


def _log(v: float) -> float:
    return math.log(v) if v > 0 else NEG_INF


class _State:
    """Growing cluster table of one shard."""

    def __init__(self, phi: np.ndarray, beta: np.ndarray, n_extra: int = 64, ids: np.ndarray | None = None, total: int | None = None):
        k0, d = phi.shape
        # ids of the model's clusters that are here (all of them unless given) out of ``total``
        self.ids = np.arange(k0) if ids is None else ids
        self.total = k0 if total is None else total
        self.alphas: list[float] = []  # every concentration that weighed a score
        cap = k0 + n_extra
        self.phi = np.zeros((cap, d))
        self.phi[:k0] = phi
        self.beta = np.zeros(cap)
        self.beta[:k0] = beta
        self.size = np.zeros(cap)
        # distances are products of coordinates around the model's mean: far from the origin
        # the plain product would lose the digits that tell clusters apart
        self.c0 = phi.mean(axis=0) if k0 else np.zeros(d)
        self.pn = np.zeros(cap)
        self.pn[:k0] = ((phi - self.c0) ** 2).sum(1)
        self.k = k0

    @property
    def clusters(self) -> int:
        """Clusters of the model and those opened here."""
        return self.total + self.k - len(self.ids)

    def names(self) -> np.ndarray:
        """Cluster id of every row of the table: the model's, then new ones numbered after it."""
        return np.concatenate([self.ids, np.arange(self.total, self.clusters)])

    def grow(self):
        cap = self.phi.shape[0] * 2
        for name in ("phi", "beta", "size", "pn"):
            a = getattr(self, name)
            b = np.zeros((cap,) + a.shape[1:])
            b[: a.shape[0]] = a
            setattr(self, name, b)

    def add(self, phi: np.ndarray, beta: float, size: float) -> int:
        if self.k == self.phi.shape[0]:
            self.grow()
        k = self.k
        self.phi[k] = phi
        self.beta[k] = beta
        self.size[k] = size
        t = phi - self.c0
        self.pn[k] = float(t @ t)
        self.k += 1
        return k


def _dist_block(xb: np.ndarray, st: _State, k: int, E: float) -> np.ndarray:
    """-||x - phi||^2 / (2E) for a block of points against clusters [0, k)."""
    xc = xb - st.c0
    d2 = (xc * xc).sum(1)[:, None] - 2.0 * (xc @ (st.phi[:k] - st.c0).T) + st.pn[:k][None, :]
    return -np.maximum(d2, 0.0) / (2.0 * E)


def _initial_pass(X, xnorm, st: _State, alpha: float, E: float) -> np.ndarray:
    """CLU-3 (sequential form): sizes start at 0 and grow as points are placed in order."""
    n = X.shape[0]
    c = np.empty(n, dtype=np.int64)
    k = st.k
    sizes = st.size[:k].tolist()
    ab = (alpha * st.beta[:k]).tolist()
    logw = [_log(sizes[j] + ab[j]) for j in range(k)]
    log = math.log
    lw = np.asarray(logw, dtype=float)
    for s in range(0, n, BLOCK):
        Lnp = _dist_block(X[s:s + BLOCK], st, k, E)
        m = Lnp.shape[0]
        # weights only grow here, and sizes by no more than m in the block: a point whose best
        # cluster beats every other's largest weight chooses it whenever its turn comes
        low = Lnp + lw
        b0 = low.argmax(1)
        at = np.arange(m)
        high = Lnp + np.log(np.asarray(sizes) + m + np.asarray(ab))
        high[at, b0] = NEG_INF
        certain = low[at, b0] > high.max(1) + CERTAIN_EPS
        c[s:s + m] = b0
        prev = 0
        for r in np.flatnonzero(~certain).tolist() + [m]:
            if r > prev:
                for j, cnt in enumerate(np.bincount(b0[prev:r], minlength=k).tolist()):
                    if cnt:
                        sizes[j] += cnt
                        lw[j] = log(sizes[j] + ab[j])
            if r == m:
                break
            best = int(np.argmax(Lnp[r] + lw))
            c[s + r] = best
            sizes[best] += 1.0
            lw[best] = log(sizes[best] + ab[best])
            prev = r + 1
    st.size[:k] = sizes
    return c


def _new_phi(w: np.ndarray, x: np.ndarray, xn: float, z1: float, chi: float, S: float) -> np.ndarray:
    """The centre drawn through its component along ``x`` and the squared norm of the rest, whose
    direction the normals ``w`` give."""
    d = x.shape[0]
    if xn > 0:
        u = x / math.sqrt(xn)
    else:
        u = np.zeros(d)
        u[0] = 1.0
    if d > 1:
        w = w - (w @ u) * u
        nw = math.sqrt(float(w @ w))
        w = w / nw if nw > 0 else w
        return math.sqrt(S) * (z1 * u + math.sqrt(chi) * w)
    return math.sqrt(S) * z1 * u


def _sweeps(X, xnorm, c, st: _State, alpha: float, beta_u: float, gamma: float, p: DPMParams, draws: PointDraws,
            prune: bool = True) -> tuple[float, float]:
    """``p.local_sweeps`` passes; mutates ``c`` and ``st``. Returns (alpha, beta_u).

    Argmax mode uses the pruned pass (same decisions, same random numbers, far
    less per-point Python); sample mode and ``prune=False`` take every point in turn.
    """
    if prune and p.assign == "argmax":
        return _sweeps_pruned(X, xnorm, c, st, alpha, beta_u, gamma, p, draws)
    return _sweeps_rowwise(X, xnorm, c, st, alpha, beta_u, gamma, p, draws)


# decisions closer than this (in log units) are never taken in bulk
CERTAIN_EPS = 1e-7
# distances of a shard that are kept between its sweeps, at most (64 MB)
KEPT_VALUES = 8 << 20


def _sweeps_pruned(X, xnorm, c, st: _State, alpha: float, beta_u: float, gamma: float, p: DPMParams, draws: PointDraws
                   ) -> tuple[float, float]:
    """Exact sweeps that settle most points in bulk.

    Within a block of m points no cluster size moves by more than m, which bounds
    how far each log-weight ln(size + alpha*beta) can drift during the block. A
    point whose best existing cluster (scored with the block-start weights) beats
    every other cluster and its best fresh candidate by more than those bounds
    makes that same choice whenever its turn comes: such points are applied
    together, in order, between the points that are not certain, which are taken
    one by one. After a new cluster opens, the rest of the block is taken one by
    one. Decisions, random numbers and final state equal the one-by-one pass.
    """
    n, d = X.shape
    H = p.local_candidates
    E, S = p.E, p.S
    sq = math.sqrt(S)
    log = math.log
    kept: dict[int, np.ndarray] = {}  # distances of each block, which stay until a cluster opens
    for t_sweep in range(p.local_sweeps):
        st.alphas.append(alpha)
        k = st.k
        ab = alpha * st.beta  # capacity-sized; entries for new clusters are set on opening
        lw = np.full(st.phi.shape[0], NEG_INF)
        for j in range(k):
            lw[j] = _log(float(st.size[j]) + float(ab[j]))
        for s in range(0, n, BLOCK):
            xb = X[s:s + BLOCK]
            xnb = xnorm[s:s + BLOCK]
            kb = st.k
            m = xb.shape[0]
            Lnp = kept.get(s)
            if Lnp is None or Lnp.shape[1] != kb:
                Lnp = _dist_block(xb, st, kb, E)
                if n * kb <= KEPT_VALUES:
                    kept[s] = Lnp
                else:
                    kept.clear()
            wa = _log(alpha * beta_u / H)
            # bounds on each weight's drift during this block
            sz0 = st.size[:kb]
            a0 = ab[:kb]
            lw0 = lw[:kb].copy()
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.log(sz0 + m + a0) - lw0
                dn = lw0 - np.log(np.maximum(sz0 - m, 0.0) + a0)
            S0 = Lnp + lw0
            rows = np.arange(m)
            b0 = S0.argmax(1)
            low = S0[rows, b0] - dn[b0]
            if kb > 1:
                U = Lnp + (lw0 + up)
                U[rows, b0] = NEG_INF
                u2 = U.max(1)
            else:
                u2 = np.full(m, NEG_INF)
            c_old = c[s:s + m].copy()
            # a fresh centre scores no more than one right on the point (rounding included), so
            # candidates, whose numbers hang on nothing else, are drawn only where that could win
            z1, chi = np.zeros((m, H)), np.zeros((m, H))
            jc_all, cv_all = np.zeros(m, np.int64), np.full(m, NEG_INF)
            need = np.flatnonzero(~(low > 1e-13 * xnb / (2.0 * E) + wa + CERTAIN_EPS))
            if len(need):
                xq = xnb[need]
                z1[need], chi[need] = z, rest = draws.candidates(t_sweep, s + need, H, d)
                cand = -(xq[:, None] - 2.0 * sq * np.sqrt(xq)[:, None] * z + S * (z * z + rest)) / (2.0 * E)
                jc_all[need] = jc = cand.argmax(1)
                cv_all[need] = cand[np.arange(len(need)), jc]
            certain = (low > u2 + CERTAIN_EPS) & (low > cv_all + wa + CERTAIN_EPS)
            moves = certain & (b0 != c_old)
            stops = np.flatnonzero(~certain).tolist() + [m]
            moved = [0, *np.cumsum(moves).tolist()]  # bulk moves before each point
            prev = 0
            opened: list[tuple[int, np.ndarray]] = []
            for t in stops:
                if moved[t] > moved[prev]:
                    mv = np.flatnonzero(moves[prev:t]) + prev
                    old = c_old[mv]
                    new = b0[mv]
                    np.subtract.at(st.size, old, 1.0)
                    np.add.at(st.size, new, 1.0)
                    for j in set(old.tolist()) | set(new.tolist()):
                        lw[j] = _log(float(st.size[j]) + float(ab[j]))
                    c[s + mv] = new
                if t == m:
                    break
                # point t, on its own
                i = s + t
                ko = int(c[i])
                sz = float(st.size[ko]) - 1.0
                st.size[ko] = sz
                lw[ko] = _log(sz + float(ab[ko]))
                sc = Lnp[t] + lw[:kb]
                best = int(np.argmax(sc))
                bs = float(sc[best])
                for j, col in opened:
                    v = col[t] + lw[j]
                    if v > bs:
                        best, bs = j, v
                jc = int(jc_all[t])
                if float(cv_all[t]) + wa > bs:
                    b, turn = draws.opening(t_sweep, i, gamma, d)
                    phi = _new_phi(turn, xb[t], float(xnb[t]), float(z1[t, jc]), float(chi[t, jc]), S)
                    bnew = b * beta_u
                    cap = st.phi.shape[0]
                    kn = st.add(phi, bnew, 1.0)
                    if st.phi.shape[0] != cap:  # table grew: widen the weight arrays too
                        lw = np.concatenate([lw, np.full(st.phi.shape[0] - cap, NEG_INF)])
                    ab = alpha * st.beta
                    ab[kn] = alpha * bnew
                    beta_u *= 1.0 - b
                    wa = _log(alpha * beta_u / H)
                    lw[kn] = _log(1.0 + alpha * bnew)
                    diff = xb - phi
                    opened.append((kn, -(diff * diff).sum(1) / (2.0 * E)))
                    c[i] = kn
                    # the bulk test knew nothing of this cluster: finish the block one by one
                    moves[:] = False
                    certain[:] = False
                    stops = None
                else:
                    c[i] = best
                    sz = float(st.size[best]) + 1.0
                    st.size[best] = sz
                    lw[best] = log(sz + float(ab[best])) if sz + float(ab[best]) > 0 else NEG_INF
                prev = t + 1
                if stops is None:
                    break
            if prev < m and stops is None:
                # rest of the block one by one (a cluster opened)
                for t in range(prev, m):
                    i = s + t
                    ko = int(c[i])
                    sz = float(st.size[ko]) - 1.0
                    st.size[ko] = sz
                    lw[ko] = _log(sz + float(ab[ko]))
                    sc = Lnp[t] + lw[:kb]
                    best = int(np.argmax(sc))
                    bs = float(sc[best])
                    for j, col in opened:
                        v = col[t] + lw[j]
                        if v > bs:
                            best, bs = j, v
                    jc = int(jc_all[t])
                    if float(cv_all[t]) + wa > bs:
                        b, turn = draws.opening(t_sweep, i, gamma, d)
                        phi = _new_phi(turn, xb[t], float(xnb[t]), float(z1[t, jc]), float(chi[t, jc]), S)
                        bnew = b * beta_u
                        cap = st.phi.shape[0]
                        kn = st.add(phi, bnew, 1.0)
                        if st.phi.shape[0] != cap:
                            lw = np.concatenate([lw, np.full(st.phi.shape[0] - cap, NEG_INF)])
                        ab = alpha * st.beta
                        ab[kn] = alpha * bnew
                        beta_u *= 1.0 - b
                        wa = _log(alpha * beta_u / H)
                        lw[kn] = _log(1.0 + alpha * bnew)
                        diff = xb - phi
                        opened.append((kn, -(diff * diff).sum(1) / (2.0 * E)))
                        c[i] = kn
                    else:
                        c[i] = best
                        sz = float(st.size[best]) + 1.0
                        st.size[best] = sz
                        lw[best] = log(sz + float(ab[best])) if sz + float(ab[best]) > 0 else NEG_INF
        alpha = draws.concentration(t_sweep, alpha, st.clusters, n, p)
    return alpha, beta_u


def _sweeps_rowwise(X, xnorm, c, st: _State, alpha: float, beta_u: float, gamma: float, p: DPMParams, draws: PointDraws
                    ) -> tuple[float, float]:
    """``p.local_sweeps`` passes, one point at a time; mutates ``c`` and ``st``.

    The per-point work is a scan over K + H scores kept as Python floats (numpy
    call overhead dominates at the usual K); distances come per block from one
    matrix product. ``assign='sample'`` adds Gumbel noise, which turns the
    argmax into an exact draw from the posterior probabilities.
    """
    n, d = X.shape
    H = p.local_candidates
    E, S = p.E, p.S
    sq = math.sqrt(S)
    sample = p.assign == "sample"
    log = math.log
    cl = c.tolist()
    for t_sweep in range(p.local_sweeps):
        st.alphas.append(alpha)
        k = st.k
        sizes = st.size[:k].tolist()
        ab = (alpha * st.beta[:k]).tolist()
        logw = [_log(sizes[j] + ab[j]) for j in range(k)]
        for s in range(0, n, BLOCK):
            xb = X[s:s + BLOCK]
            xnb = xnorm[s:s + BLOCK]
            kb = st.k
            vec = kb > VECTOR_K and not sample
            Lnp = _dist_block(xb, st, kb, E)
            L = None if vec else Lnp.tolist()
            m = xb.shape[0]
            z1, chi = draws.candidates(t_sweep, slice(s, s + m), H, d)
            cand = (-(xnb[:, None] - 2.0 * sq * np.sqrt(xnb)[:, None] * z1 + S * (z1 * z1 + chi))
                    / (2.0 * E))
            gum = draws.rng.gumbel(size=(m, kb)).tolist() if sample else None
            if sample:
                cand = cand + draws.rng.gumbel(size=(m, H))
            cand = cand.tolist()
            opened: list[tuple[int, list]] = []  # clusters opened inside this block
            wa = _log(alpha * beta_u / H)
            if vec:
                lw = np.asarray(logw[:kb], dtype=float)
            for r in range(m):
                i = s + r
                ko = cl[i]
                sz = sizes[ko] - 1.0
                sizes[ko] = sz
                logw[ko] = _log(sz + ab[ko])
                if vec and ko < kb:
                    lw[ko] = logw[ko]
                Lr = None if vec else L[r]
                if sample:
                    g = gum[r]
                    best, bs = 0, Lr[0] + logw[0] + g[0]
                    for j in range(1, kb):
                        v = Lr[j] + logw[j] + g[j]
                        if v > bs:
                            best, bs = j, v
                    for j, col in opened:
                        v = col[r] + logw[j] + draws.rng.gumbel()
                        if v > bs:
                            best, bs = j, v
                else:
                    if vec:
                        sc = Lnp[r] + lw
                        best = int(np.argmax(sc))
                        bs = float(sc[best])
                    else:
                        best, bs = 0, Lr[0] + logw[0]
                        for j in range(1, kb):
                            v = Lr[j] + logw[j]
                            if v > bs:
                                best, bs = j, v
                    for j, col in opened:
                        v = col[r] + logw[j]
                        if v > bs:
                            best, bs = j, v
                cr = cand[r]
                jc, cv = 0, cr[0]
                for h in range(1, H):
                    if cr[h] > cv:
                        jc, cv = h, cr[h]
                if cv + wa > bs:  # a fresh cluster wins (existing ones win ties)
                    b, turn = draws.opening(t_sweep, i, gamma, d)
                    phi = _new_phi(turn, xb[r], float(xnb[r]), float(z1[r, jc]), float(chi[r, jc]), S)
                    bnew = b * beta_u
                    kn = st.add(phi, bnew, 1.0)
                    beta_u *= 1.0 - b
                    wa = _log(alpha * beta_u / H)
                    sizes.append(1.0)
                    ab.append(alpha * bnew)
                    logw.append(_log(1.0 + alpha * bnew))
                    diff = xb - phi
                    opened.append((kn, (-(diff * diff).sum(1) / (2.0 * E)).tolist()))
                    cl[i] = kn
                else:
                    cl[i] = best
                    sz = sizes[best] + 1.0
                    sizes[best] = sz
                    logw[best] = log(sz + ab[best]) if sz + ab[best] > 0 else NEG_INF
                    if vec and best < kb:
                        lw[best] = logw[best]
        st.size[: st.k] = sizes
        alpha = draws.concentration(t_sweep, alpha, st.clusters, n, p)
    c[:] = cl
    return alpha, beta_u


def _means(X: np.ndarray, c: np.ndarray):
    order = np.argsort(c, kind="stable")
    cs = c[order]
    ids, starts, counts = np.unique(cs, return_index=True, return_counts=True)
    sums = np.add.reduceat(X[order], starts, axis=0)
    return ids, counts, sums / counts[:, None]


def _quality(X, c, labels, phi_by_id: np.ndarray, E: float):
    diff = X - phi_by_id[c]
    rss = float((diff * diff).sum() / E)
    ok = ~pd.isna(labels)
    cells = []
    if ok.any():
        cl = pd.DataFrame({"c": c[ok], "l": labels[ok].astype(np.int64)})
        g = cl.groupby(["c", "l"]).size()
        cells = [(int(a), int(b), int(v)) for (a, b), v in g.items()]
    return rss, cells


def _rows(kind, shard, **cols) -> dict:
    return {"kind": kind, "shard": shard, **cols}


# points of at most so many dimensions reach the tasks as plain columns: a list column becomes
# one array object a point in pandas, and stacking them costs more than the rest of a score
PLAIN_DIMS = 16


def _plain(points: DataFrame, dim: int) -> DataFrame:
    """(point_id, shard, label) and the coordinates, as columns ``_x0`` .. or, beyond ``PLAIN_DIMS``,
    as ``x``. A point of another dimension raises."""
    if not 0 < dim <= PLAIN_DIMS:
        return points.select("point_id", "shard", "x", "label")
    wrong = F.raise_error(F.lit(f"a point has not the model's {dim} coordinates"))
    x = F.when(F.size("x") == dim, F.col("x")).otherwise(wrong.cast(points.schema["x"].dataType))
    return points.select("point_id", "shard", x.alias("x"), "label").select("point_id", "shard", "label", *[F.col("x")[i].alias(f"_x{i}") for i in range(dim)])


def _coordinates(points: pd.DataFrame) -> np.ndarray:
    if "x" in points.columns:
        return np.stack(points["x"].to_numpy()).astype(float)
    return np.ascontiguousarray(points[[c for c in points.columns if c.startswith("_x")]].to_numpy(float))


def make_sweep_fn(bmodel, p: DPMParams, round_: int, gamma: float, beta_u: float, mode: str,
                  total: int | None = None, alphas: tuple[float, float] | None = None):
    """The grouped function for one shard.

    The model comes as a broadcast, or, where ``bmodel`` is None, as the shard's own part of it
    (``large_sweep``): (ids, phi, beta) out of ``total`` clusters, which holds while the
    concentration stays within ``alphas``; a row ``x`` reports where it did not.

    Without labels (round 0) it places the points in order first (CLU-3), then
    sweeps. With labels it first emits the quality partials of the labels it got
    (residual sum, contingency cells), then sweeps; ``mode='score'`` stops after
    the partials.
    """
    E = p.E

    def run(points: pd.DataFrame, labels: pd.DataFrame | None, own: tuple | None = None) -> pd.DataFrame:
        if len(points) == 0:
            return pd.DataFrame(columns=[f.split()[0] for f in SWEEP_SCHEMA.split(", ")])
        ids, phi0, beta0 = own if own is not None else (None, *bmodel.value)
        points = points.sort_values("point_id", kind="stable")
        shard = int(points["shard"].iat[0])
        pid = points["point_id"].to_numpy(np.int64)
        if len(pid) > 1 and (pid[1:] == pid[:-1]).any():
            # equal ids hash to the same shard, so this check sees every duplicate
            raise ValueError(f"shard {shard}: point_id is not unique; give unique ids or let "
                             "points_from_table number the rows")
        X = _coordinates(points)
        xnorm = (X * X).sum(1)
        lab = points["label"].to_numpy(dtype=object)
        n = len(pid)
        st = _State(phi0, beta0, ids=ids, total=total)
        draws = PointDraws(p.seed, round_, shard, pid)
        out = []
        if labels is None:
            alpha = p.alpha0
            st.alphas.append(alpha)
            c = _initial_pass(X, xnorm, st, alpha, E)
        else:
            if labels["point_id"].duplicated().any():
                raise ValueError(f"shard {shard}: a point has two current clusters")
            lb = labels.set_index("point_id").reindex(pid)
            if lb["cluster_id"].isna().any():
                raise ValueError(f"shard {shard}: points without a current cluster")
            c = lb["cluster_id"].to_numpy(np.int64)
            if ids is not None:
                c = np.searchsorted(ids, c)
            alpha = float(lb["alpha"].iat[0])
            st.size[: st.k] = np.bincount(c, minlength=st.k)[: st.k]
            rss, cells = _quality(X, c, lab, st.phi, E)
            out.append(_rows("s0", shard, rss=rss, n=n))
            out += [_rows("q", shard, local_id=int(st.ids[a]), label=b, cnt=v) for a, b, v in cells]
            if mode == "score":
                return pd.DataFrame(out)
        a2, bu = _sweeps(X, xnorm, c, st, alpha, beta_u, gamma, p, draws)
        if alphas is not None and not (alphas[0] <= min(st.alphas) and max(st.alphas) <= alphas[1]):
            return pd.DataFrame([_rows("x", shard, alpha=min(st.alphas), beta_u=max(st.alphas))])
        used, counts, means = _means(X, c)
        names = st.names()
        for j, cnt, mu in zip(used, counts, means):
            out.append(_rows("c", shard, local_id=int(names[j]), size=float(cnt), y_mean=mu, phi=st.phi[j].copy()))
        out.append(_rows("s", shard, alpha=a2, beta_u=bu, n=n, local_id=int(st.clusters)))
        for j in range(0, n, LABEL_CHUNK):
            out.append(_rows("p", shard, point_ids=pid[j:j + LABEL_CHUNK],
                             local_ids=names[c[j:j + LABEL_CHUNK]].astype(np.int32)))
        return pd.DataFrame(out)

    return run


def point_labels(out: DataFrame) -> DataFrame:
    """``(point_id, shard, local_id)`` from the sweep output's label rows (JVM-side explode)."""
    z = F.explode(F.arrays_zip(F.col("point_ids").alias("point_id"), F.col("local_ids").alias("local_id")))
    return out.where("kind = 'p'").select("shard", z.alias("z")).select(
        F.col("z.point_id").alias("point_id"), "shard", F.col("z.local_id").alias("local_id"))


def run_sweep(points: DataFrame, labels: DataFrame | None, bmodel, p: DPMParams, round_: int,
              gamma: float, beta_u: float, mode: str = "sweep") -> DataFrame:
    """One round of local work over all shards; returns the tagged rows (SWEEP_SCHEMA).

    ``points``: (point_id, shard, x, label); ``labels``: (point_id, shard, cluster_id,
    alpha). When both come partitioned by shard (the fit's bucketed tables) the
    co-group needs no exchange; otherwise Spark shuffles them by shard.
    """
    prepare_session(points.sparkSession)
    fn = make_sweep_fn(bmodel, p, round_, gamma, beta_u, mode)

    def fix(pdf: pd.DataFrame) -> pd.DataFrame:
        return conform(pdf, SWEEP_SCHEMA)

    pts = _plain(points, bmodel.value[0].shape[1])
    if labels is None:
        return pts.groupBy("shard").applyInPandas(lambda pdf: fix(fn(pdf, None)), SWEEP_SCHEMA)
    lab = labels.select("point_id", "shard", "cluster_id", "alpha")
    return (pts.groupBy("shard").cogroup(lab.groupBy("shard"))
            .applyInPandas(lambda a, b: fix(fn(a, b)), SWEEP_SCHEMA))
