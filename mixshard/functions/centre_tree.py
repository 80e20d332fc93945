"""Exact search over many centres of few dimensions.

Distinct centres are halved along their widest coordinate until a leaf holds few of them; every
node keeps the box around its centres and their largest weight. A point's score in a node is at
most that weight less its distance to the box, so whole branches that cannot reach what the point
already has are left out: the work for a point grows with the depth of the tree, not with the
number of centres or cells. All points of a batch go down the tree together, a level at a time.
Leaves are scored by direct differences, so labels, ties and scores are those of the full product.
"""

from __future__ import annotations

import numpy as np

from mixshard.functions.centre_index import SCORE_BYTES, _up
from mixshard.functions.matrix import centred

#: Models of at most so many dimensions are searched through a tree; boxes bound little in more.
TREE_DIMS = 6
#: Centres of a leaf, at most.
LEAF = 16
#: (point, node) pairs followed at once.
PAIRS = 1 << 20
#: Points that go down the tree together.
TOGETHER = 8192


def _signed(ids: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the signs of centres around their mean that occur, lowest id of each)."""
    signs = np.sign(centred(phi)[1]).astype(np.int8)
    at = np.unique((signs.astype(np.int64) + 1) @ 3 ** np.arange(phi.shape[1]), return_index=True)[1]
    return signs[at], ids[at]


class CentreTree:
    """A tree over the centres of one block of a model: finite ``phi`` of at most ``TREE_DIMS``
    dimensions, ``logw`` below infinity; ``ids`` ascend."""

    def __init__(self, ids: np.ndarray, phi: np.ndarray, logw: np.ndarray):
        self.lowest = (ids[:1], phi[:1], logw[:1])  # for points that no centre scores above -inf
        self.signs = _signed(ids, phi)
        self.largest = float(np.abs(phi).max()) if phi.size else 0.0
        live = np.flatnonzero(logw > -np.inf)
        by = live[np.lexsort((ids[live], logw[live], *phi[live].T))]
        p, w = phi[by], logw[by]
        new = np.append(True, (p[1:] != p[:-1]).any(axis=1) | (w[1:] != w[:-1])) if len(by) else np.zeros(0, bool)
        by = by[new]  # of equal centres the lowest id stands for all
        k, order, first = len(by), np.arange(len(by)), np.zeros(1, np.int64)
        p = phi[by]
        while k > LEAF * len(first):
            end = np.append(first[1:], k)
            node = np.repeat(np.arange(len(first)), end - first)
            q = p[order]
            wide = (np.maximum.reduceat(q, first) - np.minimum.reduceat(q, first)).argmax(axis=1)
            order = order[np.lexsort((q[np.arange(k), wide[node]], node))]
            first = np.column_stack([first, (first + end) // 2]).ravel()
        self.first, self.end = first, np.append(first[1:], k)
        self.ids, self.phi, self.logw = ids[by][order], p[order], logw[by][order]
        self.levels = []  # from the root to the leaves: lower and upper corner, largest weight
        if k:
            low, high, top = np.minimum.reduceat(self.phi, first), np.maximum.reduceat(self.phi, first), np.maximum.reduceat(self.logw, first)
            self.levels.append((low, high, top))
            while len(top) > 1:
                low, high, top = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), np.maximum(top[::2], top[1::2])
                self.levels.insert(0, (low, high, top))

    def best(self, x: np.ndarray, E: float, score: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(best score, its id, its squared distance, products computed) of each point, the lowest
        id on a tie. ``score`` as for ``CentreIndex.best``."""
        n = len(x)
        bs, bid, bd, done = np.full(n, -np.inf), np.full(n, -1, np.int64), np.full(n, np.nan), 0
        with np.errstate(all="ignore"):
            size = np.abs(x).max(axis=1) + self.largest
            plain = size * size * x.shape[1] * (1.0 + 0.5 / E) < 1e300
        if not self.levels:
            plain[:] = False
        rows = np.flatnonzero(plain)
        for lo in range(0, len(rows), TOGETHER):
            r = rows[lo: lo + TOGETHER]
            floor = np.full(len(r), -np.inf) if score is None else score[r]
            bs[r], bid[r], bd[r], some = self._search(np.ascontiguousarray(x[r].T), E, np.where(np.isnan(floor), np.inf, floor))
            done += some
        rest = np.flatnonzero(~plain)
        if len(rest):
            bs[rest], bid[rest], bd[rest] = self._odd(x[rest], E)
        return bs, bid, bd, done

    def _odd(self, x: np.ndarray, E: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Points with a missing or infinite coordinate, or too far for a finite score."""
        ids, phi, logw = self.lowest
        with np.errstate(all="ignore"):
            bd = ((x - phi) ** 2).sum(axis=1)
            bs, bid = logw[0] - bd / (2.0 * E), np.full(len(x), ids[0])
            for i in np.flatnonzero(~np.isnan(x).any(axis=1)):
                far = np.where(np.isinf(x[i]), np.sign(x[i]), 0.0)
                if far.any():  # the product's choice: the first centre that is not straight behind
                    signs, lowest = self.signs
                    ahead = (signs[:, far != 0] * far[far != 0] != -1).any(axis=1)
                    bid[i] = lowest[ahead].min() if ahead.any() else ids[0]
                elif len(self.ids):
                    d2 = ((x[i] - self.phi) ** 2).sum(axis=1)
                    s = self.logw - d2 / (2.0 * E)
                    if s.max() > -np.inf:
                        k = np.flatnonzero(s == s.max())
                        k = k[self.ids[k].argmin()]
                        bs[i], bid[i], bd[i] = s[k], self.ids[k], d2[k]
            return bs, bid, bd

    def _bound(self, level: int, x: list[np.ndarray], at: np.ndarray, node: np.ndarray, E: float) -> np.ndarray:
        """Best score that a point could have in a node, rounding included."""
        low, high, top = self.levels[level]
        d2 = 0.0
        for j, c in enumerate(x):
            v = c[at]
            gap = np.maximum(np.maximum(low[node, j] - v, v - high[node, j]), 0.0)
            d2 = d2 + gap * gap
        return _up(top[node] - d2 / (2.0 * E))

    def _search(self, x: np.ndarray, E: float, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        n, depth = x.shape[1], len(self.levels)
        every, leaf = np.arange(n), np.zeros(n, np.int64)
        for level in range(1, depth):  # the most promising branch, for a floor
            left, right = self._bound(level, x, every, 2 * leaf, E), self._bound(level, x, every, 2 * leaf + 1, E)
            leaf = 2 * leaf + (right > left)
        got = [np.full(n, -np.inf), np.full(n, -1, np.int64), np.full(n, np.nan)]
        done = self._leaves(x, every, leaf, E, got)
        own, start = leaf, np.maximum(floor, got[0])
        todo = [(0, every, np.zeros(n, np.int64))]
        while todo:  # then every branch that can still reach it
            level, at, node = todo.pop()
            if len(at) > PAIRS:
                half = len(at) // 2
                todo += [(level, at[half:], node[half:]), (level, at[:half], node[:half])]
                continue
            keep = self._bound(level, x, at, node, E) >= start[at]
            at, node = at[keep], node[keep]
            if level == depth - 1:
                other = node != own[at]
                done += self._leaves(x, at[other], node[other], E, got)
                start = np.maximum(start, got[0])
            elif len(at):
                todo.append((level + 1, np.repeat(at, 2), np.column_stack([2 * node, 2 * node + 1]).ravel()))
        low = got[0] < floor
        got[0][low], got[1][low], got[2][low] = -np.inf, -1, np.nan
        return *got, done

    def _leaves(self, x: np.ndarray, at: np.ndarray, leaf: np.ndarray, E: float, got: list[np.ndarray]) -> int:
        """Score the centres of each (point, leaf) pair and keep the best in ``got``."""
        done, step = 0, max(1, SCORE_BYTES // (8 * LEAF * 4))
        for lo in range(0, len(at), step):
            a, f = at[lo: lo + step], leaf[lo: lo + step]
            size = self.end[f] - self.first[f]
            done += int(size.sum())
            place = np.arange(LEAF)
            c = self.first[f][:, None] + np.minimum(place[None, :], size[:, None] - 1)  # a short leaf repeats its last
            d2 = 0.0
            for j in range(x.shape[0]):
                t = x[j][a][:, None] - self.phi[c, j]
                d2 = d2 + t * t
            s = self.logw[c] - d2 / (2.0 * E)
            top = s.max(axis=1)
            ids = np.where(s == top[:, None], self.ids[c], np.iinfo(np.int64).max)
            k = ids.argmin(axis=1)
            ids, d = ids[np.arange(len(a)), k], d2[np.arange(len(a)), k]
            # a point may come with several leaves: its best goes last
            by = np.lexsort((-ids, top, a))
            last = by[np.append(a[by][1:] != a[by][:-1], True)]
            p, b, i, d = a[last], top[last], ids[last], d[last]
            better = (b > got[0][p]) | ((b == got[0][p]) & ((i < got[1][p]) | (got[1][p] < 0)))
            p = p[better]
            got[0][p], got[1][p], got[2][p] = b[better], i[better], d[better]
        return done
