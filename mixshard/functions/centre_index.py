"""Exact pruning over many centres.

Centres are grouped into cells around pivots. By the triangle inequality a point at distance
D from a pivot is at least D - r from every centre of a cell of radius r, so the cell's best
possible score is known before any of its products; cells that cannot reach what a point
already has are skipped. What is left goes through the same blocks as without an index, so
labels, ties and scores are those of the full product.
"""

from __future__ import annotations

import numpy as np

from mixshard.functions.draws import rng_for
from mixshard.functions.matrix import best_of_block, centred, sq_distances

#: Models with at least so many centres are indexed.
INDEX_CENTRES = 1024
#: Rounds of refinement of the pivots.
ROUNDS = 4
#: Bytes of distances held at once.
SCORE_BYTES = 32 << 20


def _nearest(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest of ``p``, squared distance) of each row."""
    at, d = np.empty(len(x), np.int64), np.empty(len(x))
    c = centred(p)
    step = max(1, SCORE_BYTES // (8 * len(p)))
    for lo in range(0, len(x), step):
        d2, _ = sq_distances(x[lo: lo + step], *c)
        k = d2.argmin(axis=1)
        at[lo: lo + step], d[lo: lo + step] = k, d2[np.arange(len(k)), k]
    return at, d


def _up(score: np.ndarray) -> np.ndarray:
    """A little above each score, so that rounding never hides a centre."""
    return np.where(np.isfinite(score), score + 1e-9 * (1.0 + np.abs(score)), score)


class CentreIndex:
    """Cells over the (finite) centres of one block of a model; ``ids`` ascend."""

    def __init__(self, ids: np.ndarray, phi: np.ndarray):
        k = len(ids)
        g = max(1, int(np.sqrt(k)))
        pivots = phi[rng_for(k, g).permutation(k)[:g]].copy()
        for _ in range(ROUNDS):
            cell, _ = _nearest(phi, pivots)
            n, total = np.bincount(cell, minlength=g), np.zeros_like(pivots)
            np.add.at(total, cell, phi)
            pivots = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], pivots)
        cell, _ = _nearest(phi, pivots)
        self.order = np.lexsort((np.arange(k), cell))
        self.ids, self.phi = ids[self.order], phi[self.order]
        cells = cell[self.order]
        self.first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        self.end = np.append(self.first[1:], k)
        self.pivots = pivots[cells[self.first]]
        gap = np.sqrt(((self.phi - np.repeat(self.pivots, self.end - self.first, axis=0)) ** 2).sum(axis=1))
        self.radius = np.maximum.reduceat(gap, self.first)

    def _bounds(self, x: np.ndarray, logw: np.ndarray, E: float) -> np.ndarray:
        """Best score that a point could have in each cell (``logw`` in cell order), rounding included."""
        d2, err = sq_distances(x, *centred(self.pivots))
        low = np.sqrt(np.maximum(d2 - err[:, None], 0.0)) - self.radius[None, :]
        low = np.maximum(low * (1 - 1e-12) - 1e-150, 0.0)
        bound = np.maximum.reduceat(logw, self.first)[None, :] - low * low / (2.0 * E)
        return _up(bound)

    def best(self, x: np.ndarray, logw: np.ndarray, E: float, score: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(best score, its id, its squared distance, products computed) of each point; the lowest
        id on a tie. ``score``: what points have already; one that stays below keeps a best of -inf
        and id -1. ``logw`` is in the order of ``ids`` as given."""
        n, logw = len(x), logw[self.order]
        floor = np.full(n, -np.inf) if score is None else score.copy()
        bs, bid, bd, done = np.full(n, -np.inf), np.full(n, -1, np.int64), np.full(n, np.nan), 0
        with np.errstate(invalid="ignore", over="ignore"):
            odd = np.flatnonzero(~np.isfinite(x).all(axis=1))
            if np.isnan(logw).any():
                odd = np.arange(n)
        step = max(1, SCORE_BYTES // (8 * len(self.first)))
        for lo in range(0, n, step):
            q = slice(lo, lo + step)
            with np.errstate(invalid="ignore", over="ignore"):
                bound = self._bounds(x[q], logw, E)
            first = bound.argmax(axis=1)
            for turn in (True, False):  # each point's most promising cell, then what can still beat it
                for c in range(len(self.first)):
                    rows = np.flatnonzero((first == c) & (bound[:, c] >= floor[q]) if turn else (first != c) & (bound[:, c] >= floor[q]))
                    if not len(rows):
                        continue
                    rows += lo
                    done += self._cell(c, rows, x, logw, E, bs, bid, bd)
                    floor[rows] = np.maximum(floor[rows], bs[rows])
        if len(odd):  # no bound holds for these
            by = np.argsort(self.ids, kind="stable")
            b, i, d, _ = best_of_block(x[odd], self.phi[by], logw[by], self.ids[by], E)
            bs[odd], bid[odd], bd[odd] = b, i, d
            done += len(odd) * len(self.ids)
        return bs, bid, bd, done

    def _cell(self, c: int, rows: np.ndarray, x, logw, E: float, bs, bid, bd) -> int:
        own = slice(self.first[c], self.end[c])
        ids = self.ids[own]
        step = max(1, SCORE_BYTES // (8 * len(ids)))
        for lo in range(0, len(rows), step):
            r = rows[lo: lo + step]
            b, i, d, _ = best_of_block(x[r], self.phi[own], logw[own], ids, E, with_sum=False)
            better = (b > bs[r]) | ((b == bs[r]) & ((i < bid[r]) | (bid[r] < 0)))
            bs[r], bid[r], bd[r] = np.where(better, b, bs[r]), np.where(better, i, bid[r]), np.where(better, d, bd[r])
        return len(rows) * len(ids)

    def reached(self, x: np.ndarray, logw: np.ndarray, E: float, floor: np.ndarray) -> np.ndarray:
        """Ids of the centres whose score is no less than ``floor`` for some point (rounding included:
        a few more than that, never fewer)."""
        logw, hit = logw[self.order], np.zeros(len(self.ids), bool)
        step = max(1, SCORE_BYTES // (8 * len(self.first)))
        for lo in range(0, len(x), step):
            q = slice(lo, lo + step)
            bound = self._bounds(x[q], logw, E)
            for c in range(len(self.first)):
                own = slice(self.first[c], self.end[c])
                rows = np.flatnonzero(~(bound[:, c] < floor[q])) + lo
                width = max(1, SCORE_BYTES // (8 * (self.end[c] - self.first[c])))
                for at in range(0, len(rows), width):
                    if hit[own].all():
                        break
                    r = rows[at: at + width]
                    d2, err = sq_distances(x[r], *centred(self.phi[own]))
                    s = logw[own][None, :] - np.maximum(d2 - err[:, None], 0.0) / (2.0 * E)
                    hit[own] |= ~(_up(s) < floor[r][:, None]).all(axis=0)
        return np.sort(self.ids[hit])
