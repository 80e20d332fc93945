"""Scores of a batch of points against a block of centres, by one matrix product.

The centres' mean is subtracted before the product, and every choice that the product's
rounding could turn is settled by direct differences, so labels, chosen distances and
scores are those of the direct form at any distance from the origin.
"""

from __future__ import annotations

import numpy as np


def centred(phi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, centres minus mean, their squared norms)."""
    c0 = phi.mean(axis=0) if len(phi) else np.zeros(phi.shape[1])
    p = phi - c0
    return c0, p, (p * p).sum(axis=1)


def sq_distances(x: np.ndarray, c0: np.ndarray, p: np.ndarray, pn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances n x K, bound of their rounding error per point)."""
    xc = x - c0
    xn = (xc * xc).sum(axis=1)
    d2 = np.maximum(xn[:, None] - 2.0 * (xc @ p.T) + pn[None, :], 0.0)
    # the points carry the rounding of their own coordinates as well: x - c0 is exact to that
    err = 4e-16 * (x.shape[1] + 8) * (xn + (pn.max() if len(pn) else 0.0))
    return d2, err


def exact_sq_distances(x: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Squared distances by direct differences, n x K."""
    out = np.empty((len(x), len(phi)))
    for j in range(len(phi)):
        t = x - phi[j]
        out[:, j] = (t * t).sum(axis=1)
    return out


def best_of_block(x: np.ndarray, phi: np.ndarray, logw: np.ndarray, ids: np.ndarray, E: float, with_sum: bool = True
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(best score, its id, its squared distance, log-sum-exp) of each point over a block.

    Lowest id on a tie; ``ids`` ascend. Without ``with_sum`` the last is None."""
    d2, err = sq_distances(x, *centred(phi))
    with np.errstate(invalid="ignore"):
        s = logw[None, :] - d2 / (2.0 * E)
        top = s.max(axis=1)
        near = s >= (top - err / E)[:, None]
    at = near.argmax(axis=1)
    many = np.flatnonzero(near.sum(axis=1) != 1)
    for i in many:  # rounding could turn the choice: direct differences decide
        k = np.flatnonzero(near[i])
        if not len(k):  # NaN wins, as in a maximum over doubles
            at[i] = int(s[i].argmax())
            continue
        t = phi[k] - x[i]
        at[i] = k[int((logw[k] - (t * t).sum(axis=1) / (2.0 * E)).argmax())]
    t = x - phi[at]
    bd = (t * t).sum(axis=1)
    bs = logw[at] - bd / (2.0 * E)
    if not with_sum:
        return bs, ids[at], bd, None
    with np.errstate(invalid="ignore", divide="ignore"):
        shift = np.where(np.isfinite(top), top, 0.0)
        lse = shift + np.log(np.exp(s - shift[:, None]).sum(axis=1))
    return bs, ids[at], bd, lse
