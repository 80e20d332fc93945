"""The model table and how it reaches the points.

``model(cluster_id INT, size DOUBLE, y_mean, phi ARRAY<DOUBLE>, prior_mean ARRAY<DOUBLE>,
prior_var DOUBLE, beta DOUBLE)`` has one row per cluster, so it is small by nature
(K rows). Scoring needs it next to every point: it is broadcast, and each point
scores all clusters inside its own row. No point x cluster rows are ever produced.
The broadcast is guarded by a byte bound; above it the model is split into blocks
that are each under the bound (see ``score``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest model (estimated bytes) shipped as one broadcast row.
MAX_MODEL_BYTES = 256 * 1024 * 1024
# Largest model (estimated bytes) the driver may hold (for the sweep closures).
MAX_DRIVER_BYTES = 512 * 1024 * 1024


@dataclass(frozen=True)
class ModelStats:
    n_clusters: int
    dim: int

    @property
    def est_bytes(self) -> int:
        return self.n_clusters * (self.dim + 4) * 8


def model_stats(model: DataFrame, vec: str = "phi") -> ModelStats:
    """K and d of a model table, from one small aggregate."""
    r = model.agg(F.count(F.lit(1)).alias("k"), F.max(F.size(vec)).alias("d")).first()
    return ModelStats(int(r["k"]), int(r["d"] or 0))


def check_broadcast(stats: ModelStats, max_bytes: int = MAX_MODEL_BYTES) -> int:
    """Number of blocks the model must be split into so each stays under ``max_bytes``."""
    if stats.est_bytes <= max_bytes:
        return 1
    return -(-stats.est_bytes // max_bytes)


def model_arrays(model: DataFrame, *numbers: str) -> tuple:
    """(cluster ids ascending, centres, each of ``numbers``, by default ``logw``) as arrays, by way
    of Arrow: 8 bytes a coordinate on the driver, as ``est_bytes`` counts. The caller bounds it."""
    t = model.select("cluster_id", "phi", *(numbers or ("logw",))).toArrow().combine_chunks()
    ids = t.column("cluster_id").to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    phi = t.column("phi").combine_chunks()
    flat = np.asarray(phi.flatten().to_numpy(zero_copy_only=False), float)
    return ids[order], flat.reshape(len(ids), len(flat) // max(1, len(ids)))[order], *(np.asarray(t.column(n).to_numpy(), float)[order] for n in numbers or ("logw",))


def collect_model(model: DataFrame, max_bytes: int = MAX_DRIVER_BYTES) -> list:
    """Bring a model to the driver; raises before it does if its estimated bytes pass ``max_bytes``."""
    vec = next((c for c in ("phi", "y_mean") if c in model.columns), None)
    if vec is not None:
        stats = model_stats(model, vec)
        if stats.est_bytes > max_bytes:
            raise RuntimeError(f"model of ~{stats.est_bytes} bytes is above the driver bound {max_bytes}")
    return sorted(model.collect(), key=lambda r: r["cluster_id"])
