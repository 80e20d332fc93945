"""Assign arriving points to a fitted model (stateless micro-batches)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mixshard.operators.score import map_assign


def assign_stream(points: DataFrame, model: DataFrame, E: float, alpha: float = 1.0) -> DataFrame:
    """``points`` is a streaming DataFrame ``(point_id, x, ...)``; ``model`` a static
    ``(cluster_id, phi, size, beta)`` table. Each micro-batch gets the MAP cluster
    and its score; the model row is broadcast once per batch."""
    if not points.isStreaming:
        raise ValueError("assign_stream expects a streaming DataFrame; use map_assign for batch")
    return map_assign(points, model, E, alpha=alpha, with_score=True)
