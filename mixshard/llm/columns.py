"""Small helpers for native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest table of counted rows that is broadcast to meet a wide table in place.
BROADCAST_BYTES = 32 << 20


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it inside
    lambdas (a plain reference would be evaluated again for every element)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def small(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """Marked for a broadcast if its counted rows fit the bound; beyond it a join with it
    shuffles both sides."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
