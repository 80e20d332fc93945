"""Connected components of an edge table as DataFrame joins (alternating stars).

Each round rewires every edge to the smallest neighbour it knows of. Only edges move
(two aggregates with map-side combine, two joins that adaptive execution can split at
a hub); the driver sees one count and one checksum a round, never an edge. Lineage is
cut with tables written in the session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixshard.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """(node, component): component is the smallest node reachable.

    Edges with a null end and loops are ignored; nodes without an edge are not listed.
    An empty table gives an empty result. Raises if ``most_rounds`` does not settle.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
            .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == before or not state["n"]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = (state["n"], state["h"])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_low(both, F.least(F.min("v"), F.col("u"))), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.join(_low(large, F.min("v")), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.u", "s.v")
        e = cut(small.where("u != v").distinct(), "edges", after=e)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _low(e: DataFrame, smallest) -> DataFrame:
    """(u, m) by a map-side combined aggregate."""
    return own_key(e.groupBy("u").agg(smallest.alias("m")), "u")


def own_key(df: DataFrame, key: str) -> DataFrame:
    """An aggregate whose long key is written anew, so that a join on it shuffles both sides
    itself: only then can adaptive execution split the partition of a frequent key."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))
