"""Round state as tables bucketed by shard in the checkpoint folder.

A table bucketed by ``shard`` reads back hash-partitioned by shard, so grouping or
co-grouping two such tables by shard needs no shuffle. There are as many buckets as
shards while Spark's bucket limit (``spark.sql.sources.bucketing.maxBuckets``) allows;
beyond it a bucket holds several shards, and the plan still needs no exchange.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from mixshard.session import delete_path, scratch_path


def bucket_count(spark: SparkSession, shards: int) -> int:
    """Buckets (and partitions) for so many shards."""
    return max(1, min(shards, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))))


@dataclass(frozen=True)
class Bucketed:
    """A written table: its name, folder and frame."""

    name: str
    path: str
    df: DataFrame

    def drop(self) -> None:
        """Forget the table and delete its files."""
        spark = self.df.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(spark, self.path)


def open_bucketed(spark: SparkSession, path: str, schema: str, shards: int, name: str) -> Bucketed:
    """A table that ``write_bucketed`` left at ``path``, under a new name: its buckets count as
    before, in whatever session wrote them. ``schema`` as DDL."""
    table = f"mixshard_{name}_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY (shard) INTO {bucket_count(spark, shards)} BUCKETS LOCATION '{path}'")
    return Bucketed(table, path, spark.table(table))


def write_bucketed(df: DataFrame, shards: int, name: str, sort_by: str | None = None, path: str | None = None) -> Bucketed:
    """Write ``df`` as an external table bucketed by ``shard``, at ``path`` or in a fresh folder of
    the checkpoint folder. Errors of the catalog surface."""
    spark: SparkSession = df.sparkSession
    path = path or scratch_path(spark, name)
    table = f"mixshard_{name}_{uuid.uuid4().hex[:12]}"
    w = df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(bucket_count(spark, shards), "shard")
    if sort_by:
        w = w.sortBy(sort_by)
    w.saveAsTable(table)
    return Bucketed(table, path, spark.table(table))
