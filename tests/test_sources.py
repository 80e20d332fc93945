import pytest
from pyspark.sql import functions as F

from mixshard.sources.points import assign_shards, dense_ids, parse_points, read_text_points, shard_count_for


def test_messy_text_drop(spark, tmp_path):
    p = tmp_path / "pts.txt"
    p.write_text("1.5  2.5 1\n  3 4 2 \n\n5 abc 1\n6 7\n8 9 3 extra\n")
    df = read_text_points(spark, str(p), 2, True, on_error="drop").orderBy("point_id").collect()
    assert [(r.x, r.label) for r in df] == [([1.5, 2.5], 1), ([3.0, 4.0], 2), ([8.0, 9.0], 3)]
    assert [r.point_id for r in df] == [0, 1, 2]


def test_text_without_label_and_fail_policy(spark, tmp_path):
    p = tmp_path / "u.txt"
    p.write_text("1 2\n3 4\n")
    rows = read_text_points(spark, str(p), 2, False).orderBy("point_id").collect()
    assert [(r.point_id, r.x, r.label) for r in rows] == [(0, [1.0, 2.0], None), (1, [3.0, 4.0], None)]
    bad = tmp_path / "b.txt"
    bad.write_text("1 x\n")
    with pytest.raises(Exception):
        read_text_points(spark, str(bad), 2, False).collect()


def test_dense_ids_follow_file_order_across_partitions(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 3).alias("v"))
    ids = dense_ids(df).collect()
    assert sorted(r.point_id for r in ids) == list(range(1000))
    assert all(r.v == 3 * r.point_id for r in ids)
    rev = dense_ids(df, order_by=[F.col("v").desc()]).collect()
    assert all(r.point_id == 999 - r.v // 3 for r in rev)


def test_shards_balanced_and_bounded(spark):
    assert shard_count_for(1_000_000, 4, 250_000) == 4
    assert shard_count_for(1_000_001, 4, 250_000) == 5
    pts = spark.range(10_000).withColumnRenamed("id", "point_id")
    sizes = [r["count"] for r in assign_shards(pts, 8).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.2 * 10_000 / 8


def test_parse_keeps_other_columns(spark):
    df = spark.createDataFrame([("a", "1 2 3")], "k STRING, value STRING")
    r = parse_points(df, 2, True).first()
    assert (r.k, r.x, r.label) == ("a", [1.0, 2.0], 3)


def test_aligned_shards_one_per_partition(spark):
    pts = spark.range(20_000).withColumnRenamed("id", "point_id")
    for s in (3, 8, 13):
        df = assign_shards(pts, s, method="aligned").repartition(s, "shard")
        per = df.select("shard", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().collect()
        assert len(per) == s and all(r["count"] == 1 for r in per)


def test_unique_ids_without_extra_pass(spark):
    from mixshard.sources.points import points_from_table

    df = spark.range(0, 500, numPartitions=4).select(F.col("id").cast("double").alias("v"))
    p = points_from_table(df, cols=["v"], ids="unique")
    rows = p.collect()
    assert len({r.point_id for r in rows}) == 500
    assert "InMemoryRelation" not in p._jdf.queryExecution().executedPlan().toString()


def test_shard_count_bounds_bytes_too():
    assert shard_count_for(1_000_000, 1, 10_000_000, dim=64, max_shard_bytes=64 * 8 * 100_000) == 10
    assert shard_count_for(100, None, dim=3) == 1


def test_ids_follow_file_order_over_several_files(spark, tmp_path):
    """Files of 2, 398 and 20 lines, and splits far smaller than a file."""
    lines = [f"{i} {2 * i}" for i in range(420)]
    for name, lo, hi in (("a.txt", 0, 2), ("b.txt", 2, 400), ("c.txt", 400, 420)):
        (tmp_path / name).write_text("\n".join(lines[lo:hi]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "500"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = read_text_points(spark, str(tmp_path), 2, False).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert sorted(r.point_id for r in rows) == list(range(420))
        assert all(r.x == [float(r.point_id), 2.0 * r.point_id] for r in rows)


def test_dropped_lines_are_counted_in_the_same_scan(spark, tmp_path):
    from pyspark.sql import Observation

    p = tmp_path / "pts.txt"
    p.write_text("1.5  2.5 1\n  3 4 2 \n\n5 abc 1\n6 7\n8 9 3 extra\n 1 2 x\n  \n1e3 -2 7\n")
    seen = Observation()
    df = read_text_points(spark, str(p), 2, True, on_error="drop", counts=seen)
    assert df.count() == 4
    assert seen.get == {"lines": 9, "blank": 2, "short": 1, "number": 1, "label": 1, "kept": 4}
    seen = Observation()
    assert parse_points(spark.createDataFrame([("1 2",), (None,), ("x 2",)], "value string"), 2, False, on_error="drop", counts=seen).count() == 1
    assert seen.get == {"lines": 3, "blank": 1, "short": 0, "number": 1, "label": 0, "kept": 1}
    with pytest.raises(ValueError, match="drop"):
        parse_points(spark.createDataFrame([("1 2",)], "value string"), 2, False, counts=Observation())


@pytest.mark.parametrize("n,shards,limit", [(5000, 10, 500), (5000, 10, 505), (3000, 7, 430), (4000, 1, 4000), (1000, 40, 25)])
def test_no_shard_is_above_its_bound(spark, n, shards, limit):
    from mixshard.sources.points import assign_bounded_shards

    pts = spark.range(n).select((F.col("id") * 977).alias("point_id"))
    out, k = assign_bounded_shards(pts, shards, limit)
    sizes = {r["shard"]: r["count"] for r in out.groupBy("shard").count().collect()}
    assert sum(sizes.values()) == n and max(sizes.values()) <= limit
    assert len(sizes) <= k <= 2 * shards + 1
    again, _ = assign_bounded_shards(pts.repartition(5), shards, limit)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    per = out.repartition(k, "shard").select("shard", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().collect()
    assert all(r["count"] == 1 for r in per)


def test_ids_that_no_bound_can_split_are_refused(spark):
    from mixshard.sources.points import assign_bounded_shards

    with pytest.raises(ValueError, match="unique"):
        assign_bounded_shards(spark.range(100).select((F.col("id") % 2).alias("point_id")), 10, 10)
