import pytest

from mixshard.streaming import assign_stream


def test_assign_stream_matches_batch(spark, tmp_path):
    src = tmp_path / "in"
    pts = spark.createDataFrame([(i, [float(i % 7), 0.0]) for i in range(50)], "point_id BIGINT, x ARRAY<DOUBLE>")
    pts.write.parquet(str(src))
    model = spark.createDataFrame([(0, [0.0, 0.0], 10.0, 0.4), (1, [6.0, 0.0], 10.0, 0.4)],
                                  "cluster_id INT, phi ARRAY<DOUBLE>, size DOUBLE, beta DOUBLE")
    stream = spark.readStream.schema(pts.schema).parquet(str(src))
    q = (assign_stream(stream, model, 1.0).writeStream.format("memory").queryName("assigned")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {r.point_id: r.cluster_id for r in spark.sql("SELECT * FROM assigned").collect()}
    assert len(got) == 50
    assert all(got[i] == (0 if i % 7 <= 3 else 1) for i in range(50))
    with pytest.raises(ValueError):
        assign_stream(pts, model, 1.0)
