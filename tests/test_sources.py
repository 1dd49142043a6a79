import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.operators.ordered import as_of
from rivulet.sources import readers, sinks


def test_clock(spark):
    assert [r.clock_us for r in readers.clock(spark, 3, 30).collect()] == [0, 33333, 66666]
    with pytest.raises(ValueError):
        readers.clock(spark, 3, 0)
    assert readers.live_clock(spark).isStreaming


def test_decode_by_name(spark, tmp_path):
    rows = [("video", 0, 0), ("video", 1, 1), ("audio", 2, 2)]
    spark.createDataFrame(rows, "kind string, stream_index int, seq int").write.parquet(str(tmp_path / "m"))
    streams = readers.decode(spark, str(tmp_path / "m"), map_v=1)
    assert streams["video"].count() == 1 and streams["audio"].count() == 1


def test_raw_tensors(spark, tmp_path):
    data = np.arange(6, dtype="float32")
    (tmp_path / "t.bin").write_bytes(data.tobytes())
    got = readers.from_files(spark, str(tmp_path / "t.bin"), count=3, offset=4)
    assert got.first().data == [1, 2, 3]
    assert bytes(readers.to_bytes(got, "data").first().data) == data[1:4].tobytes()


@pytest.fixture
def df(spark):
    return spark.createDataFrame([("a", t * 1_000_000, t) for t in range(5)] + [("b", 0, 9)], "stream_id string, ts_us long, seq long")


def test_encode(spark, df, tmp_path):
    r = sinks.encode(df, prefix=str(tmp_path), job=3).first()
    assert r.path.endswith("/3/output.mp4") and spark.read.parquet(r.path).count() == 6
    sinks.encode(df, str(tmp_path / "list.m3u8"), segment_us=2_000_000)
    assert spark.read.parquet(str(tmp_path / "list.m3u8")).select("segment").distinct().count() == 3
    sinks.encode(df, str(tmp_path / "x.json"))
    assert spark.read.json(str(tmp_path / "x.json")).count() == 6
    with pytest.raises(ValueError):
        sinks.encode(df)


def test_push_and_limits(df):
    assert sinks.push(df, 3) is df and "whence" in sinks.push(df, 1).columns and "whence" not in sinks.push(df, 2).columns
    out = sinks.limited(df, ["stream_id"], 3, 2, frame_us=10)
    assert sorted((r.stream_id, r.ts_us) for r in out.collect()) == [("a", 0), ("a", 1_000_000), ("a", 2_000_000), ("b", 0), ("b", 10)]
    assert [r.seq for r in sinks.generate(df.where("stream_id = 'a'"))] == [0, 1, 2, 3, 4]


def test_pushdown_and_pruning(spark, df, tmp_path):
    df.withColumn("payload", F.lit("x" * 10)).write.parquet(str(tmp_path / "p"))
    from rivulet.operators.temporal import trim

    plan = trim(spark.read.parquet(str(tmp_path / "p")), 1, 3).select("seq")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts_us,1000000)" in plan and "payload" not in plan.split("ReadSchema")[1]


def test_spread_join_has_no_task_for_a_whole_key(spark):
    n = 4000
    left = spark.range(n).selectExpr("'hot' AS k", "id * 10 AS ts_us", "id AS seq")
    right = spark.range(n).selectExpr("'hot' AS k", "id * 10 - 5 AS ts_us", "id AS seq")
    out = as_of(left, right, ["k"], spread=True)
    sizes = out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert out.where("matched.seq != seq").count() == 0 and max(r["count"] for r in sizes) < n * 0.6
