"""A stream run over all that was pushed gives what the batch operator gives."""

import json
import time

import pytest

from rivulet.operators import folds, resample
from rivulet.operators.ordered import as_of
from rivulet.plans.graph import Graph
from rivulet.streaming import live

SCHEMA = "k string, ts_us long, seq long, value double"


def rows(offset, n, step):
    return [(k, offset + t * step, t, float(t)) for k in "ab" for t in range(n)]


def pushed(spark, tmp_path, name, data, schema=SCHEMA, parts=3):
    size = -(-len(data) // parts)
    data = sorted(data, key=lambda r: r[1])
    for a in range(0, len(data), size):
        live.push(spark.createDataFrame(data[a : a + size], schema).coalesce(1), str(tmp_path / name))
    return live.source(spark, str(tmp_path / name), spark.createDataFrame([], schema).schema, queue_limit=1)


def ends(tmp_path, name):
    return str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-ck")


def test_as_of(spark, tmp_path):
    """Both sides in several micro-batches, the right side up to 50 ms out of order and one file behind."""
    ms = 1000
    left, right = rows(5 * ms, 24, 10 * ms), rows(0, 24, 10 * ms)
    last = [("end", 10**9, 99, 0.0)]
    late = sorted(right, key=lambda r: r[1] + (30 * ms if r[2] % 3 == 0 else 0))
    for part in (left[:16] + left[24:40], left[16:24] + left[40:], last, last):
        live.push(spark.createDataFrame(part, SCHEMA).coalesce(1), str(tmp_path / "l"))
    for part in (late[:10], late[10:22], late[22:], last):
        live.push(spark.createDataFrame(part, SCHEMA).coalesce(1), str(tmp_path / "r"))
    schema = spark.createDataFrame([], SCHEMA).schema
    a, b = (live.source(spark, str(tmp_path / n), schema, queue_limit=1) for n in "lr")
    got = live.drain(live.as_of(a, b, ["k"], "value", delay="50 milliseconds"), *ends(tmp_path, "asof"))
    want = as_of(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k"])
    assert sorted((r.k, r.seq, r.right_seq, r.right_value) for r in got.collect()) == sorted((r.k, r.seq, r.matched.seq, r.matched.value) for r in want.collect())


def test_as_of_before_the_first_right_row(spark, tmp_path):
    left, right = [("a", 0, 0, 0.0), ("a", 2000, 1, 0.0), ("end", 10**9, 9, 0.0)], [("a", 1000, 0, None), ("end", 10**9, 9, 0.0)]
    a, b = (pushed(spark, tmp_path, n, d, parts=1) for n, d in (("l", left), ("r", right)))
    got = live.drain(live.as_of(a, b, ["k"], "value"), *ends(tmp_path, "first"))
    assert sorted((r.k, r.seq, r.right_seq, r.right_value) for r in got.collect()) == [("a", 0, None, None), ("a", 1, 0, None)]


def test_at_least_apart(spark, tmp_path):
    data = rows(0, 50, 7)
    got = live.drain(live.at_least_apart(pushed(spark, tmp_path, "s", data), ["k"], 30), *ends(tmp_path, "apart"))
    want = resample.at_least_apart(spark.createDataFrame(data, SCHEMA), ["k"], 30)
    assert sorted((r.k, r.seq) for r in got.collect()) == sorted((r.k, r.seq) for r in want.collect())


JITTER = "k string, arrival_us long, ts_us long, seq long"


def shown(df):
    return sorted((r.k, r.tick, -1 if r.seq is None else r.seq) for r in df.collect())


def test_jitter_buffer(spark, tmp_path):
    """Equal both ways: an end mark gives what the batch form shows after the last arrival."""
    data = [(k, 100 + t * 50, t * 40_000, t) for k in "ab" for t in range(40)]
    marks = [(k, 10_000, None, None) for k in "ab"]
    got = live.drain(live.jitter_buffer(pushed(spark, tmp_path, "j", data + marks, JITTER), ["k"], 50), *ends(tmp_path, "jitter"))
    want = shown(folds.jitter_buffer(spark.createDataFrame(data, JITTER), ["k"], 50))
    assert shown(got) == want and len({s for _, _, s in want}) == 41


def test_jitter_buffer_of_a_silent_source(spark, tmp_path):
    data = [("a", 100 + t * 50, t * 40_000, t) for t in range(20)]
    stream = live.jitter_buffer(pushed(spark, tmp_path, "i", data, JITTER), ["k"], 5000, idle_ms=1500)
    out, ck = ends(tmp_path, "idle")
    want = shown(folds.jitter_buffer(spark.createDataFrame(data, JITTER), ["k"], 5000))
    query = stream.writeStream.format("parquet").option("checkpointLocation", ck).trigger(processingTime="500 milliseconds").start(out)
    for _ in range(120):
        time.sleep(0.5)
        got = shown(spark.read.schema(stream.schema).parquet(out)) if query.lastProgress else []
        if len(got) >= len(want):
            break
    query.stop()
    assert got == want


def test_resets(spark, tmp_path):
    stream = pushed(spark, tmp_path, "x", rows(0, 10, 1), parts=1)
    control = str(tmp_path / "control")
    spark.createDataFrame([("gain", "2", 1), ("gain", "3", 2)], "key string, value string, version int").write.parquet(control)
    out, ck = ends(tmp_path, "reset")
    q = live.with_resets(stream, lambda df, o: df.selectExpr("k", f"value * {o['gain']} AS value"), control, out, ck)
    assert q.awaitTermination(60)
    assert spark.read.parquet(out).selectExpr("sum(value)").first()[0] == 3 * 2 * 45


def test_errors_and_watermarks(spark, tmp_path):
    stream = pushed(spark, tmp_path, "e", rows(0, 4, 1), parts=1)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|zero"):
        live.drain(stream.selectExpr("seq div (seq - seq) AS x"), *ends(tmp_path, "err"))
    bound = live.bounded(stream.selectExpr("timestamp_micros(ts_us) AS t", "k"), "t")
    assert bound.isStreaming and spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy") == "min"


def test_progress_and_resume(spark, tmp_path):
    seen = []
    listener = live.Progress(lambda number, rows: seen.append((number, rows)))
    spark.streams.addListener(listener)
    stream, ends_ = pushed(spark, tmp_path, "p", rows(0, 6, 1), parts=2), ends(tmp_path, "progress")
    assert live.drain(stream, *ends_).count() == 12
    live.push(spark.createDataFrame(rows(10, 1, 1), SCHEMA).coalesce(1), str(tmp_path / "p"))
    assert live.drain(stream, *ends_).count() == 14  # from where it stopped
    for _ in range(50):
        if sum(n for _, n in seen) == 14:
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert sum(n for _, n in seen) == 14


def test_gateway(spark):
    g = Graph()
    (y,) = g.module("volume", g.input_stream("in"), {"gain": 2.0})
    g.output_stream(y)
    gate = live.Gateway(spark, Graph.from_json(json.dumps(g.as_json() | {"mode": "server"})))
    for k in range(3):
        gate.process_work(f"job{k}", **{"in": spark.createDataFrame([("a", 0, 0, float(k))], "stream_id string, ts_us long, seq long, value double")})
    assert gate.request("job1")[y].first().value == 2.0
    name, out = gate.request_next()
    assert name == "job0" and out[y].first().value == 0.0
    assert list(gate.request_all()) == ["job2"] and gate.request_next() is None
    gate.close()
    with pytest.raises(RuntimeError):
        gate.process_work("late")
