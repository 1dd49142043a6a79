import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rivulet.plans.graph import Graph, GraphError, edges, to_text, topological
from rivulet.plans.modules import Functor, Module, ModuleError, ProcessDone, SyncModule, registry, shared
from rivulet.stream import Stream


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(s, t * 1_000_000, t, float(t)) for s in "ab" for t in range(6)], "stream_id string, ts_us long, seq long, value double")


def two_steps():
    g = Graph()
    x = g.input_stream("in")
    (y,) = g.module("trim", x, {"start": 1, "end": 4}, alias="cut")
    (z,) = g.module("volume", y, {"gain": 2.0})
    g.output_stream(z)
    return g


def test_run_and_json(spark, df, tmp_path):
    g = two_steps()
    (out,) = g.run(spark, **{"in": df}).values()
    assert out.agg(F.sum("value")).first()[0] == 2 * 2 * (1 + 2 + 3)
    g.dump(str(tmp_path / "g.json"))
    again = Graph.from_json(str(tmp_path / "g.json"))
    assert again.as_json() == g.as_json() == Graph.from_json(json.dumps(g.as_json())).as_json()
    assert list(again.run(spark, **{"in": df}).values())[0].count() == 6
    assert len(list(again.start(spark, **{"in": df}))) == 6
    assert to_text(g) == "[in]trim=end=4:start=1[trim_0_0];[trim_0_0]volume=gain=2.0[volume_1_0]"


def test_checks(spark, df):
    g = two_steps()
    g.nodes[1].outputs = ["trim_0_0"]
    with pytest.raises(GraphError, match="twice"):
        g.check()
    g = Graph()
    g.module("trim", "b", outputs=["a"])
    g.module("trim", "a", outputs=["b"])
    with pytest.raises(GraphError, match="loop"):
        g.check()
    g = Graph()
    g.module("trim", "nothing")
    with pytest.raises(GraphError, match="not made"):
        g.check()
    with pytest.raises(GraphError):
        Graph(mode="other")
    with pytest.raises(GraphError, match="no data"):
        two_steps().run(spark)
    g = Graph()
    g.module("does_not_exist", g.input_stream("in"))
    with pytest.raises(GraphError, match="no module"):
        g.build(spark, **{"in": df})
    g = two_steps()
    g.nodes[1].inputs = ["trim_0_0", "video:trim_0_0"]
    with pytest.raises(GraphError, match="goes twice"):
        g.check()
    assert topological({3: [1], 1: [], 2: [1, 3]}) == [1, 3, 2]


def test_subgraph_reset_remove(spark, df):
    def inner(option):
        g = Graph()
        (y,) = g.module("trim", g.input_stream("x"), {"start": option["start"]})
        (z,) = g.module("adelay", y, {"ms": 1000})
        g.output_stream(z)
        return g

    g = Graph()
    (y,) = g.module("late", g.input_stream("in"), {"start": 3}, alias="late")
    g.output_stream(y)
    flat = g.inline({"late": inner})
    (out,) = flat.run(spark, **{"in": df}).values()
    assert sorted(r.ts_us for r in out.where("stream_id = 'a'").collect()) == [4_000_000, 5_000_000, 6_000_000]
    g = two_steps()
    g.reset("cut", end=2)
    assert list(g.run(spark, **{"in": df}).values())[0].count() == 2
    g.remove("cut")
    assert not g.nodes and not g.outputs
    with pytest.raises(GraphError):
        g.reset("cut", end=2)


def test_two_inputs(spark, df):
    g = Graph()
    a, b = g.input_stream("a"), g.input_stream("b")
    (o,) = g.module("framesync", [a, b])
    g.output_stream(o)
    (out,) = g.run(spark, a=df.where("seq % 2 = 0"), b=df.where("seq % 2 = 1")).values()
    assert out.count() == 8  # three sync rows and one later row of the other stream, twice


@registry.add("doubler", tags=["math"])
class Doubler(Module):
    def process(self, frames):
        for pdf in frames:
            yield pdf.assign(value=pdf["value"] * self.option.get("by", 2))


class Pair(Module):
    schema, keys = "stream_id string, total double", ("stream_id",)

    def process_pair(self, left, right):
        return pd.DataFrame({"stream_id": [left["stream_id"].iloc[0]], "total": [left["value"].sum() + right["value"].sum()]})


def test_modules(spark, df):
    g = Graph()
    (y,) = g.module("doubler", g.input_stream("in"), {"by": 3})
    g.output_stream(y)
    assert list(g.run(spark, **{"in": df}).values())[0].agg(F.sum("value")).first()[0] == 90
    assert registry.names("math") == ["doubler"] and registry.find("tests.test_graph:Pair").__name__ == "Pair"
    assert {r.total for r in Pair().apply([df, df]).collect()} == {30.0}
    f = Functor(Doubler())
    assert f(pd.DataFrame({"value": [1, 2]}))["value"].tolist() == [2, 4]
    with pytest.raises(ModuleError):
        f()
    empty = Functor(type("Empty", (Module,), {"process": lambda self, frames: iter(())})())
    with pytest.raises(ProcessDone):
        empty(pd.DataFrame())
    s = SyncModule(Doubler())
    s.dynamic_reset({"by": 5})
    assert s.process({"0": pd.DataFrame({"value": [1]})})["value"].tolist() == [5]
    with pytest.raises(ModuleError):
        s.process({"9": pd.DataFrame()})
    assert shared(dict) is shared(dict)


def test_callbacks():
    g = Graph()
    g.add_user_callback(1, lambda b: None)
    g.add_user_callback(1, lambda b: b + b"!")
    assert g.callback(1, b"a") == b"a!" and g.callback(2, b"a") == b""
    g.clear_user_callback(1)
    assert g.callback(1, b"a") == b""


def test_edges(spark):
    nodes = spark.createDataFrame([(0, [], ["x", "y"]), (1, ["x"], ["z"]), (2, ["z", "y"], [])], "id int, inputs array<string>, outputs array<string>")
    assert sorted(map(tuple, edges(nodes).collect())) == [("x", 0, 1), ("y", 0, 2), ("z", 1, 2)]


def test_fluent(spark, df, tmp_path):
    s = Stream(df)
    assert s["a"].trim(1, 3).setpts("PTS-STARTPTS").setpts("PTS+2/TB").df.agg(F.min("ts_us")).first()[0] == 2_000_000
    assert s.setpts("0.5*PTS").df.agg(F.max("ts_us")).first()[0] == 2_500_000
    with pytest.raises(ValueError):
        s.setpts("N/TB")
    assert s["a"].concat(s["b"], frame_us=1_000_000).df.agg(F.max("ts_us")).first()[0] == 11_000_000
    assert s["a"].amix(s["b"]).df.where("ts_us = 4000000").first().value == 4.0
    assert [r.seq for r in s["a"].start()] == list(range(6))
    path = str(tmp_path / "out.mp4")
    assert s.encode(path).first().path == path and spark.read.parquet(path).count() == 12
    assert s["a"].fps(2.0).df.count() == 11 and s.limit(2).df.count() == 4 and s.as_of(s).df.count() == 12
    with pytest.raises(ValueError):
        s.encode()


def test_workflow(spark, df):
    from rivulet.plans import workflow

    registry.add("load")(lambda spark, inputs, option: spark.range(option["n"]).selectExpr("'a' AS stream_id", "id AS ts_us", "id AS seq", "double(id) AS value"))
    flow = {"7": {"class_type": "load", "inputs": {"n": 4}}, "9": {"class_type": "volume", "inputs": {"gain": 2.0, "images": ["7", 0]}}, "10": {"class_type": "framesync", "inputs": {"a": ["7", 0], "b": ["9", 0]}}}
    g = workflow.read(json.dumps(flow))
    assert [n.input_manager for n in g.nodes] == ["default", "default", "framesync"] and g.outputs == ["stream_10_0"]
    assert [r.b.value for r in g.run(spark)["stream_10_0"].orderBy("ts_us").collect()] == [0, 2, 4, 6]
    flow["7"]["inputs"]["x"] = ["10", 0]
    with pytest.raises(GraphError, match="loop"):
        workflow.read(flow)
    registry.remove("load")


def test_update_and_status(spark, df):
    g, more = two_steps(), Graph()
    (w,) = more.module("limit", "volume_1_0", {"n": 1}, outputs=["last"])
    more.output_stream(w)
    g.update(more)
    assert [s["module"] for s in g.status()] == ["trim", "volume", "limit"]
    assert g.run(spark, **{"in": df})["last"].count() == 2


def test_errors_and_conversion(spark, df):
    import logging

    from rivulet import errors
    from rivulet.operators import convert

    errors.raise_for(0)
    with pytest.raises(errors.TimedOut):
        errors.raise_for(-40)
    with pytest.raises(errors.StatusError):
        errors.raise_for(-999)
    buffer = errors.LogBuffer(level=logging.WARNING)
    logging.getLogger("rivulet").warning("seen")
    logging.getLogger("rivulet").info("not seen")
    assert buffer.detach() == ["seen"]
    for bad in ({}, {"video_codec": "h264"}, {"audio_codec": "aac", "channels": 2}):
        with pytest.raises(ValueError):
            convert.raw_stream_option(bad)
    frames = df.selectExpr("1920 AS width", "1080 AS height", "'NV12' AS pix_fmt").limit(1)
    r = convert.convert(frames, convert.Target(height=500, color_space="bt709", media_type="frame")).first()
    assert (r.width, r.height, r.color_space) == (888, 500, "bt709")
    assert Stream(frames).scale(640, -2).df.first().height == 360
    with pytest.raises(ValueError):
        Stream(frames).ff_filter("nothing")
    assert frames.select(convert.parse_size(F.lit("3x4")).alias("s")).first().s.height == 4


def test_command_line(spark, df, tmp_path, capsys):
    from rivulet.__main__ import main

    two_steps().dump(str(tmp_path / "g.json"))
    df.write.parquet(str(tmp_path / "in"))
    main(["run", str(tmp_path / "g.json"), str(tmp_path / "out"), f"in={tmp_path / 'in'}"])
    assert spark.read.parquet(str(tmp_path / "out" / "volume_1_0")).count() == 6
    main(["text", str(tmp_path / "g.json")])
    assert "trim" in capsys.readouterr().out
    (tmp_path / "log").write_text("1,1,10,node,1,1\n1,1,25,node,1,2,size:1:3\n")
    main(["trace", str(tmp_path / "log"), str(tmp_path / "stats")])
    assert spark.read.json(str(tmp_path / "stats" / "durations")).first().total == 15
    main(["new", "my_module", str(tmp_path / "my_module.py")])
    made = {}
    exec((tmp_path / "my_module.py").read_text(), made)
    assert registry.find("my_module") is made["MyModule"]
    registry.remove("my_module")
    with pytest.raises(SystemExit):
        main([])
