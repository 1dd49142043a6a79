"""Hand-made literals for the alignment policies and recurrences, and spread against plain windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.operators import aggregate, align, combine, folds, layout, resample, temporal, tensor, windows
from rivulet.operators.ordered import Run, as_of, numbered, scan

A, B = [(0, 0), (10, 1), (20, 2)], [(5, 0), (10, 1), (25, 2)]


def stream(spark, rows, cols="ts_us long, seq long"):
    return spark.createDataFrame(rows, cols)


@pytest.mark.parametrize("spread", [False, True])
def test_framesync_literal(spark, spread):
    a, b = (stream(spark, [(1, *r) for r in x], "g int, ts_us long, seq long") for x in (A, B))
    got = sorted((r.ts_us, r.a.seq, r.b and r.b.seq) for r in align.framesync(a, b, ["g"], spread=spread).collect())
    assert got == [(0, 0, None), (10, 1, 1), (20, 2, 1), (25, 2, 2)]


def test_synchronised_literal(spark):
    got = sorted((r.ts_us, r.in0 and r.in0.seq, r.in1 and r.in1.seq) for r in align.synchronised([stream(spark, A), stream(spark, [*B, (10, 7)])]).collect())
    assert got == [(0, 0, None), (5, None, 0), (10, 1, 7), (20, 2, None), (25, None, 2)]


def test_immediate(spark):
    assert align.immediate([stream(spark, A), stream(spark, B)]).count() == 6


def cached_clock(ticks, times):
    """Consume row after row while the distance doesn't grow; the first row is always taken."""
    out, at = [], 0
    for t in ticks:
        target = t - ticks[0] + times[0]
        best, used = None, None
        while at < len(times) and (best is None or abs(times[at] - target) <= best):
            best, used, at = abs(times[at] - target), at, at + 1
        out.append(used if used is not None else at - 1)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_clocksync_against_a_model(spark, seed):
    rng = np.random.default_rng(seed)
    ticks = np.cumsum(rng.integers(1, 30, 25)).tolist()
    times = sorted(set(rng.integers(0, 500, 20).tolist()))
    got = align.clocksync(stream(spark, [(t,) for t in ticks], "ts_us long"), stream(spark, [(t, k) for k, t in enumerate(times)]), spread=seed % 2 == 0).collect()
    assert [r.n for r in sorted(got, key=lambda r: r.k)] == cached_clock(ticks, times)


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_spread_equals_plain(spark, partitions):
    rng = np.random.default_rng(partitions)
    rows = [(None if rng.random() < 0.1 else str(k), int(t), n, None if rng.random() < 0.3 else int(v)) for n, (k, t, v) in enumerate(zip(rng.choice(["a", "a", "a", "b", "c"], 400), rng.integers(0, 100, 400), rng.integers(-9, 9, 400)))]
    df = stream(spark, rows, "k string, ts_us long, seq long, v long")
    runs = {f"{kind}_{upto}": Run(kind, F.col("v"), upto) for kind in ("number", "sum", "max", "min", "last") for upto in ("row", "before")}
    plain = scan(df, ["k"], ["ts_us", "seq"], runs)
    wide = scan(df, ["k"], ["ts_us", "seq"], runs, spread=True, partitions=partitions)
    fix = lambda rs: sorted([tuple(0 if v is None and n.startswith("number") else v for n, v in r.asDict().items()) for r in rs], key=repr)
    assert fix(plain.collect()) == fix(wide.collect())


def test_as_of_keeps_null_payloads_and_ties(spark):
    left = stream(spark, [("a", 5, 1), ("b", 5, 2)], "k string, ts_us long, seq long")
    right = stream(spark, [("a", 5, 1, 1.0), ("a", 5, 2, None), ("a", 3, 9, 7.0)], "k string, ts_us long, seq long, v double")
    got = {r.k: r.matched for r in as_of(left, right, ["k"]).collect()}
    assert got["a"].seq == 2 and got["a"].v is None and got["b"] is None
    assert as_of(left, right, ["k"], strict=True).where("k = 'a'").first().matched.v == 7.0


def test_temporal_edges(spark):
    df = stream(spark, [("a", t * 1_000_000, t, 10.0) for t in range(10)], "stream_id string, ts_us long, seq long, value double")
    assert [r.value for r in temporal.fade(df, "in", 2, 4).orderBy("seq").collect()] == [0, 0, 0, 2.5, 5, 7.5, 10, 10, 10, 10]
    assert temporal.trim(df, 2, 4).count() == 2 and temporal.trim(df, 2, duration=3).count() == 3
    assert {r.clip_id for r in temporal.clips(df, [1, 2, 3]).collect()} == {None} and temporal.clips(df, [5, 2]).count() == 10
    with pytest.raises(ValueError):
        temporal.limit(df, ["stream_id"], -1)
    with pytest.raises(Exception, match="5 rows reach 5"):
        temporal.max_size(df.withColumn("h", F.lit(1)), 5, "seq", "h", max_hits=3).collect()
    assert temporal.max_size(df.withColumn("h", F.lit(1)), 5, "seq", "h", max_hits=6).count() == 5
    assert temporal.skip_frames(df, 48).count() == 0 and temporal.stretch(df, 0.5).agg(F.max("ts_us")).first()[0] == 4_500_000
    assert [r.loop_no for r in temporal.loop(df, ["stream_id"], 2, 2, 1).orderBy("seq", "loop_no").collect()][:7] == [0, 1, 2, 0, 1, 2, 2]


def test_null_keys_are_one_stream(spark):
    df = stream(spark, [(None, 5, 1, 1.0), (None, 9, 2, 2.0), ("a", 7, 3, 3.0)], "k string, ts_us long, seq long, v double")
    assert sorted((r.seq, r.ts_us) for r in temporal.rebase(df, ["k"]).collect()) == [(1, 0), (2, 4), (3, 0)]
    assert combine.concat(df, "k", 1).count() == 3 and align.framesync(df, df.withColumn("ts_us", F.col("ts_us") + 10), ["k"]).count() == 6
    assert resample.resync(df, ["k"], "passthrough", 1e6).count() == 3 and resample.resync(df.drop("k"), [], "passthrough", 1e6).count() == 3
    assert resample.at_least_apart(df, ["k"], 3).count() == 3


def test_text_scores(spark):
    df = stream(spark, [("the cat sat on the mat", "the cat sat on the mat"), ("the the cat", "the cat"), ("a b", "c d"), (None, "x")], "a string, b string")
    rows = aggregate.text_scores(df, "a", "b").collect()
    assert [round(r.rouge1, 4) for r in rows] == [1.0, 0.8, 0.0, 0.0] and [round(r.bleu, 4) for r in rows] == [1.0, 0.0, 0.0, 0.0]
    assert round(rows[0].meteor, 4) == round(1 - 0.5 / 6**3, 4) and rows[2].meteor == rows[3].meteor == 0
    assert round(aggregate.bleu_of("a b c d e".split(), "a b c d f".split()), 4) == round((4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25, 4)


def test_tensor_shapes(spark):
    assert tensor.squeeze([1, 3, 1]) == [3] and tensor.squeeze([1, 3, 1], 0) == [3, 1] and tensor.squeeze([2, 1], 0) == [2, 1]
    assert tensor.unsqueeze([2, 3], 0) == [1, 2, 3] and tensor.unsqueeze([2, 3], -1) == [2, 3, 1]
    df = stream(spark, [([1.0, 2.0, 3.0, 4.0],)], "x array<double>")
    show = lambda c: df.select(c.alias("y")).first().y
    assert show(tensor.expand(F.col("x"), [1, 4], [2, 4])) == [1, 2, 3, 4] * 2 and show(tensor.as_strided(F.col("x"), [3, 2], [1, 1])) == [1, 2, 2, 3, 3, 4]
    assert show(tensor.vstack(F.col("x"), F.col("x"))) == [1, 2, 3, 4] * 2


def test_windows_literal(spark):
    df = stream(spark, [(1, k, k, k) for k in (1, 2, 3)], "g int, ts_us long, seq long, v long")
    assert [r.around for r in windows.margin(df, ["g"], "v", 3).orderBy("seq").collect()] == [[1, 1, 2], [1, 2, 3], [2, 3, 3]]
    long_ = stream(spark, [(1, k, k, k) for k in range(8)], "g int, ts_us long, seq long, v long")
    assert [r.window for r in windows.hopping(long_, ["g"], "v").orderBy("step").collect()] == [list(range(7)), [3, 4, 5, 6, 7], [6, 7]]


def test_split_and_assemble_keep_order(spark):
    for n in (1, 2, 5):
        df = stream(spark, [(1, k, k) for k in range(13)], "g int, ts_us long, seq long")
        back = combine.assemble(combine.round_robin(df, n, ["g"]), n).orderBy("position").collect()
        assert [r.seq for r in back] == list(range(13)) and [r.position for r in back] == list(range(13))


def test_timeline_literal(spark):
    changes = stream(spark, [(1, t) for t in (3_000_000, 3_000_000, 7_000_000)], "g int, ts_us long")
    ends = stream(spark, [(1, 9_000_000)], "g int, last_us long")
    assert sorted((r.start, r.end) for r in aggregate.timeline(changes, ends, ["g"]).collect()) == [(0, 3), (3, 7), (7, 9)]


def test_segment_ticks_literal(spark):
    got = {r.d: [tuple(t) for t in r.ticks] for r in resample.segment_ticks(stream(spark, [(10.0,), (60.0,), (25.0,), (1200.0,)], "d double"), "d").collect()}
    assert got[10.0] == [] and got[25.0] == [(0, 25)] and len(got[60.0]) == 6 and got[60.0][1] == (11.2, 15.2)
    assert len(got[1200.0]) == 8 and got[1200.0][-1] == (996, 1000)


def test_rate_conversion(spark):
    df = lambda times: stream(spark, [(1, t, k) for k, t in enumerate(times)], "g int, ts_us long, seq long")
    show = lambda t, m, **o: [(r.slot, r.seq) for r in sorted(resample.resync(df(t), ["g"], m, 10.0, **o).collect())]
    even = [k * 100_000 for k in range(5)]
    for method in ("cfr", "vfr", "passthrough", "vscfr"):
        assert show(even, method) == [(k, k) for k in range(5)]
    assert show([0, 100_000, 500_000], "cfr") == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2)]  # again: 0, 0, 2; median 0
    # slots 0, 4, 8, 12: each frame comes three slots late, shows the one before twice and itself twice; again 0, 2, 2, 2
    assert show([0, 400_000, 800_000, 1_200_000], "cfr") == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 1), (7, 2), (8, 2), (9, 2), (10, 2), (11, 3), (12, 3), (13, 3), (14, 3)]
    assert show([300_000, 400_000], "vscfr") == [(3, 0), (4, 1)] and show([300_000, 400_000], "cfr")[:3] == [(0, 0), (1, 0), (2, 0)]
    assert show([0, 130_000, 170_000, 290_000], "vfr") == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert show([0, 10_000, 20_000, 30_000], "vfr") == [(0, 0), (1, 1)]  # the third ends 0.8 slots before the next
    assert show([0, 90_000, 95_000], "passthrough") == [(0, 0), (1, 1), (1, 2)]
    assert show(even[:2], "cfr", min_frames=4) == [(0, 0), (1, 1), (2, 1), (3, 1)]
    report = lambda t, m, **o: resample.resync_report(df(t), ["g"], m, 10.0, **o).first()[1:]
    assert report([0, 400_000, 800_000, 1_200_000], "cfr") == (4, 15, 0, 11)
    assert report([0, 10_000, 20_000, 30_000], "vfr") == (4, 2, 2, 0)
    assert report([0, 10**13], "cfr") == (2, 1, 1, 0)  # too many copies: the frame is left out
    assert resample.output_rate_mode("mp4") == "cfr" and resample.output_rate_mode("mp4", max_rate=30) == "vfr" and resample.output_rate_mode("flv", variable_rate=True, no_timestamps=True) == "passthrough"
    assert show([0, 100_000, 500_000], "vfr") == [(0, 0), (1, 1), (5, 2)]
    assert len(show([k * 20_000 for k in range(50)], "cfr")) in (10, 11, 12)
    assert len(show(even, "cfr", max_frames=3)) == 3
    assert [r.seq for r in resample.at_least_apart(df([0, 5, 10, 14, 20]), ["g"], 10).orderBy("seq").collect()] == [0, 2, 4]


def test_audio_fifo(spark):
    df = stream(spark, [(1, 0, [1.0, 2.0]), (1, 1, [3.0]), (1, 2, [4.0, 5.0])], "g int, seq long, s array<double>")
    assert [(r.pts_us, r.s) for r in resample.audio_fifo(df, ["g"], "s", 2, 2.0).orderBy("frame").collect()] == [(0, [1, 2]), (1_000_000, [3, 4]), (2_000_000, [5])]


def test_clock_repair():
    m = folds.ClockRepair(wrap=1 << 10, jump_us=1 << 20)
    assert [m.feed(t, 100) for t in (800, 900, 1000, 76, 176)] == [800, 900, 1000, 1100, 1200]
    m = folds.ClockRepair()
    s = 1_000_000
    assert [m.feed(t, s) for t in (0, s, 13 * s, 14 * s, 3 * s)] == [0, s, 2 * s, 3 * s, 4 * s]
    m = folds.ClockRepair(discontinuous=False)
    assert [m.feed(t, s) for t in (0, s, 200_000 * s, 2 * s, None)] == [0, s, None, 2 * s, None]


def test_live_repair(spark):
    rows = [("a", 0, 1000, t, t) for t in (0, 10, 20)] + [("a", 1, 1015, t, 100 + t) for t in (0, 10)] + [("a", 2, 1100, t, 200 + t) for t in (0, 5)] + [("a", 3, 99_000_000, 0, 300)]
    df = stream(spark, rows, "k string, c int, start long, ts_us long, seq long")
    got = {r.seq: r.ts_us for r in folds.live_repair(df, ["k"], "c", "start", cut_off_us=1000, interval_us=7).collect()}
    assert got == {0: 1000, 10: 1010, 20: 1020, 100: 1027, 110: 1037, 200: 1100, 205: 1105, 300: 1112}


def test_jitter_buffer():
    b = folds.JitterBuffer(high_us=50, low_us=20)
    for t in range(0, 60, 10):
        b.put(t, t)
    assert b.get(1000) is None  # 50 is not over 50
    b.put(60, 60)
    assert [b.get(1000 + t) for t in (0, 25, 30)] == [None, 20, 30]  # the first of these only binds the clock
    assert b.get(1050) == 50 and b.get(1060) == 50  # 10 cached: filling up again
    b.end()
    assert b.get(1060) == 50 and b.get(1070) == 60
    assert folds.JitterBuffer(video=False).get(5) is None


def test_mux_clock(spark):
    df = stream(spark, [(1, 0, 10, 10), (1, 1, 5, 8), (1, 2, 20, 9), (1, 3, 12, 12)], "g int, seq long, pts long, dts long")
    assert [(r.fixed_pts, r.fixed_dts) for r in windows.mux_clock(df, ["g"]).orderBy("seq").collect()] == [(10, 10), (11, 11), (20, 12), (13, 13)]


def test_boxes():
    boxes, scores = np.array([[0, 0, 10, 10], [1, 1, 11, 11], [50, 50, 60, 60]], float), np.array([0.8, 0.9, 0.1])
    assert aggregate.keep_best(boxes, scores) == [1, 2]
    assert aggregate.largest_free_rect([], 10, 10) == (0, 0, 10, 10)
    assert aggregate.largest_free_rect([(2.0, 5.0)], 10, 10) == (2, 0, 10, 10)


def test_layout_custom(spark):
    df = stream(spark, [(2,)], "n int")
    assert [(r.tile, r.x) for r in layout.custom(df, "n", [(0, 0, 5, 5), (9, 0, 5, 5), (1, 1, 1, 1)]).collect()] == [(0, 0), (1, 9)]
    places = stream(spark, [(k,) for k in range(4)], "i int").select("i", layout.main_first(F.col("i"), 2).alias("p")).collect()
    assert [r.p for r in sorted(places)] == [1, 2, 0, 3]


def test_numbered_needs_no_key(spark):
    got = numbered(stream(spark, [(k, k) for k in range(50)]), [], ["ts_us"], spread=True, partitions=5).collect()
    assert all(r.rn == r.ts_us + 1 for r in got)
