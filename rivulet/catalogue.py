"""Every operator as a query over the test tables, with SQL that gives the same rows.

A query takes (spark, directory of the tables).  Streams keyed by event type have
few, large keys, so their running values are spread over partitions (see
``operators.ordered``); streams keyed by user are plain windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import scalars as S
from rivulet.operators import aggregate, align, combine, convert, folds, image, layout, resample, temporal, tensor, trace, windows
from rivulet.operators.ordered import as_of
from rivulet.plans import graph
from rivulet.plans.modules import Module
from rivulet.schema import micros
from rivulet.shared import folder
from rivulet.sources import readers, sinks
from rivulet.stream import Stream


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        CATALOGUE[name] = Query(f, sql and _PRELUDE + sql)
        return f

    return add


_PRELUDE = """WITH RECURSIVE ev AS (SELECT event_type AS stream_id, event_id AS seq, epoch_us(ts) AS ts_us, user_id, value, props FROM events),
ord AS (SELECT o_orderkey AS seq, o_custkey AS custkey, epoch_us(o_orderdate) AS ts_us, o_totalprice AS price, o_orderstatus AS status FROM orders),
emb AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
"""
#: A time inside the events table, and a span of it.
T0 = 1_704_067_200_000_000
DAY = 86_400_000_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    ev = table(spark, d, "events").select(F.col("event_type").alias("stream_id"), F.col("event_id").alias("seq"), micros(F.col("ts")).alias("ts_us"), "user_id", "value", "props")
    return ev if kind is None else ev.where(F.col("stream_id") == kind)


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("custkey"), micros(F.col("o_orderdate")).alias("ts_us"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def _r(col: str, places: int = 6):
    return F.round(F.col(col), places).alias(col)


KEY = ["stream_id"]


# --- sources ---------------------------------------------------------------
@query("src_range", f"SELECT stream_id, seq, ts_us - {T0} - {DAY} AS ts_us FROM ev WHERE ts_us >= {T0 + DAY} AND ts_us < {T0 + 3 * DAY}")
def src_range(spark, d):
    return temporal.time_range(events(spark, d), T0 + DAY, T0 + 3 * DAY).select("stream_id", "seq", "ts_us")


@query("src_limit", "SELECT stream_id, seq, ts_us FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts_us, seq) AS rn FROM ev) WHERE rn <= 100")
def src_limit(spark, d):
    return temporal.limit(events(spark, d), KEY, 100, spread=True).select("stream_id", "seq", "ts_us")


@query("src_durations", f"SELECT c.id AS clip_id, stream_id, seq, ts_us FROM ev JOIN (VALUES (0, {T0}, {T0 + DAY}), (1, {T0 + 2 * DAY}, {T0 + 4 * DAY}), (2, {T0 + 9 * DAY}, {T0 + 10 * DAY})) c(id, a, b) ON ts_us >= a AND ts_us < b")
def src_durations(spark, d):
    return temporal.clips(events(spark, d), [T0, T0 + DAY, T0 + 2 * DAY, T0 + 4 * DAY, T0 + 9 * DAY, T0 + 10 * DAY]).select("clip_id", "stream_id", "seq", "ts_us")


@query("src_map", "SELECT seq, ts_us, value FROM ev WHERE stream_id = 'view'")
def src_map(spark, d):
    return events(spark, d, "view").select("seq", "ts_us", "value")


@query("src_fps_default", "SELECT user_id, seq, CASE WHEN t IS NULL OR t = lag(t) OVER w THEN lag(t) OVER w + 40000 ELSE t END AS ts_us FROM (SELECT user_id, seq, CASE WHEN seq % 9 <> 0 THEN ts_us END AS t FROM ev) WINDOW w AS (PARTITION BY user_id ORDER BY seq)")
def src_fps_default(spark, d):
    gaps = events(spark, d).withColumn("ts_us", F.when(F.col("seq") % 9 != 0, F.col("ts_us")))
    return temporal.default_fps(gaps, ["user_id"]).select("user_id", "seq", "ts_us")


@query("src_extract_frames", "SELECT stream_id, slot, (slot * 1000000 / 0.01)::BIGINT AS ts_us, seq FROM (SELECT stream_id, round(ts_us * 0.01::DOUBLE / 1000000)::BIGINT AS slot, min_by(seq, (ts_us, seq)) AS seq FROM (SELECT stream_id, seq, ts_us - (SELECT min(ts_us) FROM ev) AS ts_us FROM ev) GROUP BY ALL)")
def src_extract_frames(spark, d):
    ev = events(spark, d)
    lo = ev.agg(F.min("ts_us").alias("_lo"))
    return temporal.extract(ev.crossJoin(F.broadcast(lo)).withColumn("ts_us", F.col("ts_us") - F.col("_lo")), KEY, 0.01).select("stream_id", "slot", "ts_us", "seq")


@query("src_skip_frame", "SELECT seq, ts_us FROM ev WHERE stream_id NOT IN ('error', 'signup')")
def src_skip_frame(spark, d):
    kinds = F.when(F.col("stream_id") == "error", "nonref").when(F.col("stream_id") == "signup", "bidir")
    return temporal.skip_frames(events(spark, d).withColumn("frame_class", kinds), 16).select("seq", "ts_us")


@query("src_max_wh", "SELECT p_partkey, p_size FROM part WHERE p_size < 40 AND p_size * 2 < 60")
def src_max_wh(spark, d):
    return temporal.max_size(table(spark, d, "part").withColumn("twice", F.col("p_size") * 2).where("p_size < 40"), 60, "p_size", "twice").select("p_partkey", "p_size")


@query("src_frame_meta", "SELECT user_id, seq, (row_number() OVER (PARTITION BY user_id ORDER BY ts_us, seq))::VARCHAR AS frame_number, '1/1000000' AS time_base FROM ev")
def src_frame_meta(spark, d):
    n = temporal.frame_numbers(events(spark, d), ["user_id"]).withColumn("metadata", F.lit(None).cast("map<string,string>"))
    m = temporal.with_metadata(n, stream_frame_number=F.col("stream_frame_number"), time_base=F.lit("1/1000000"))
    return m.select("user_id", "seq", S.metadata(F.col("metadata"), "stream_frame_number").alias("frame_number"), S.metadata(F.col("metadata"), "time_base").alias("time_base"))


@query("src_clock", "SELECT range AS n, trunc(range * 1000000 / 30.0::DOUBLE)::BIGINT AS clock_us FROM range(1000) WHERE range < 1000")
def src_clock(spark, d):
    return readers.clock(spark, 1000, 30.0)


@query("src_simple_source", "SELECT range AS value, CASE WHEN range >= 1500 THEN 'EOS' WHEN range % 10 = 0 THEN 'EOF' END AS ctl FROM range(1, 1501)")
def src_simple_source(spark, d):
    return readers.counter(spark)


@query("src_probe", "SELECT stream_id, min(ts_us) AS first_us, max(ts_us) AS last_us, (max(ts_us) - min(ts_us)) / 1e6 AS duration, count(*) AS frames, round((count(*) - 1) / ((max(ts_us) - min(ts_us)) / 1e6), 6) AS fps FROM ev GROUP BY stream_id")
def src_probe(spark, d):
    return aggregate.probe(events(spark, d), KEY)


@query("src_file_list", "SELECT stream_id, (unnest(range(n)))::INT AS file_no, stream_id || '-' || unnest(range(n)) || '.bin' AS path FROM (SELECT DISTINCT stream_id, 3 AS n FROM ev)")
def src_file_list(spark, d):
    jobs = events(spark, d).select("stream_id").distinct().withColumn("paths", F.array(*[F.concat("stream_id", F.lit(f"-{k}.bin")) for k in range(3)]))
    return combine.files(jobs)


@query("src_orig_pts", "SELECT seq, ts_us - min(ts_us) OVER (PARTITION BY stream_id) AS ts_us, (ts_us / 1e6) AS orig FROM ev")
def src_orig_pts(spark, d):
    kept = temporal.with_metadata(events(spark, d).withColumn("metadata", F.lit(None).cast("map<string,string>")), orig_pts_time=F.col("ts_us"))
    out = temporal.rebase(kept, KEY)
    return out.select("seq", "ts_us", (S.metadata(F.col("metadata"), "orig_pts_time").cast("long") / 1e6).alias("orig"))


# --- edits along time --------------------------------------------------------
@query("trim", f"SELECT stream_id, seq, ts_us FROM ev WHERE ts_us >= {T0 + DAY} AND ts_us < {T0 + 2 * DAY}")
def trim(spark, d):
    return temporal.trim(events(spark, d), (T0 + DAY) / 1e6, duration=DAY / 1e6).select("stream_id", "seq", "ts_us")


@query("setpts", "SELECT stream_id, seq, ts_us - min(ts_us) OVER (PARTITION BY stream_id) + 5000000 AS ts_us FROM ev")
def setpts(spark, d):
    return temporal.shift(temporal.rebase(events(spark, d), KEY), 5_000_000).select("stream_id", "seq", "ts_us")


@query("adelay", "SELECT stream_id, seq, ts_us + 1500000 AS ts_us FROM ev")
def adelay(spark, d):
    return temporal.delay(events(spark, d), 1500).select("stream_id", "seq", "ts_us")


@query("afade", f"SELECT seq, round(value * (1 - least(1.0, greatest(0.0, (ts_us - {T0 + DAY}) / {DAY}))), 6) AS value FROM ev")
def afade(spark, d):
    return temporal.fade(events(spark, d), "out", (T0 + DAY) / 1e6, DAY / 1e6).select("seq", _r("value"))


@query("volume", "SELECT seq, value * 3 AS value FROM ev")
def volume(spark, d):
    return temporal.volume(events(spark, d), 3).select("seq", "value")


@query("adjust_pts", "SELECT user_id, seq, ts_us - min(ts_us) OVER (PARTITION BY user_id) AS ts_us FROM ev")
def adjust_pts(spark, d):
    return temporal.rebase(events(spark, d), ["user_id"]).select("user_id", "seq", "ts_us")


@query("loop", "SELECT stream_id, seq, r.range AS loop_no, ts_us + r.range * 1000 AS ts_us FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts_us, seq) AS rn FROM ev) JOIN range(4) r ON rn <= 50 OR r.range = 3")
def loop(spark, d):
    return temporal.loop(events(spark, d), KEY, 50, 3, 1000, spread=True).select("stream_id", "seq", F.col("loop_no").cast("long").alias("loop_no"), "ts_us")


@query("select_scene", "SELECT seq, round(abs(value - p), 6) AS score FROM (SELECT seq, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts_us, seq) AS p FROM ev) WHERE abs(value - p) > 40")
def select_scene(spark, d):
    return temporal.scene_changes(events(spark, d), ["user_id"], 40).select("seq", _r("score"))


@query("metadata_select", "SELECT seq FROM ev WHERE json_extract_string(props, '$.k')::INT < 50")
def metadata_select(spark, d):
    return events(spark, d).withColumn("metadata", F.from_json("props", "map<string,string>")).where(S.metadata(F.col("metadata"), "k").cast("int") < 50).select("seq")


# --- combination --------------------------------------------------------------
@query("concat", "SELECT stream_id, seq, ts_us + coalesce(o, 0) AS ts_us FROM (SELECT stream_id, seq, ts_us - min(ts_us) OVER (PARTITION BY stream_id) AS ts_us FROM ev) JOIN (SELECT stream_id, sum(n) OVER (ORDER BY stream_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS o FROM (SELECT stream_id, max(ts_us) - min(ts_us) + 40000 AS n FROM ev GROUP BY 1)) USING (stream_id)")
def concat(spark, d):
    return combine.concat(temporal.rebase(events(spark, d), KEY), "stream_id", 40_000).select("stream_id", "seq", "ts_us")


@query("split", "SELECT seq, range::INT AS output_no FROM ev, range(3)")
def split(spark, d):
    return combine.copies(events(spark, d), 3).select("seq", "output_no")


@query("amix", "SELECT ts_us, round(sum(value) / 5, 6) AS value, count(*) AS n_inputs FROM (SELECT ts_us // 60000000 AS ts_us, value FROM ev) GROUP BY 1")
def amix(spark, d):
    ev = events(spark, d).withColumn("ts_us", F.expr("ts_us div 60000000"))
    return combine.mix(ev, 5, []).select("ts_us", _r("value"), "n_inputs")


@query("audiomix", "SELECT tick, round(coalesce(v, 0), 6) AS value FROM (SELECT unnest(range(lo, hi + 1)) AS tick FROM (SELECT min(ts_us // 600000000) AS lo, max(ts_us // 600000000) AS hi FROM ev)) LEFT JOIN (SELECT ts_us // 600000000 AS tick, sum(value * CASE stream_id WHEN 'click' THEN 0.5 WHEN 'view' THEN 2 ELSE 1 END) AS v FROM ev WHERE stream_id <> 'error' GROUP BY 1) USING (tick)")
def audiomix(spark, d):
    ev = events(spark, d).withColumn("tick", F.expr("ts_us div 600000000"))
    ticks = ev.agg(F.min("tick").alias("lo"), F.max("tick").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("tick"))
    return combine.audio_mix(ticks, ev, {"click": 0.5, "view": 2.0}, "stream_id", accepted=F.col("stream_id") != "error").select("tick", _r("value"))


@query("split_assemble", "SELECT l_orderkey, l_linenumber, ((rn - 1) % 3)::INT AS branch, (rn - 1) // 3 AS branch_row, rn - 1 AS position FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem)")
def split_assemble(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return combine.assemble(combine.round_robin(li, 3, ["l_orderkey"], ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")), 3).select("l_orderkey", "l_linenumber", "branch", "branch_row", "position")


@query("frame_sequencer", "SELECT stream_id, seq, row_number() OVER (ORDER BY (rn > 1), stream_id, rn) AS position FROM (SELECT stream_id, seq, row_number() OVER (PARTITION BY stream_id ORDER BY ts_us, seq) AS rn FROM ev)")
def frame_sequencer(spark, d):
    return combine.sequence_inputs(events(spark, d), "stream_id", spread=True).select("stream_id", "seq", "position")


# --- alignment -----------------------------------------------------------------
@query("align_immediate", "SELECT 0 AS input_no, seq, ts_us FROM ev WHERE stream_id = 'click' UNION ALL SELECT 1, seq, ts_us FROM ev WHERE stream_id = 'view'")
def align_immediate(spark, d):
    return align.immediate([events(spark, d, "click"), events(spark, d, "view")]).select("input_no", "seq", "ts_us")


_BUCKET = "SELECT stream_id, seq, ts_us // 60000000 * 60000000 AS ts_us FROM ev"


@query("align_default", f"SELECT ts_us, a.seq AS a_seq, b.seq AS b_seq FROM (SELECT ts_us, max(seq) AS seq FROM ({_BUCKET}) WHERE stream_id = 'click' GROUP BY 1) a FULL JOIN (SELECT ts_us, max(seq) AS seq FROM ({_BUCKET}) WHERE stream_id = 'view' GROUP BY 1) b USING (ts_us)")
def align_default(spark, d):
    a, b = (events(spark, d, k).withColumn("ts_us", F.expr("ts_us div 60000000 * 60000000")).select("ts_us", "seq", "value") for k in ("click", "view"))
    return align.synchronised([a, b]).select("ts_us", F.col("in0")["seq"].alias("a_seq"), F.col("in1")["seq"].alias("b_seq"))


_PAIR = "a AS (SELECT * FROM ev WHERE stream_id = 'click'), b AS (SELECT ts_us, max(seq) AS seq FROM ev WHERE stream_id = 'view' GROUP BY 1)"


@query("align_framesync", f", {_PAIR} SELECT a.ts_us, a.seq AS a_seq, b.seq AS b_seq FROM a ASOF LEFT JOIN b ON a.ts_us >= b.ts_us UNION ALL SELECT b.ts_us, (SELECT max_by(seq, ts_us) FROM a), b.seq FROM b WHERE b.ts_us > (SELECT max(ts_us) FROM a)")
def align_framesync(spark, d):
    a, b = (events(spark, d, k).withColumn("g", F.lit(1)).select("g", "ts_us", "seq", "value") for k in ("click", "view"))
    return align.framesync(a, b, ["g"], spread=True).select("ts_us", F.col("a")["seq"].alias("a_seq"), F.col("b")["seq"].alias("b_seq"))


@query("align_framesync_users", "SELECT a.user_id, a.ts_us, a.seq AS a_seq, b.seq AS b_seq FROM (SELECT * FROM ev WHERE stream_id = 'click') a ASOF LEFT JOIN (SELECT user_id, ts_us, max(seq) AS seq FROM ev WHERE stream_id = 'view' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts_us >= b.ts_us")
def align_framesync_users(spark, d):
    a, b = (events(spark, d, k).select("user_id", "ts_us", "seq") for k in ("click", "view"))
    return as_of(a, b, ["user_id"]).select("user_id", "ts_us", F.col("seq").alias("a_seq"), F.col("matched")["seq"].alias("b_seq"))


@query(
    "align_clocksync",
    """, s AS (SELECT ts_us, seq, row_number() OVER (ORDER BY ts_us, seq) - 1 AS n FROM ev WHERE stream_id = 'view'),
t AS (SELECT k, lo + k * 3600000000 AS tick, lo + k * 3600000000 AS target, c FROM (SELECT unnest(range((hi - lo) // 3600000000 + 1)) AS k, lo, c FROM (SELECT min(ts_us) AS lo, max(ts_us) AS hi, count(*) AS c FROM s))),
bk AS (SELECT t.*, s.n AS bn, t.target - s.ts_us AS bd FROM t ASOF LEFT JOIN s ON t.target >= s.ts_us),
fw AS (SELECT bk.*, s.n AS fn, s.ts_us - bk.target AS fd FROM bk ASOF LEFT JOIN s ON bk.target <= s.ts_us),
nb AS (SELECT *, CASE WHEN fn IS NULL THEN bn WHEN bn IS NULL OR fd <= bd THEN fn ELSE bn END AS nb FROM fw),
used AS (SELECT k, tick, target, least(c - 1, k + max(nb - k) OVER (ORDER BY k)) AS n FROM nb)
SELECT k, tick, target, n, seq FROM used JOIN s USING (n)""",
)
def align_clocksync(spark, d):
    s = events(spark, d, "view").select("ts_us", "seq")
    span = s.agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    ticks = span.select(F.explode(F.sequence("lo", "hi", F.lit(3_600_000_000))).alias("ts_us"))
    return align.clocksync(ticks, s).select("k", "tick", "target", "n", F.col("row")["seq"].alias("seq"))


@query("align_server", "SELECT stream_id, seq, coalesce(sum((seq % 97 = 0)::INT) OVER (PARTITION BY stream_id ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS job_id FROM ev")
def align_server(spark, d):
    return align.jobs(events(spark, d), F.col("seq") % 97 == 0, KEY, spread=True).select("stream_id", "seq", "job_id")


@query("overlay", f", {_PAIR} SELECT a.seq, CASE WHEN a.ts_us BETWEEN {T0 + DAY} AND {T0 + 5 * DAY} THEN b.seq END AS over_seq FROM a ASOF LEFT JOIN b ON a.ts_us >= b.ts_us")
def overlay(spark, d):
    a, b = (events(spark, d, k).withColumn("g", F.lit(1)).select("g", "ts_us", "seq") for k in ("click", "view"))
    return align.overlay(a, b, ["g"], T0 + DAY, T0 + 5 * DAY, spread=True).select("seq", F.col("over")["seq"].alias("over_seq"))


@query("composition", "SELECT stream_id, seq, (CASE WHEN x <= 640 THEN x ELSE 1280 - x END)::BIGINT AS x_coord FROM (SELECT stream_id, seq, ((row_number() OVER (PARTITION BY stream_id ORDER BY ts_us, seq) - 1) * 5) % 1280 AS x FROM ev)")
def composition(spark, d):
    return align.divider(events(spark, d), KEY, 640, spread=True).select("stream_id", "seq", F.col("x_coord").cast("long").alias("x_coord"))


@query("switch_gate", "SELECT seq, user_id FROM ev WHERE stream_id = 'view' AND user_id IN (SELECT user_id FROM ev WHERE stream_id = 'purchase')")
def switch_gate(spark, d):
    return align.switch(events(spark, d, "view"), events(spark, d, "purchase"), ["user_id"]).select("seq", "user_id")


@query("streamhub", ", t AS (SELECT unnest(range(lo, hi, 7200000000)) AS ts_us FROM (SELECT min(ts_us) AS lo, max(ts_us) AS hi FROM ev)), k AS (SELECT DISTINCT stream_id FROM ev) SELECT ts_us, string_agg(stream_id || ':' || seq, ',' ORDER BY stream_id) AS mixed FROM (SELECT g.ts_us, g.stream_id, b.seq FROM (SELECT * FROM t, k) g ASOF JOIN (SELECT stream_id, ts_us, max(seq) AS seq FROM ev GROUP BY ALL) b ON g.stream_id = b.stream_id AND g.ts_us >= b.ts_us) GROUP BY ts_us")
def streamhub(spark, d):
    ev = events(spark, d).select("stream_id", "ts_us", "seq")
    span = ev.agg(F.min("ts_us").alias("lo"), (F.max("ts_us") - 1).alias("hi"))
    ticks = span.select(F.explode(F.sequence("lo", "hi", F.lit(7_200_000_000))).alias("ts_us"))
    found = align.hub(ticks, ev, "stream_id", spread=True)
    return found.select("ts_us", F.array_join(F.transform("rows", lambda x: F.concat_ws(":", x["stream_id"], x["row"]["seq"])), ",").alias("mixed"))


# --- resampling -------------------------------------------------------------------
@query("resample_cfr", ", g AS (SELECT stream_id, unnest(range(min(ts_us), max(ts_us) + 1, 3600000000)) AS ts_us FROM ev GROUP BY 1) SELECT g.stream_id, g.ts_us, e.seq FROM g ASOF LEFT JOIN (SELECT stream_id, ts_us, max(seq) AS seq FROM ev GROUP BY ALL) e ON g.stream_id = e.stream_id AND g.ts_us >= e.ts_us")
def resample_cfr(spark, d):
    return resample.constant_rate(events(spark, d).select("stream_id", "ts_us", "seq"), KEY, 3_600_000_000, spread=True).select("stream_id", "ts_us", F.col("row")["seq"].alias("seq"))


@query("resample_vfr", "SELECT user_id, slot, seq FROM (SELECT user_id, round(ts_us * 0.001::DOUBLE / 1000000)::BIGINT AS slot, min_by(seq, (ts_us, seq)) AS seq FROM ev GROUP BY 1, 2)")
def resample_vfr(spark, d):
    return resample.variable_rate(events(spark, d), ["user_id"], 0.001).select("user_id", "slot", "seq")


@query("resample_passthrough", "SELECT seq, round(ts_us * 0.001::DOUBLE / 1000000)::BIGINT AS slot FROM ev")
def resample_passthrough(spark, d):
    return resample.slots(events(spark, d), 0.001).select("seq", "slot")


@query("audio_fifo", ", x AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS j, v FROM (SELECT label, vec_id, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM emb)) SELECT label, j // 48 AS frame, floor((j // 48) * 48 * 1000000 / 44100.0::DOUBLE)::BIGINT AS pts_us, count(*) AS n, round(sum(v), 4) AS total FROM x GROUP BY 1, 2")
def audio_fifo(spark, d):
    frames = resample.audio_fifo(vectors(spark, d), ["label"], "e", 48, 44100.0, ("vec_id",))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return frames.select("label", "frame", "pts_us", F.size("e").cast("long").alias("n"), F.round(total, 4).alias("total"))


@query("segment_ticks", "SELECT c_custkey, CASE WHEN n = 0 THEN 0 WHEN gap < 0.5 THEN 1 ELSE n END AS n_ticks, round(CASE WHEN n = 0 THEN 0 WHEN gap < 0.5 THEN dur ELSE (n - 1) * (gap + 4) + 4 END, 3) AS last_end FROM (SELECT *, (CASE WHEN dur > 600 THEN least(dur, 1000.0) ELSE dur END - n * 4) / (n - 1) AS gap FROM (SELECT c_custkey, (c_custkey % 1300)::DOUBLE AS dur, CASE WHEN c_custkey % 1300 < 24 THEN 0 WHEN c_custkey % 1300 <= 600 THEN 6 ELSE 8 END AS n FROM customer))")
def segment_ticks(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 1300).cast("double").alias("dur"))
    out = resample.segment_ticks(c, "dur")
    return out.select("c_custkey", F.size("ticks").alias("n_ticks"), F.round(F.coalesce(F.try_element_at("ticks", F.lit(-1))["end"], F.lit(0.0)), 3).alias("last_end"))


@query("clock_rows", "SELECT user_id, seq, ((row_number() OVER (PARTITION BY user_id ORDER BY ts_us, seq) - 1) * 1000000 / 25.0::DOUBLE)::BIGINT AS clock_us FROM ev")
def clock_rows(spark, d):
    return resample.row_slots(events(spark, d), ["user_id"], 25.0).select("user_id", "seq", "clock_us")


_FRAMES = ", f AS (SELECT user_id, seq, ts_us, ts_us - min(ts_us) OVER (PARTITION BY user_id) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, seq) AS rn FROM ev), g AS (SELECT *, t::DOUBLE * 0.001::DOUBLE / 1000000 + sign(t) / 131072.0::DOUBLE AS x FROM f)"
_VFR = _FRAMES + """, r AS (
    SELECT DISTINCT user_id, 0::BIGINT AS rn, 0::BIGINT AS seq, 0::BIGINT AS slot, false AS shown, 0::BIGINT AS next FROM f
    UNION ALL
    SELECT user_id, rn, seq, slot, shown, slot + shown::INT FROM (
        SELECT g.user_id, g.rn, g.seq, CASE WHEN x + 1 - next > 0.6 THEN round_even(greatest(x, next::DOUBLE), 0)::BIGINT ELSE next END AS slot, x + 1 - next > -0.6 AS shown
        FROM r JOIN g ON g.user_id = r.user_id AND g.rn = r.rn + 1)
)"""
_CFR = _FRAMES + """, r AS (
    SELECT DISTINCT user_id, 0::BIGINT AS rn, 0::BIGINT AS n, 0::BIGINT AS again, 0::BIGINT AS next, [0::BIGINT, 0, 0] AS last3, 0::BIGINT AS emitted FROM f
    UNION ALL
    SELECT user_id, rn, n, least(again, n), next + n, [least(again, n), last3[1], last3[2]], emitted + n FROM (
        SELECT g.user_id, g.rn, next, last3, emitted, CASE WHEN x + 1 - next < -1.1 THEN 0 ELSE greatest(1, round_even(x + 1 - next, 0))::BIGINT END AS n,
               greatest(0, round_even(CASE WHEN x < next AND x + 1 > next THEN 0 ELSE x - next END - 0.6, 0))::BIGINT AS again
        FROM r JOIN g ON g.user_id = r.user_id AND g.rn = r.rn + 1)
)"""


@query("vsync_exact", _VFR + " SELECT user_id, slot, seq, false AS repeated FROM r WHERE rn > 0 AND shown")
def vsync_exact(spark, d):
    return resample.resync(temporal.rebase(events(spark, d), ["user_id"]), ["user_id"], "vfr", 0.001)


@query("vsync_constant", _CFR + " SELECT user_id, max(rn) AS frames_in, (max(emitted) + list_sort(max_by(last3, rn))[2])::BIGINT AS frames_out FROM r GROUP BY user_id")
def vsync_constant(spark, d):
    return resample.resync_report(temporal.rebase(events(spark, d), ["user_id"]), ["user_id"], "cfr", 0.001).select("user_id", "frames_in", "frames_out")


@query("ocr_sample", _FRAMES + """, r AS (
    SELECT user_id, rn, ts_us, seq, true AS taken, ts_us AS last FROM f WHERE rn = 1
    UNION ALL
    SELECT f.user_id, f.rn, f.ts_us, f.seq, f.ts_us >= last + 3600000000, CASE WHEN f.ts_us >= last + 3600000000 THEN f.ts_us ELSE last END FROM r JOIN f ON f.user_id = r.user_id AND f.rn = r.rn + 1
) SELECT user_id, ts_us, seq FROM r WHERE taken""")
def ocr_sample(spark, d):
    return resample.at_least_apart(events(spark, d).select("user_id", "ts_us", "seq"), ["user_id"], 3_600_000_000)


# --- aggregates -------------------------------------------------------------------
@query("timeline", ", c AS (SELECT user_id, ts_us - lo AS p, hi - lo AS last FROM (SELECT user_id, ts_us, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts_us, seq) AS v, min(ts_us) OVER (PARTITION BY user_id) AS lo, max(ts_us) OVER (PARTITION BY user_id) AS hi FROM ev) WHERE abs(value - v) > 60), z AS (SELECT user_id, max(ts_us) - min(ts_us) AS last FROM ev GROUP BY 1), pts AS (SELECT user_id, p FROM c UNION SELECT user_id, 0 FROM z UNION SELECT user_id, last FROM z) SELECT user_id, p / 1e6 AS start, n / 1e6 AS \"end\" FROM (SELECT user_id, p, lead(p) OVER (PARTITION BY user_id ORDER BY p) AS n FROM pts) WHERE n > p")
def timeline(spark, d):
    ev = temporal.rebase(events(spark, d), ["user_id"])
    ends = ev.groupBy("user_id").agg(F.max("ts_us").alias("last_us"))
    return aggregate.timeline(temporal.scene_changes(ev, ["user_id"], 60), ends, ["user_id"])


@query("score_mean", "SELECT label, round(avg(least(100, greatest(0, sqrt((least(7.42, greatest(2.60, m)) - 2.60) / (7.42 - 2.60)) * 100))), 2) AS score FROM (SELECT label, list_sum([abs(e[i]) * i for i in range(1, 11)]) AS m FROM emb) GROUP BY label")
def score_mean(spark, d):
    v = vectors(spark, d).withColumn("p", F.transform(F.slice("e", 1, 10), F.abs))
    return aggregate.score_mean(v, ["label"], "p")


@query("quality_mean", "SELECT user_id, round(avg(value * (9.8 - 1.0::DOUBLE / 9) + 1.0::DOUBLE / 9), 2) AS quality FROM ev GROUP BY 1")
def quality_mean(spark, d):
    return aggregate.quality_mean(events(spark, d), ["user_id"], "value")


@query("caption_batches", "SELECT conv_id, (rn - 1) // 3 + 1 AS batch_id, count(*) AS frames, string_agg(text, ' ' ORDER BY rn) AS description FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY 1, 2")
def caption_batches(spark, d):
    return aggregate.caption_batches(table(spark, d, "conversations"), ["conv_id"], 3, "text", ("turn",))


@query("caption_summary", "SELECT conv_id, count(*) AS frames_analysed, string_agg(text, ' ' ORDER BY turn) AS summary FROM conversations GROUP BY 1")
def caption_summary(spark, d):
    b = aggregate.caption_batches(table(spark, d, "conversations"), ["conv_id"], 3, "text", ("turn",))
    return aggregate.caption_summary(b, ["conv_id"])


@query("caption_eval", "SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS n_chars, round(avg(quality), 6) AS quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL GROUP BY 1, 2")
def caption_eval(spark, d):
    both = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return aggregate.evaluation_means(both, ["lang", "source"], ["n_chars", "quality"])


@query("histogram", "SELECT stream_id, bin, coalesce(n, 0) AS n FROM (SELECT stream_id, range::INT AS bin FROM (SELECT DISTINCT stream_id FROM ev), range(256)) LEFT JOIN (SELECT stream_id, least(255, greatest(0, round(value)))::INT AS bin, count(*) AS n FROM ev WHERE value IS NOT NULL GROUP BY 1, 2) USING (stream_id, bin)")
def histogram(spark, d):
    return aggregate.histogram(events(spark, d), KEY, "value")


@query("luma_extent", "SELECT stream_id, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum FROM ev GROUP BY 1")
def luma_extent(spark, d):
    return aggregate.extent(events(spark, d), KEY, "value")


@query("module_stats", "SELECT stream_id, count(*) AS process_count, sum(u)::BIGINT AS total_us, (sum(u) // count(*))::BIGINT AS avg_us, min(u) AS min_us, max(u) AS max_us FROM (SELECT stream_id, floor(value * 100)::BIGINT AS u FROM ev WHERE value >= 0) GROUP BY 1")
def module_stats(spark, d):
    return aggregate.module_stats(events(spark, d).where("value >= 0").withColumn("u", F.floor(F.col("value") * 100)), KEY, "u")


@query("file_md5", "SELECT page_id, md5(html) AS md5 FROM pages")
def file_md5(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5("html").alias("md5"))


_SIDE = "abs(e[{0} * 4 + {1}]) * 50 + {2}"
_LOW, _HIGH = ([_SIDE.format("{0}", k + at, plus) for k in (1, 2)] for at, plus in ((0, 0), (2, 60)))
_AREA = f"(({_HIGH[0]}) - ({_LOW[0]}) + 1) * (({_HIGH[1]}) - ({_LOW[1]}) + 1)"
_BOTH = " * ".join(f"greatest(0, least({b.format('b')}, {b.format('x[1]')}) - greatest({a.format('b')}, {a.format('x[1]')}) + 1)" for a, b in zip(_LOW, _HIGH))


@query(
    "nms",
    ", ranked AS (SELECT vec_id, e, list_sort([{'s': -abs(e[49 + k]), 'k': k} for k in range(12)]) AS o FROM emb)"
    f" SELECT vec_id, list_reduce([[x.k::INT] for x in o], lambda kept, x: CASE WHEN len([b for b in kept if ({_BOTH}) / (({_AREA.format('b')}) + ({_AREA.format('x[1]')}) - ({_BOTH})) >= 0.5]) > 0 THEN kept ELSE kept || x END) AS kept FROM ranked",
)
def nms(spark, d):
    """Twelve boxes of four values each, with twelve scores; the last four values are not needed."""
    box = lambda k: F.array(*[F.abs(F.get("e", F.lit(4 * k + j))) * 50 + (60 if j > 1 else 0) for j in range(4)])
    v = vectors(spark, d).select("vec_id", F.array(*[box(k) for k in range(12)]).alias("boxes"), F.transform(F.slice("e", 49, 12), F.abs).alias("scores"))
    return aggregate.nms(v).select("vec_id", "kept")


@query("free_rect")
def free_rect(spark, d):
    points = events(spark, d).where("stream_id = 'error'").withColumn("y", F.pmod("seq", F.lit(720)))
    return aggregate.free_rect(points, ["user_id"], "value", "y", 1280, 720)


# --- count windows and order ------------------------------------------------------
@query("win_margin", "SELECT user_id, seq, round(coalesce(lag(value) OVER w, value), 6) AS before, round(value, 6) AS own, round(coalesce(lead(value) OVER w, value), 6) AS after FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, seq)")
def win_margin(spark, d):
    m = windows.margin(events(spark, d), ["user_id"], "value", 3)
    return m.select("user_id", "seq", *[F.round(F.get("around", F.lit(k)), 6).alias(n) for k, n in enumerate(("before", "own", "after"))])


@query("win_hop", "SELECT user_id, (rn - 1) // 3 AS step, len(w) AS n, list_sum(w)::BIGINT AS total FROM (SELECT user_id, row_number() OVER o AS rn, list(seq) OVER (o ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS w FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY ts_us, seq)) WHERE (rn - 1) % 3 = 0")
def win_hop(spark, d):
    h = windows.hopping(events(spark, d), ["user_id"], "seq")
    return h.select("user_id", "step", F.size("window").cast("long").alias("n"), F.aggregate("window", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("win_batch", "SELECT stream_id, seq, (row_number() OVER (PARTITION BY stream_id ORDER BY ts_us, seq) - 1) // 7 AS batch_no FROM ev")
def win_batch(spark, d):
    return windows.batches(events(spark, d), KEY, 7, spread=True).select("stream_id", "seq", "batch_no")


@query("win_oldest_first", "SELECT user_id, min_by(stream_id, seq) AS stream_id, min(seq) AS seq FROM ev GROUP BY 1")
def win_oldest_first(spark, d):
    return windows.oldest_first(events(spark, d).select("user_id", "seq", "stream_id"), ["user_id"], "seq").select("user_id", "stream_id", "seq")


@query("ord_task_priority", "SELECT ts_us, user_id AS node_id FROM ev ORDER BY ts_us, node_id")
def ord_task_priority(spark, d):
    return windows.task_order(events(spark, d).select("ts_us", F.col("user_id").alias("node_id")))


@query("ord_node_choice", "SELECT min_by(user_id, (last, user_id)) AS node_id FROM (SELECT user_id, max(ts_us) AS last FROM ev GROUP BY 1) WHERE user_id % 2 = 0")
def ord_node_choice(spark, d):
    nodes = events(spark, d).groupBy(F.col("user_id").alias("node_id")).agg(F.max("ts_us").alias("last_scheduled"))
    return windows.least_recent(nodes, eligible=F.col("node_id") % 2 == 0)


@query("force_key", "SELECT seq, CASE WHEN sn % 2 = 1 THEN CASE WHEN p IS NULL OR p <> sn // 2 THEN 'K' ELSE 'N' END END AS frame_type FROM (SELECT seq, sn, last_value(CASE WHEN sn % 2 = 1 THEN sn // 2 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM (SELECT *, seq % 6 AS sn FROM ev))")
def force_key(spark, d):
    return windows.forced_keys(events(spark, d).withColumn("sn", F.col("seq") % 6), ["user_id"]).select("seq", "frame_type")


@query("io_frm_match", ", c AS (SELECT o_custkey, o_orderkey % 10 AS i, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT o_custkey, max(o_orderkey % 10) AS last FROM orders GROUP BY 1) SELECT o_custkey, input_no, coalesce(n, 0) AS n_out FROM (SELECT o_custkey, unnest(range(last + 1)) AS input_no FROM m) LEFT JOIN (SELECT o_custkey, i AS input_no, n FROM c) USING (o_custkey, input_no)")
def io_frm_match(spark, d):
    return windows.output_counts(table(spark, d, "orders").withColumn("i", F.col("o_orderkey") % 10), ["o_custkey"], "i")


@query("mono_dts", "SELECT stream_id, seq, k + max(v - k) OVER (PARTITION BY stream_id ORDER BY seq) AS fixed_dts FROM (SELECT stream_id, seq, floor(value)::BIGINT AS v, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS k FROM ev)")
def mono_dts(spark, d):
    return windows.rising_dts(events(spark, d).withColumn("dts", F.floor("value")), KEY, spread=True).select("stream_id", "seq", "fixed_dts")


@query("mux_clock", """, m AS (SELECT user_id, seq, floor(value)::BIGINT AS dts, floor(value + seq % 7 - 3)::BIGINT AS pts, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM ev), r AS (
    SELECT user_id, rn, seq, dts, pts, least(pts, dts + greatest(0, pts - dts)) AS fixed_pts, least(dts, pts) AS fixed_dts FROM m WHERE rn = 1
    UNION ALL
    SELECT user_id, rn, seq, dts, pts, CASE WHEN d < last + 1 AND p >= d THEN greatest(p, last + 1) ELSE p END, greatest(d, last + 1) FROM (
        SELECT m.user_id, m.rn, m.seq, m.dts, m.pts, r.fixed_dts AS last, CASE WHEN m.dts > m.pts THEN greatest(m.pts, least(m.dts, r.fixed_dts + 1)) ELSE m.pts END AS p, CASE WHEN m.dts > m.pts THEN greatest(m.pts, least(m.dts, r.fixed_dts + 1)) ELSE m.dts END AS d
        FROM r JOIN m ON m.user_id = r.user_id AND m.rn = r.rn + 1)
) SELECT user_id, seq, dts, pts, fixed_pts, fixed_dts FROM r""")
def mux_clock(spark, d):
    ev = events(spark, d).select("user_id", "seq", F.floor("value").alias("dts"), F.floor(F.col("value") + F.col("seq") % 7 - 3).alias("pts"))
    return windows.mux_clock(ev, ["user_id"])


# --- event log -----------------------------------------------------------------------
_LOG = ", lg AS (SELECT stream_id AS name, ts_us AS ts, CASE WHEN seq % 2 = 0 THEN 'B' ELSE 'E' END AS ph, CASE WHEN seq % 11 = 0 THEN 'INTERLATENCY' WHEN seq % 1000 = 1 THEN 'TRACE_START' ELSE 'PROCESSING' END AS cat, user_id % 7 AS tid, value, seq FROM ev)"
_PAIRS = _LOG + ", pr AS (SELECT * FROM (SELECT *, last_value(CASE WHEN ph = 'B' THEN ts END IGNORE NULLS) OVER (PARTITION BY name ORDER BY ts, ph ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM lg {where}) WHERE ph = 'E' AND b IS NOT NULL)"


def log(spark, d):
    return events(spark, d).select(
        F.col("stream_id").alias("name"),
        F.col("ts_us").alias("ts"),
        F.when(F.col("seq") % 2 == 0, "B").otherwise("E").alias("ph"),
        F.when(F.col("seq") % 11 == 0, "INTERLATENCY").when(F.col("seq") % 1000 == 1, "TRACE_START").otherwise("PROCESSING").alias("cat"),
        (F.col("user_id") % 7).alias("tid"),
        "value",
        "seq",
    )


@query("trace_duration", _PAIRS.format(where="WHERE cat <> 'INTERLATENCY'") + " SELECT name, sum(ts - b)::BIGINT AS total, count(*) AS count, (sum(ts - b) // count(*))::BIGINT AS avg, min(ts - b) AS min, max(ts - b) AS max, round(sum(ts - b) * 100 / (SELECT max(ts) - min(ts) FROM lg), 6) AS percent FROM pr GROUP BY 1")
def trace_duration(spark, d):
    return trace.durations(log(spark, d), spread=True)


@query("trace_frequency", _LOG + " SELECT name, count(*) AS n FROM lg WHERE cat <> 'INTERLATENCY' GROUP BY 1")
def trace_frequency(spark, d):
    return trace.frequencies(log(spark, d))


@query("caption_rouge", r""", t AS (SELECT a.item_id, list_filter(string_split_regex(lower(coalesce(a.text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS a, list_filter(string_split_regex(lower(coalesce(b.text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS b FROM benchmark a LEFT JOIN benchmark b ON b.item_id + 1 = a.item_id),
c AS (SELECT item_id, len(a) AS na, len(b) AS nb, coalesce(list_sum(list_transform(list_intersect(list_distinct(a), list_distinct(b)), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))), 0) AS n FROM t)
SELECT item_id, round(CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE 2 * n / (na + nb) END, 6) AS rouge1 FROM c""")
def caption_rouge(spark, d):
    items = table(spark, d, "benchmark").select("item_id", "text")
    before = items.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("reference"))
    return aggregate.text_scores(items.join(before, "item_id", "left"), "text", "reference").select("item_id", F.round("rouge1", 6).alias("rouge1"))


@query("black_frames", "SELECT vec_id, floor(100 * len(list_filter(e, lambda x: abs(x) * 255 < 32)) / len(e))::INT AS pblack FROM emb")
def black_frames(spark, d):
    return vectors(spark, d).select("vec_id", S.black_share(F.transform("e", lambda x: F.abs(x) * 255)).alias("pblack"))


@query("type_hash", "SELECT count(DISTINCT stream_id) AS names, count(DISTINCT hash(stream_id)) AS hashes FROM ev")
def type_hash(spark, d):
    return events(spark, d).agg(F.count_distinct("stream_id").alias("names"), F.count_distinct(S.type_hash(F.col("stream_id"))).alias("hashes"))


@query("tensor_strided", "SELECT vec_id, list_transform(range(12), lambda k: round(e[(k // 3) * 4 + (k % 3) * 2 + 3], 6)) AS view, list_transform(range(6), lambda k: round(e[k // 3 + 1], 6)) AS wide FROM emb")
def tensor_strided(spark, d):
    six = lambda c: F.transform(c, lambda x: tensor.round_to(x, 6))
    return vectors(spark, d).select("vec_id", six(tensor.as_strided(F.col("e"), [4, 3], [4, 2], 2)).alias("view"), six(tensor.expand(F.slice("e", 1, 2), [2, 1], [2, 3])).alias("wide"))


@query("adelay_silence", ", s AS (SELECT stream_id, min(ts_us) AS lo FROM ev GROUP BY 1) SELECT stream_id, seq, ts_us + 1500000 AS ts_us, value FROM ev UNION ALL SELECT stream_id, k - 38, lo + k * 40000, 0 FROM s, range(38) r(k)")
def adelay_silence(spark, d):
    return temporal.delay_with_silence(events(spark, d).select("stream_id", "seq", "ts_us", "value"), KEY, 1500, 40_000)


@query("snk_encode", "SELECT stream_id, seq, ts_us, ts_us // 86400000000 AS segment FROM ev")
def snk_encode(spark, d):
    """Written by job and segment, and read back."""
    prefix = f"{folder(spark).rstrip('/')}/encoded-{uuid.uuid4().hex}"
    done = sinks.encode(events(spark, d).select("stream_id", "seq", "ts_us"), prefix=prefix, job=7, segment_us=DAY).first()
    return spark.read.parquet(done.path).select("stream_id", "seq", "ts_us", F.col("segment").cast("long").alias("segment"))


@query("snk_result_row", "SELECT true AS written, 1::BIGINT AS ts_us, count(*) AS rows FROM ev")
def snk_result_row(spark, d):
    path = sinks.output_path(f"{folder(spark).rstrip('/')}/result-{uuid.uuid4().hex}", 3)
    row = sinks.encode(events(spark, d).select("stream_id", "seq", "ts_us"), path)
    return row.crossJoin(spark.read.parquet(path).agg(F.count("*").alias("rows"))).select(F.col("path").endswith("/3/output.mp4").alias("written"), "ts_us", "rows")


@query("trace_queue", _LOG + " SELECT name, max(seq % 32) AS \"limit\", (sum(seq % 5) // count(*))::BIGINT AS avg_size, max(seq % 5) AS max_size FROM lg GROUP BY 1")
def trace_queue(spark, d):
    return trace.queues(log(spark, d), F.col("seq") % 5, F.col("seq") % 32)


@query("trace_throughput", _LOG + " SELECT node, stream, packets, busy_us, round(packets * 1e6 / busy_us, 6) AS fps FROM (SELECT tid AS node, name AS stream, count(*) AS packets FROM lg GROUP BY 1, 2) JOIN (SELECT tid AS node, sum(floor(abs(value) * 10))::BIGINT AS busy_us FROM lg GROUP BY 1) USING (node)")
def trace_throughput(spark, d):
    lg = log(spark, d)
    return trace.throughput(lg.select(F.col("tid").alias("node"), F.col("name").alias("stream")), lg.select(F.col("tid").alias("node"), F.floor(F.abs("value") * 10).alias("duration")))


@query("trace_totals", _LOG + " SELECT max(ts) - min(ts) AS graph_us, max(ts) - min(CASE WHEN cat = 'TRACE_START' THEN ts END) AS trace_us FROM lg")
def trace_totals(spark, d):
    return trace.totals(log(spark, d))


@query("trace_buffer", _LOG + " SELECT tid, count(*) AS total, greatest(count(*) - 100, 0) AS overflowed FROM lg GROUP BY 1")
def trace_buffer(spark, d):
    return trace.buffers(log(spark, d), 100)


@query("trace_dup_begin", _PAIRS.format(where="") + " SELECT name, b AS ts, 'B' AS ph, ts AS end_ts FROM (SELECT *, row_number() OVER (PARTITION BY name, b ORDER BY ts) AS n FROM pr) WHERE n > 1")
def trace_dup_begin(spark, d):
    return trace.begins_shown_twice(log(spark, d), spread=True)


@query("trace_parse", "SELECT seq, stream_id AS name, 'PROCESSING' AS cat, CASE WHEN seq % 2 = 0 THEN 'B' ELSE 'E' END AS ph, (seq % 5)::VARCHAR AS size FROM ev")
def trace_parse(spark, d):
    lines = events(spark, d).select(F.concat_ws(",", "seq", F.lit("1"), "ts_us", "stream_id", F.lit("1"), F.when(F.col("seq") % 2 == 0, "1").otherwise("2"), F.concat(F.lit("size:1:"), (F.col("seq") % 5).cast("string"))).alias("value"))
    return trace.parse(lines).select(F.col("pid").cast("long").alias("seq"), "name", "cat", "ph", F.col("args")["size"].alias("size"))


@query("node_status", "SELECT user_id, count(*) AS n_events, count(DISTINCT stream_id) AS n_streams FROM ev GROUP BY 1")
def node_status(spark, d):
    ev = events(spark, d)
    nodes = ev.groupBy(F.col("user_id").alias("node")).agg(F.count("*").alias("n_events"))
    streams = ev.groupBy(F.col("user_id").alias("node"), "stream_id").agg(F.max("seq").alias("last_seq"))
    snap = trace.status(nodes, streams).withColumn("s", F.from_json("status", "struct<n_events:bigint,streams:array<struct<stream_id:string,last_seq:bigint>>>"))
    return snap.select(F.col("node").alias("user_id"), F.col("s")["n_events"].alias("n_events"), F.size(F.col("s")["streams"]).cast("long").alias("n_streams"))


# --- tensors ---------------------------------------------------------------------------
def _summed(e, name: str = "total", places: int = 4):
    return F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), places).alias(name)


@query("tensor_unary", "SELECT vec_id, list_sum([floor(x * 10) for x in e])::BIGINT AS floors, list_sum([ceil(x * 10) for x in e])::BIGINT AS ceils, round(list_sum([abs(x) for x in e]), 4) AS abs_sum, list_sum([round(x * 10) for x in e])::BIGINT AS rounds FROM emb")
def tensor_unary(spark, d):
    v = vectors(spark, d).withColumn("x", tensor.binary(F.col("e"), 10.0, "mul"))
    one = lambda op: F.aggregate(tensor.unary(F.col("x"), op), F.lit(0.0), lambda a, x: a + x).cast("long")
    return v.select("vec_id", one("floor").alias("floors"), one("ceil").alias("ceils"), _summed(tensor.unary(F.col("e"), "abs"), "abs_sum"), one("round").alias("rounds"))


@query("tensor_binary", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 4) AS dot, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] - p[2])), 4) AS diff FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1")
def tensor_binary(spark, d):
    v = vectors(spark, d)
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    return both.select("vec_id", _summed(tensor.binary(F.col("e"), F.col("f"), "mul"), "dot"), _summed(tensor.binary(F.col("e"), F.col("f"), "sub"), "diff"))


@query("tensor_int_div", "SELECT vec_id, list_sum([trunc(trunc(x * 100) / 7) for x in e])::BIGINT AS total FROM emb")
def tensor_int_div(spark, d):
    x = tensor.cast(F.transform("e", lambda v: v * 100), "int32")
    return vectors(spark, d).select("vec_id", F.aggregate(tensor.binary(x, 7, "div", "int32"), F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("tensor_clip", "SELECT vec_id, round(list_sum([least(0.1, greatest(-0.1, x)) for x in e]), 4) AS total FROM emb")
def tensor_clip(spark, d):
    return vectors(spark, d).select("vec_id", _summed(tensor.clip(F.col("e"), -0.1, 0.1)))


@query("tensor_concat", "SELECT vec_id, len(list_concat(e, e[1:3])) AS n, round(list_concat(e, e[1:3])[-1], 6) AS last FROM emb")
def tensor_concat(spark, d):
    c = tensor.concat(F.col("e"), tensor.slice_(F.col("e"), 0, 3))
    return vectors(spark, d).select("vec_id", F.size(c).cast("long").alias("n"), F.round(F.element_at(c, -1), 6).alias("last"))


@query("tensor_slice", "SELECT vec_id, [round(e[i], 6) for i in [3, 5, 7]] AS part FROM emb")
def tensor_slice(spark, d):
    return vectors(spark, d).select("vec_id", F.transform(tensor.slice_(F.col("e"), 2, 8, 2), lambda x: tensor.round_to(x, 6)).alias("part"))


@query("tensor_transpose", "SELECT vec_id, [round(e[i % 8 * 8 + i // 8 + 1], 6) for i in range(64)] AS part FROM emb")
def tensor_transpose(spark, d):
    return vectors(spark, d).select("vec_id", F.transform(tensor.transpose(F.col("e"), (8, 8)), lambda x: tensor.round_to(x, 6)).alias("part"))


@query("tensor_create", "SELECT range(2, 11, 3) AS a, [0.0::DOUBLE, 0.0, 0.0] AS z, [7.0::DOUBLE, 7.0] AS f FROM region WHERE r_regionkey = 0")
def tensor_create(spark, d):
    one = table(spark, d, "region").where("r_regionkey = 0")
    return one.select(tensor.arange(2, 11, 3).cast("array<bigint>").alias("a"), tensor.zeros(3).alias("z"), tensor.full(2, 7.0).alias("f"))


@query("tensor_cast", "SELECT vec_id, list_sum([least(255, greatest(0, trunc(x * 1000))) for x in e])::BIGINT AS total FROM emb")
def tensor_cast(spark, d):
    u8 = tensor.cast(F.transform("e", lambda x: x * 1000), "uint8")
    return vectors(spark, d).select("vec_id", F.aggregate(u8, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("normalize", "SELECT vec_id, round(list_sum([(e[i] - [0.1, 0.2, 0.3][(i - 1) % 3 + 1]) / [0.5, 0.25, 2.0][(i - 1) % 3 + 1] for i in range(1, len(e) + 1)]), 4) AS total FROM emb")
def normalize(spark, d):
    return vectors(spark, d).select("vec_id", _summed(tensor.normalize(F.col("e"), [0.1, 0.2, 0.3], [0.5, 0.25, 2.0])))


@query("blend", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * 0.75 + p[2] * 0.25)), 4) AS total FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1")
def blend(spark, d):
    v = vectors(spark, d)
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    return both.select("vec_id", _summed(tensor.blend(F.col("e"), F.col("f"), 0.25)))


@query("mirror", "SELECT vec_id, [round(e[i // 8 * 8 + 8 - i % 8], 6) for i in range(64)] AS part FROM emb")
def mirror(spark, d):
    return vectors(spark, d).select("vec_id", F.transform(tensor.mirror(F.col("e"), 8), lambda x: tensor.round_to(x, 6)).alias("part"))


@query("image_transfer", "SELECT vec_id, [round(e[i % 4 * 16 + i // 4 + 1], 6) for i in range(64)] AS part FROM emb")
def image_transfer(spark, d):
    return vectors(spark, d).select("vec_id", F.transform(tensor.nchw_to_nhwc(F.col("e"), 4, 4, 4), lambda x: tensor.round_to(x, 6)).alias("part"))


# --- layouts ------------------------------------------------------------------------
def frames(spark, d):
    return orders(spark, d).groupBy("custkey").agg(F.count("*").alias("n"))


_FRAMES = ", fr AS (SELECT custkey, count(*) AS n FROM ord GROUP BY 1)"


@query("layout_gallery", _FRAMES + ", g AS (SELECT *, CASE WHEN c <= 1 THEN 1 WHEN c <= 4 THEN 2 WHEN c <= 9 THEN 3 ELSE 4 END AS cols, CASE WHEN c <= 2 THEN 1 WHEN c <= 4 THEN 2 WHEN c <= 9 THEN 3 ELSE 4 END AS rws FROM (SELECT *, least(n, 16)::INT AS c FROM fr)) SELECT custkey, n, t::INT AS tile, ((t % cols) * (1280 // cols))::INT AS x, ((t // cols) * (720 // rws))::INT AS y, (1280 // cols)::INT AS w, (720 // rws)::INT AS h FROM (SELECT *, unnest(range(c)) AS t FROM g)")
def layout_gallery(spark, d):
    return layout.gallery(frames(spark, d), "n", 1280, 720)


@query("layout_speaker", _FRAMES + ", g AS (SELECT *, 720 // per AS cl, 1280 // (per + lines) AS cs FROM (SELECT *, CASE WHEN c <= 5 THEN 4 WHEN c <= 7 THEN 6 WHEN c <= 9 THEN 4 ELSE 6 END AS per, CASE WHEN c <= 7 THEN 1 ELSE 2 END AS lines FROM (SELECT *, least(n, 13)::INT AS c FROM fr))), m AS (SELECT *, CASE WHEN c = 1 THEN 1280 ELSE 1280 - lines * cs END AS mn, unnest(range(c)) AS t FROM g) SELECT custkey, n, t::INT AS tile, (CASE WHEN t = 0 THEN 0 ELSE mn + ((t - 1) // per) * cs END)::INT AS x, (CASE WHEN t = 0 THEN 0 ELSE ((t - 1) % per) * cl END)::INT AS y, (CASE WHEN t = 0 THEN mn ELSE cs END)::INT AS w, (CASE WHEN t = 0 THEN 720 ELSE cl END)::INT AS h FROM m")
def layout_speaker(spark, d):
    return layout.speaker(frames(spark, d), "n", 1280, 720)


@query("layout_fit", "SELECT p_partkey, (CASE WHEN same OR wide THEN 640 ELSE greatest(8, w * 360 // h) END)::INT AS w, (CASE WHEN same OR NOT wide THEN 360 ELSE greatest(8, h * 640 // w) END)::INT AS h FROM (SELECT *, w * 360 > h * 640 AS wide, abs(w::DOUBLE / h - 640.0 / 360) < 0.001 AS same FROM (SELECT p_partkey, p_size * 20 AS w, (p_partkey % 50 + 10)::INT * 10 AS h FROM part))")
def layout_fit(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 20).alias("w"), ((F.col("p_partkey") % 50 + 10).cast("int") * 10).alias("h"))
    fit = layout.fit_pad(F.col("w"), F.col("h"), F.lit(640), F.lit(360))
    return p.withColumn("f", fit).select("p_partkey", F.col("f")["w"].alias("w"), F.col("f")["h"].alias("h"))


@query("scale", "SELECT p_partkey, 640 AS w, (round((p_partkey % 50 + 10) * 640 / p_size / 2.0) * 2)::INT AS h FROM part")
def scale(spark, d):
    p = table(spark, d, "part").withColumn("s", layout.scaled(F.col("p_size"), F.col("p_partkey") % 50 + 10, 640, -2))
    return p.select("p_partkey", F.col("s")["w"].alias("w"), F.col("s")["h"].alias("h"))


# --- scalar helpers -------------------------------------------------------------------
@query("json_props", "SELECT seq, json_extract_string(props, '$.k')::INT AS k FROM ev")
def json_props(spark, d):
    return events(spark, d).select("seq", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("metadata_get", "SELECT seq, coalesce(json_extract_string(props, '$.k'), '') AS k, '' AS missing FROM ev")
def metadata_get(spark, d):
    m = F.from_json("props", "map<string,string>")
    return events(spark, d).select("seq", S.metadata(m, "k").alias("k"), S.metadata(m, "none").alias("missing"))


@query("filter_para", "SELECT p_partkey, '320:240:a=' || p_size || ':z=' || p_partkey AS para FROM part")
def filter_para(spark, d):
    named = F.create_map(F.lit("z"), F.col("p_partkey").cast("string"), F.lit("a"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", S.filter_params(F.array(F.lit("320"), F.lit("240")), named).alias("para"))


@query("escape_param", r"SELECT doc_id, md5(regexp_replace(text, '([\\\[\],;])', '\\\1', 'g')) AS escaped FROM documents")
def escape_param(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.escape(F.col("text"))).alias("escaped"))


@query("fraction", "SELECT p_partkey, round(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_partkey / (p_size % 5) END, 6) AS f FROM part")
def fraction(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(S.fraction(F.concat_ws("/", "p_partkey", F.col("p_size") % 5)), 6).alias("f"))


@query("rescale", "SELECT seq, (2 * (seq * 90000) + 1001) // 2002 AS v FROM ev")
def rescale(spark, d):
    return events(spark, d).select("seq", S.rescale(F.col("seq"), 90000, 1001).alias("v"))


@query("stream_ident", "SELECT seq, 'video' AS notify, stream_id || '_' || user_id || '_0' AS name FROM ev")
def stream_ident(spark, d):
    full = F.concat(F.lit("video:"), S.stream_name(F.col("stream_id"), F.col("user_id"), F.lit(0)))
    return events(spark, d).withColumn("p", S.identifier_parts(full)).select("seq", F.col("p")["notify"].alias("notify"), F.col("p")["name"].alias("name"))


@query("even_dim", "SELECT p_partkey, p_size + p_size % 2 AS even FROM part")
def even_dim(spark, d):
    return table(spark, d, "part").select("p_partkey", layout.even(F.col("p_size")).alias("even"))


@query("color_parse", "SELECT p_partkey, [p_partkey % 256, p_size, 255]::INT[] AS rgb FROM part")
def color_parse(spark, d):
    text = F.format_string("#%02x%02xff", F.col("p_partkey") % 256, F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", S.color(text).alias("rgb"))


@query("json_merge", "SELECT seq, 'x' AS added, NULL::VARCHAR AS k FROM ev")
def json_merge(spark, d):
    merged = S.merge_patch(F.col("props"), F.lit('{"added": "x", "k": null}'))
    return events(spark, d).select("seq", S.metadata(merged, "added").alias("added"), F.try_element_at(merged, F.lit("k")).alias("k"))


@query("channel_count", "SELECT seq, bit_count(seq % 1024)::INT AS n FROM ev")
def channel_count(spark, d):
    return events(spark, d).select("seq", S.channels(F.col("seq") % 1024).cast("int").alias("n"))


# --- sources and sinks as rows -----------------------------------------------------------
@query("src_wallclock", "SELECT 'video' AS stream_id, range AS ts_us FROM range(0, 1000001, 40000) UNION ALL SELECT 'audio', range FROM range(0, 1000001, 23220)")
def src_wallclock(spark, d):
    return readers.wall_clock(spark, 1_000_000, {"video": 40_000, "audio": 23_220})


@query("src_anullsrc", "SELECT range AS seq, trunc(range * 1024 * 1000000 / 44100.0::DOUBLE)::BIGINT AS ts_us, 2 AS channels, 1024 AS n FROM range(87)")
def src_anullsrc(spark, d):
    s = readers.silence(spark, 2.0)
    return s.select("seq", "ts_us", F.size("samples").alias("channels"), F.size(F.get("samples", F.lit(0))).alias("n"))


@query("snk_limit", "SELECT user_id, seq, k::BIGINT AS copy, ts_us + k * 40000 AS ts_us FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, seq) AS rn FROM ev) WHERE rn <= 12), (SELECT range AS k FROM range(9)) WHERE k = 0 OR (rn = n AND k <= 8 - n)")
def snk_limit(spark, d):
    out = sinks.limited(events(spark, d).select("user_id", "seq", "ts_us", F.col("ts_us").alias("own")), ["user_id"], 12, 8)
    return out.select("user_id", "seq", F.expr("(ts_us - own) div 40000").alias("copy"), "ts_us")


@query("snk_stream_info", "SELECT stream_id, count(*) AS frames, (max(ts_us) - min(ts_us)) / 1e6 AS duration FROM ev GROUP BY 1")
def snk_stream_info(spark, d):
    info = sinks.stream_info(events(spark, d), KEY).withColumn("i", F.from_json("info", "struct<frames:bigint,duration:double>"))
    return info.select("stream_id", F.col("i")["frames"].alias("frames"), F.col("i")["duration"].alias("duration"))


@query("snk_push_output", "SELECT stream_id, seq, ts_us, value FROM ev")
def snk_push_output(spark, d):
    packed = sinks.push(events(spark, d), 2)
    body = F.from_json(F.col("data").cast("string"), "struct<value:double>")
    return packed.select("stream_id", "seq", "ts_us", body["value"].alias("value"))


@query("snk_null", "SELECT NULL::VARCHAR AS path, 1::BIGINT AS ts_us")
def snk_null(spark, d):
    return sinks.encode(events(spark, d), null=True)


@query("pass_through", "SELECT seq, ts_us, value FROM ev")
def pass_through(spark, d):
    return Stream(events(spark, d)).pass_through().df.select("seq", "ts_us", "value")


@query("vflip", "SELECT vec_id, [round(e[(7 - i // 8) * 8 + i % 8 + 1], 6) for i in range(64)] AS part FROM emb")
def vflip(spark, d):
    return vectors(spark, d).select("vec_id", F.transform(tensor.mirror(F.col("e"), 8, "vertical"), lambda x: tensor.round_to(x, 6)).alias("part"))


@query("crop", "SELECT vec_id, [round(e[(i // 4 + 2) * 8 + i % 4 + 3], 6) for i in range(16)] AS part FROM emb")
def crop(spark, d):
    rows = F.slice(tensor.reshape(F.col("e"), (8, 8)), 3, 4)
    return vectors(spark, d).select("vec_id", F.transform(F.flatten(F.transform(rows, lambda r: F.slice(r, 3, 4))), lambda x: tensor.round_to(x, 6)).alias("part"))


@query("robot_echo", "SELECT vec_id, round(list_sum([e[i] + CASE WHEN i > 4 THEN e[greatest(i - 4, 1)] * 0.5 ELSE 0 END for i in range(1, len(e) + 1)]), 4) AS total FROM emb")
def robot_echo(spark, d):
    return vectors(spark, d).select("vec_id", _summed(tensor.echo(F.col("e"), 4, 0.5)))


@query("arithmetic", "SELECT vec_id, round(list_sum([least(1.0, greatest(0.0, x * 2 - x * 0.5 + 0.25)) for x in e]), 4) AS total FROM emb")
def arithmetic(spark, d):
    return vectors(spark, d).select("vec_id", _summed(tensor.linear(F.col("e"), F.col("e"), 2.0, -0.5, 0.25)))


@query("convert", "SELECT p_partkey, 320 AS width, ((p_partkey % 50 + 10) * 320 // (p_size * 20))::INT AS height, CASE WHEN p_partkey % 2 = 0 THEN 'RGB24' END AS pix_fmt FROM part")
def convert_frames(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 20).alias("width"), (F.col("p_partkey") % 50 + 10).cast("int").alias("height"), F.when(F.col("p_partkey") % 2 == 0, "NV12").otherwise("P016").alias("pix_fmt"))
    return convert.convert(p, convert.Target(width=320, pix_fmt="RGB24"))


@query("src_autorotate", "SELECT p_partkey, CASE WHEN p_partkey % 4 % 2 = 1 THEN 480 ELSE 640 END AS width, CASE WHEN p_partkey % 4 % 2 = 1 THEN 640 ELSE 480 END AS height, 0 AS rotation FROM part")
def src_autorotate(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lit(640).alias("width"), F.lit(480).alias("height"), (F.col("p_partkey") % 4 * 90).alias("rotation"))
    return convert.autorotate(p)


@query("src_stream_copy", "SELECT stream_id, seq, ts_us AS pts, seq % 25 = 0 AS keyframe FROM ev")
def src_stream_copy(spark, d):
    ev = events(spark, d).withColumns({"codec": F.lit("h264"), "width": F.lit(640), "height": F.lit(480), "pts": F.col("ts_us"), "dts": F.col("ts_us"), "keyframe": F.col("seq") % 25 == 0, "data": F.col("props").cast("binary")})
    return convert.packets(ev)[1].select("stream_id", "seq", "pts", "keyframe")


@query("extract_dict", "SELECT seq, value FROM ev")
def extract_dict(spark, d):
    packed = events(spark, d).select(F.struct("seq", "value").alias("payload"), "user_id")
    return convert.unpack(packed, "payload")[0]


@query("setsar", "SELECT seq, '1/1' AS sar FROM ev")
def setsar(spark, d):
    return Stream(events(spark, d)).ff_filter("setsar", "1/1").df.select("seq", "sar")


# --- plans ---------------------------------------------------------------------------------
_NODES = [(0, [], ["v0", "a0"]), (1, ["v0"], ["v1"]), (2, ["v1", "v0"], ["v2"]), (3, ["v2", "a0"], [])]


@query("graph_edges", ", nd(id, i, o) AS (VALUES (0, []::VARCHAR[], ['v0', 'a0']), (1, ['v0'], ['v1']), (2, ['v1', 'v0'], ['v2']), (3, ['v2', 'a0'], []::VARCHAR[])) SELECT m.s AS stream, m.id AS from_id, u.id AS to_id FROM (SELECT id, unnest(o) AS s FROM nd) m JOIN (SELECT id, unnest(i) AS s FROM nd) u ON m.s = u.s")
def graph_edges(spark, d):
    return graph.edges(spark.createDataFrame(_NODES, "id int, inputs array<string>, outputs array<string>"))


@query("graph_topo_sort", "SELECT n AS place, n AS id FROM (SELECT unnest([0, 1, 2, 3]) AS n)")
def graph_topo_sort(spark, d):
    order = graph.topological({0: [], 3: [2, 0], 2: [1, 0], 1: [0]})
    return spark.createDataFrame(list(enumerate(order)), "place int, id int")


@query("graph_json_plan", "SELECT stream_id, seq, ts_us - lo AS ts_us, value * 2 AS value FROM (SELECT *, min(ts_us) OVER (PARTITION BY stream_id) AS lo FROM ev)")
def graph_json_plan(spark, d):
    g = graph.Graph()
    (a,) = g.module("setpts", g.input_stream("in"), {"expression": "PTS-STARTPTS"})
    (b,) = g.module("volume", a, {"gain": 2.0})
    g.output_stream(b)
    (out,) = graph.Graph.from_json(g.as_json()).run(spark, **{"in": events(spark, d)}).values()
    return out.select("stream_id", "seq", "ts_us", "value")


class Scaler(Module):
    """A user module: scales a column."""

    def process(self, frames):
        for pdf in frames:
            yield pdf.assign(value=pdf["value"] * self.option["by"])


@query("udf_module", "SELECT seq, value * 4 AS value FROM ev")
def udf_module(spark, d):
    return Scaler({"by": 4.0}).apply([events(spark, d).select("seq", "value")])


# --- recurrences and pixels (tests compare them with models) ------------------------------------
@query("pts_repair", """, m AS (SELECT user_id, seq, ts_us % 8589934592 AS t, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM ev), r AS (
    SELECT user_id, rn, seq, t, 0::BIGINT AS turns, 0::BIGINT AS off, t AS fixed FROM m WHERE rn = 1
    UNION ALL
    SELECT user_id, rn, seq, t, turns, CASE WHEN abs(o - fixed) > 10000000 OR o - fixed < -100000 THEN off - (o - fixed) ELSE off END, CASE WHEN abs(o - fixed) > 10000000 OR o - fixed < -100000 THEN fixed ELSE o END FROM (
        SELECT *, t + turns * 8589934592 + off AS o FROM (
            SELECT m.user_id, m.rn, m.seq, m.t, r.off, r.fixed, CASE WHEN m.t < r.t - 4294967296 THEN r.turns + 1 WHEN m.t > r.t + 4294967296 AND r.turns <> 0 THEN r.turns - 1 ELSE r.turns END AS turns FROM r JOIN m ON m.user_id = r.user_id AND m.rn = r.rn + 1))
) SELECT user_id, seq, t AS ts_us, fixed AS fixed_us FROM r""")
def pts_repair(spark, d):
    ev = events(spark, d).select("user_id", "seq", F.pmod("ts_us", F.lit(1 << 33)).alias("ts_us"))
    return folds.pts_repair(ev, ["user_id"], wrap=1 << 33)


@query(
    "live_repair",
    f", live AS (SELECT user_id, seq, (since // {DAY})::BIGINT AS connection, (since // {DAY} * {DAY})::BIGINT AS start, (since % {DAY})::BIGINT AS ts_us FROM (SELECT user_id, seq, ts_us - min(ts_us) OVER (PARTITION BY user_id) AS since FROM ev WHERE user_id IS NOT NULL))"
    ", span AS (SELECT user_id, connection, min(start) AS start, max(ts_us) AS length, row_number() OVER (PARTITION BY user_id ORDER BY connection) AS n FROM live GROUP BY 1, 2)"
    ", based AS (SELECT user_id, connection, n, start AS base, NULL::BIGINT AS last, start + length AS now FROM span WHERE n = 1 UNION ALL"
    " SELECT user_id, connection, n, base, now, greatest(now, base + length) FROM (SELECT s.*, b.now, CASE WHEN b.now < s.start AND s.start < b.now + 10000000 THEN s.start ELSE b.now + 33333 END AS base FROM based b JOIN span s ON s.user_id = b.user_id AND s.n = b.n + 1))"
    " SELECT user_id, connection, start, ts_us + base AS ts_us, seq FROM live JOIN based USING (user_id, connection) WHERE last IS NULL OR ts_us + base > last",
)
def live_repair(spark, d):
    ev = temporal.rebase(events(spark, d), ["user_id"]).withColumn("connection", F.floor(F.col("ts_us") / DAY).cast("long"))
    ev = ev.withColumn("start", F.col("connection") * DAY).withColumn("ts_us", F.pmod("ts_us", F.lit(DAY)))
    return folds.live_repair(ev.select("user_id", "connection", "start", "ts_us", "seq"), ["user_id"], "connection", "start")


@query("jitter_buffer")
def jitter_buffer(spark, d):
    ev = temporal.rebase(events(spark, d), ["user_id"]).select("user_id", "seq", "ts_us", (F.col("ts_us") + F.pmod("seq", F.lit(7)) * 1_000_000).alias("arrival_us"))
    return folds.jitter_buffer(ev, ["user_id"], 3_600_000_000, high_us=7_200_000_000, low_us=3_600_000_000)


def _picture(spark, d, operation, *args, **named):
    """Sum and moment of the 8 x 8 pictures after an operation: the moment sees where values went."""
    v = image.on_column(vectors(spark, d).select("vec_id", "e"), "e", (8, 8), operation, *args, **named)
    return v.select("vec_id", _summed(F.col("e")), _summed(F.transform("e", lambda x, i: x * i), "moment"))


def _pixel(row: str, column: str, border: str = "reflect") -> str:
    """SQL of a pixel of an 8 x 8 picture, its border reflected or repeated."""
    held = "7 - abs(7 - abs({}))" if border == "reflect" else "least(7, greatest(0, {}))"
    return f"e[({held.format(row)}) * 8 + ({held.format(column)}) + 1]"


def _sums(pixels: str, before: str = "") -> str:
    """SQL of the sum and the moment of a list of pixels for each picture."""
    return f"{before}, pic AS (SELECT vec_id, {pixels} AS px FROM emb) SELECT vec_id, round(list_sum(px), 4) AS total, round(list_sum([px[i] * (i - 1) for i in range(1, len(px) + 1)]), 4) AS moment FROM pic"


_NEAR = _pixel("i // 8 + k // 3 - 1", "i % 8 + k % 3 - 1")
_FIRST = f"list_sum([[1, 2, 1][k // 3 + 1] * (k % 3 - 1) * {_NEAR} for k in range(9)])"
_SECOND = f"list_sum([[1, 2, 1][k % 3 + 1] * (k // 3 - 1) * {_NEAR} for k in range(9)])"


_CUBIC = "CASE WHEN abs(t) <= 1 THEN 1.25 * abs(t) ** 3 - 2.25 * abs(t) ** 2 + 1 WHEN abs(t) < 2 THEN -0.75 * (abs(t) ** 3 - 5 * abs(t) ** 2 + 8 * abs(t) - 4) ELSE 0 END"


def _taps(to: int) -> str:
    """SQL of the weights of 8 places for each of ``to`` places (o, n, source, w), bicubic."""
    at = f"((o + 0.5) * 8 / {to} - 0.5)"
    return f"SELECT o, least(7, greatest(0, n)) AS source, {_CUBIC.replace('abs(t)', f'abs({at} - n)')} AS w FROM (SELECT o, unnest([floor({at})::INT + k for k in range(-1, 3)]) AS n FROM (SELECT unnest(range({to})) AS o))"


@query(
    "image_resize",
    f", taps AS (SELECT y.o * 16 + x.o AS i, y.source * 8 + x.source + 1 AS source, y.w * x.w AS w FROM ({_taps(12)}) y, ({_taps(16)}) x), moved AS (SELECT source, sum(w) AS w, sum(w * i) AS wi FROM taps GROUP BY 1), pixels AS (SELECT vec_id, unnest(e) AS v, unnest(range(1, 65)) AS source FROM emb) SELECT vec_id, round(sum(v * w), 4) AS total, round(sum(v * wi), 4) AS moment FROM pixels JOIN moved USING (source) GROUP BY 1",
)
def image_resize(spark, d):
    return _picture(spark, d, image.resize, 16, 12, "bicubic")


@query("image_rotate", "SELECT vec_id, [round(e[(7 - i % 8) * 8 + i // 8 + 1], 6) for i in range(64)] AS part FROM emb")
def image_rotate(spark, d):
    v = image.on_column(vectors(spark, d).select("vec_id", "e"), "e", (8, 8), image.rotate, 90)
    return v.select("vec_id", F.transform("e", lambda x: tensor.round_to(x, 6)).alias("part"))


@query(
    "image_gaussian_blur",
    _sums(f"[list_sum([exp(-((k // 3 - 1) ** 2 + (k % 3 - 1) ** 2) / 2.0) / (1 + 2 * exp(-0.5)) ** 2 * {_NEAR} for k in range(9)]) for i in range(64)]"),
)
def image_gaussian_blur(spark, d):
    return _picture(spark, d, image.gaussian_blur, 3, 3, 1.0)


@query(
    "image_sobel",
    _sums(f"[{_FIRST} for i in range(64)]"),
)
def image_sobel(spark, d):
    return _picture(spark, d, image.sobel, 1, 0)


@query(
    "image_canny",
    f", grad AS (SELECT vec_id, [{_FIRST} for i in range(64)] AS gx, [{_SECOND} for i in range(64)] AS gy FROM emb)"
    ", size AS (SELECT vec_id, [abs(gx[i]) + abs(gy[i]) for i in range(1, 65)] AS m, [(round_even(atan2(gy[i], gx[i]) / (pi() / 4), 0)::INT + 8) % 4 + 1 for i in range(1, 65)] AS sector FROM grad)"
    ", beside AS (SELECT vec_id, m, [[i + [0, 1, 1, 1][sector[i + 1]] * 8, i % 8 + [1, 1, 0, -1][sector[i + 1]], i // 8 + [0, 1, 1, 1][sector[i + 1]], i // 8 - [0, 1, 1, 1][sector[i + 1]], i % 8 - [1, 1, 0, -1][sector[i + 1]]] for i in range(64)] AS b FROM size)"
    ", sides AS (SELECT vec_id, m, [CASE WHEN p[2] BETWEEN 0 AND 7 AND p[3] BETWEEN 0 AND 7 THEN m[p[3] * 8 + p[2] + 1] ELSE 0 END for p in b] AS a, [CASE WHEN p[5] BETWEEN 0 AND 7 AND p[4] BETWEEN 0 AND 7 THEN m[p[4] * 8 + p[5] + 1] ELSE 0 END for p in b] AS z FROM beside)"
    ", thin AS (SELECT vec_id, [(m[i] > z[i] AND m[i] >= a[i] AND m[i] > 0.2)::INT for i in range(1, 65)] AS weak, [(m[i] > z[i] AND m[i] >= a[i] AND m[i] > 0.6)::INT for i in range(1, 65)] AS e FROM sides)"
    f", grown AS (SELECT vec_id, weak, e, 0 AS n FROM thin UNION ALL SELECT vec_id, weak, f, n + 1 FROM (SELECT vec_id, weak, e, n, [weak[i + 1] * list_max([{_pixel('i // 8 + k // 3 - 1', 'i % 8 + k % 3 - 1', 'edge')} for k in range(9)]) for i in range(64)] AS f FROM grown) WHERE f <> e)"
    " SELECT vec_id, (255 * list_sum(e))::DOUBLE AS total, (255 * list_sum([e[i] * (i - 1) for i in range(1, 65)]))::DOUBLE AS moment FROM (SELECT vec_id, arg_max(e, n) AS e FROM grown GROUP BY 1)",
)
def image_canny(spark, d):
    return _picture(spark, d, image.canny, 0.2, 0.6)


@query("image_erode", f"SELECT vec_id, [round(list_min([{_pixel('i // 8 + k // 3 - 1', 'i % 8 + k % 3 - 1', 'edge')} for k in range(9)]), 6) for i in range(64)] AS part FROM emb")
def image_erode(spark, d):
    v = image.on_column(vectors(spark, d).select("vec_id", "e"), "e", (8, 8), image.erode)
    return v.select("vec_id", F.transform("e", lambda x: F.round(x, 6)).alias("part"))


_AT_X = "(i % 8 - 0.1 * (i // 8) + 0.05)"
_TAP_X, _TAP_Y = f"(floor({_AT_X})::INT + k % 2)", "(i // 8 - 1 + k // 2)"


@query(
    "image_warp",
    _sums(f"[list_sum([CASE WHEN {_TAP_X} BETWEEN 0 AND 7 AND {_TAP_Y} BETWEEN 0 AND 7 THEN e[{_TAP_Y} * 8 + {_TAP_X} + 1] * (1 - abs({_AT_X} - {_TAP_X})) * 0.5 ELSE 0 END for k in range(4)]) for i in range(64)]"),
)
def image_warp(spark, d):
    return _picture(spark, d, image.warp_perspective, [[1, 0.1, 0], [0, 1, 0.5], [0, 0, 1]], 8, 8, "bilinear")


@query(
    "image_bilateral",
    _sums(
        "[list_sum([t.w * t.v for t in ts]) / list_sum([t.w for t in ts]) for ts in [[{{'v': {0}, 'w': exp(-((k // 5 - 2) ** 2 + (k % 5 - 2) ** 2) / 8.0 - ({0} - e[i + 1]) ** 2 / 0.5)}} for k in range(25)] for i in range(64)]]".format(_pixel("i // 8 + k // 5 - 2", "i % 8 + k % 5 - 2")),
    ),
)
def image_bilateral(spark, d):
    return _picture(spark, d, image.bilateral_filter, 5, 0.5, 2.0)


@query(
    "temporal_denoise",
    f", mean AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, [list_sum([{_pixel('i // 8 + k // 3 - 1', 'i % 8 + k % 3 - 1', 'edge')} for k in range(9)]) / 9 for i in range(64)] AS m FROM emb)"
    ", shown AS (SELECT label, vec_id, n, m FROM mean WHERE n = 1 UNION ALL SELECT mean.label, mean.vec_id, mean.n, [0.5 * mean.m[i] + 0.5 * shown.m[i] for i in range(1, 65)] FROM shown JOIN mean ON mean.label IS NOT DISTINCT FROM shown.label AND mean.n = shown.n + 1)"
    " SELECT label, vec_id, round(list_sum(m), 4) AS total FROM shown",
)
def temporal_denoise(spark, d):
    v = vectors(spark, d).select("label", "vec_id", "e")
    return windows.temporal_denoise(v, ["label"], "e", 8, 8, order=("vec_id",)).select("label", "vec_id", _summed(F.col("e")))


@query("yuv_rgb", "SELECT p_partkey, greatest(0, least(255, floor((y - 16) * 1.164384 + 1.792741 * (v - 128) + 0.5)))::INT AS r FROM (SELECT p_partkey, (p_partkey % 220 + 16)::DOUBLE AS y, (p_size * 4)::DOUBLE AS v FROM part)")
def yuv_rgb(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 220 + 16).cast("double").alias("y"), (F.col("p_size") * 4).cast("double").alias("v"))
    ky, rv, *_ = image.TO_RGB["bt709"]
    return p.select("p_partkey", tensor.cast_one(tensor.half_up((F.col("y") - 16) * ky + rv * (F.col("v") - 128)), "uint8").cast("int").alias("r"))


@query(
    "resample_audio",
    ", heard AS (SELECT vec_id, [e[floor(i * 44100 / 32000)::INT + 1] + (e[floor(i * 44100 / 32000)::INT + 2] - e[floor(i * 44100 / 32000)::INT + 1]) * (i * 44100 / 32000 - floor(i * 44100 / 32000)) for i in range(len(e) * 32000 // 44100)] AS r FROM emb)"
    " SELECT vec_id, len(r)::INT AS n, round(list_sum(r), 4) AS total FROM heard",
)
def resample_audio(spark, d):
    return resample.resample_audio(vectors(spark, d), "e", 44100, 32000).select("vec_id", F.size("e").alias("n"), _summed(F.col("e")))


@query("luma_histogram", "SELECT bin, coalesce(n, 0) AS n FROM (SELECT range::INT AS bin FROM range(256)) LEFT JOIN (SELECT least(255, greatest(0, round(0.299 * (p_partkey % 256) + 0.587 * p_size + 0.114 * 40)))::INT AS bin, count(*) AS n FROM part GROUP BY 1) USING (bin)")
def luma_histogram(spark, d):
    y = aggregate.luma(F.col("p_partkey") % 256, F.col("p_size"), F.lit(40))
    return aggregate.histogram(table(spark, d, "part").withColumn("y", y), [], "y")


# --- the flagship -----------------------------------------------------------------------
@query(
    "session_summary",
    f", c AS (SELECT * FROM ev WHERE stream_id = 'click' AND ts_us >= {T0}), j AS (SELECT c.user_id, c.ts_us, c.value, v.value AS seen FROM c ASOF LEFT JOIN (SELECT user_id, ts_us, max_by(value, seq) AS value FROM ev WHERE stream_id = 'view' AND ts_us >= {T0} GROUP BY ALL) v ON c.user_id = v.user_id AND c.ts_us >= v.ts_us) SELECT user_id, count(*) AS clicks, count(seen) AS after_view, max(ts_us) - min(ts_us) AS span_us, round(sum(value), 4) AS total, round(sum(seen), 4) AS seen FROM j GROUP BY 1",
)
def session_summary(spark, d):
    clicks, views = (events(spark, d, k).where(F.col("ts_us") >= T0).select("user_id", "ts_us", "seq", "value") for k in ("click", "view"))
    joined = temporal.rebase(as_of(clicks, views, ["user_id"]), ["user_id"])
    return joined.groupBy("user_id").agg(F.count("*").alias("clicks"), F.count("matched").alias("after_view"), F.max("ts_us").alias("span_us"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum(F.col("matched")["value"]), 4).alias("seen"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in CATALOGUE.items() if q.sql}
