"""Edits of a stream along time: clip, shift, fade, loop, limit, select."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.ordered import Run, join_on, numbered, scan
from rivulet.schema import SECOND

TS = "ts_us"


def _us(seconds: float) -> int:
    return round(seconds * SECOND)


def trim(df: DataFrame, start: float = 0.0, end: float | None = None, duration: float | None = None, ts: str = TS) -> DataFrame:
    """Rows in [start, end), times unchanged; ``duration`` is the other way to give the end."""
    end = start + duration if duration is not None else end
    df = df.where(F.col(ts) >= _us(start))
    return df if end is None else df.where(F.col(ts) < _us(end))


def time_range(df: DataFrame, start_us: int, end_us: int, *, copyts: bool = False, ts: str = TS) -> DataFrame:
    """An accurate seek: rows in [start, end), times from the start on unless copyts."""
    df = df.where((F.col(ts) >= start_us) & (F.col(ts) < end_us))
    return df if copyts else df.withColumn(ts, F.col(ts) - start_us)


def clips(df: DataFrame, durations: list[int], ts: str = TS) -> DataFrame:
    """Rows of each interval of [s0, e0, s1, e1, ...], with clip_id; an odd or falling list is logged and ignored (clip_id is null)."""
    if len(durations) % 2 or any(a > b for a, b in zip(durations, durations[1:])):
        logging.getLogger("rivulet").error("durations must have an even number of values that never fall: %s", durations)
        return df.withColumn("clip_id", F.lit(None).cast("int"))
    ids = [F.when((F.col(ts) >= a) & (F.col(ts) < b), k) for k, (a, b) in enumerate(zip(durations[::2], durations[1::2]))]
    return df.withColumn("clip_id", F.explode(F.filter(F.array(*ids), lambda x: x.isNotNull())))


def shift(df: DataFrame, us: int | Column, ts: str = TS) -> DataFrame:
    return df.withColumn(ts, F.col(ts) + us)


def stretch(df: DataFrame, factor: float, ts: str = TS) -> DataFrame:
    return df.withColumn(ts, (F.col(ts) * factor).cast("long"))


def rebase(df: DataFrame, keys: list[str], ts: str = TS) -> DataFrame:
    """Times from each stream's first row on.

    The first times are one row a key, joined back: no stream is gathered.
    """
    first = df.groupBy(*keys).agg(F.min(ts).alias("_first"))
    return join_on(df, first, keys).withColumn(ts, F.col(ts) - F.col("_first")).drop("_first")


def delay(df: DataFrame, ms: int, ts: str = TS) -> DataFrame:
    return shift(df, ms * 1000, ts)


def delay_with_silence(df: DataFrame, keys: list[str], ms: int, frame_us: int, value: str = "value", ts: str = TS, seq: str = "seq") -> DataFrame:
    """The rows ``ms`` later, and before them rows of value 0 at every ``frame_us`` from each stream's first time on (seq below 0)."""
    starts = df.groupBy(*keys).agg(F.min(ts).alias("_first")).where("_first is not null")
    n = -(-ms * 1000 // frame_us)
    silent = starts.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)) if n > 0 else F.array().cast("array<int>")))
    made = {ts: F.col("_first") + F.col("_k") * frame_us, seq: F.col("_k") - n, value: F.lit(0)}
    types = dict(df.dtypes)
    rows = silent.select(*[F.col(c) if c in keys else made.get(c, F.lit(None)).cast(types[c]).alias(c) for c in df.columns])
    return rows.unionAll(delay(df, ms, ts))


def fade(df: DataFrame, kind: str, start: float, duration: float, value: str = "value", ts: str = TS) -> DataFrame:
    """A linear gain: from 0 to 1 (in) or 1 to 0 (out) over ``duration`` from ``start`` on."""
    rise = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(ts) - _us(start)) / _us(duration)))
    return df.withColumn(value, F.col(value) * (rise if kind == "in" else 1 - rise))


def volume(df: DataFrame, gain: float, value: str = "value") -> DataFrame:
    return df.withColumn(value, F.col(value) * gain)


def sample_volume(df: DataFrame, gain: float, samples: str = "samples") -> DataFrame:
    return df.withColumn(samples, F.transform(samples, lambda x: x * gain))


def limit(df: DataFrame, keys: list[str], n: int, order: tuple[str, ...] = (TS, "seq"), *, spread: bool = False) -> DataFrame:
    """The first n rows of each stream."""
    if n < 0:
        raise ValueError("a limit is not negative")
    return numbered(df, keys, order, "_rn", spread=spread).where(F.col("_rn") <= n).drop("_rn")


def default_fps(df: DataFrame, keys: list[str], fps: int = 25, ts: str = TS, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """A missing or repeated time becomes that of the row before and a frame's length."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(ts, F.when(F.col(ts).isNull() | (F.col(ts) == before), before + SECOND // fps).otherwise(F.col(ts)))


def extract(df: DataFrame, keys: list[str], fps: float, ts: str = TS, seq: str = "seq") -> DataFrame:
    """One row, the first, for each slot of 1 / fps seconds that has rows; its time is the slot's."""
    slot = F.round(F.col(ts) * F.lit(fps) / SECOND).cast("long")
    row = F.struct(ts, seq, *[c for c in df.columns if c not in (ts, seq)])
    picked = df.groupBy(*keys, slot.alias("slot")).agg(F.min_by(row, F.struct(ts, seq)).alias("_row"))
    return picked.select("slot", "_row.*").withColumn(ts, (F.col("slot") * SECOND / F.lit(fps)).cast("long"))


#: Frame classes that a discard level drops.
SKIP = {-16: [], 0: [], 8: ["nonref"], 16: ["nonref", "bidir"], 24: ["nonref", "bidir", "inter"], 32: ["nonref", "bidir", "inter", "nonkey"], 48: None}


def skip_frames(df: DataFrame, level: int, column: str = "frame_class") -> DataFrame:
    dropped = SKIP[level]
    return df.where(F.lit(False)) if dropped is None else df.where(~F.coalesce(F.col(column).isin(dropped), F.lit(False)))


def max_size(df: DataFrame, most: int, width: str = "width", height: str = "height", max_hits: int | None = None) -> DataFrame:
    """Rows of which both sides are under ``most``; ``max_hits`` others or more are an error when the plan runs."""
    fits = (F.col(width) < most) & (F.col(height) < most)
    if max_hits is None:
        return df.where(fits)
    hits = df.where(~fits).agg(F.count("*").alias("_hits"))  # one row
    fine = F.when(F.col("_hits") < max_hits, True).otherwise(F.raise_error(F.concat(F.col("_hits").cast("string"), F.lit(f" rows reach {most}"))).cast("boolean"))
    return df.where(fits).crossJoin(F.broadcast(hits)).where(fine).drop("_hits")


def loop(df: DataFrame, keys: list[str], size: int, times: int, period_us: int, ts: str = TS, order: tuple[str, ...] = (TS, "seq"), *, spread: bool = False) -> DataFrame:
    """The first ``size`` rows of each stream ``times`` more often, each time ``period_us`` later, then the rest."""
    head = numbered(df, keys, order, "_rn", spread=spread).withColumn("loop_no", F.explode(F.when(F.col("_rn") <= size, F.sequence(F.lit(0), F.lit(times))).otherwise(F.array(F.lit(times)))))
    return head.withColumn(ts, F.col(ts) + F.col("loop_no") * period_us).drop("_rn")


def scene_changes(df: DataFrame, keys: list[str], threshold: float, value: str = "value", order: tuple[str, ...] = (TS, "seq"), *, spread: bool = False) -> DataFrame:
    """Rows whose value differs from the one before by more than the threshold."""
    seen = scan(df, keys, order, {"_before": Run("last", F.col(value), "before")}, spread=spread)
    return seen.withColumn("score", F.abs(F.col(value) - F.col("_before"))).where(F.col("score") > threshold).drop("_before")


def frame_numbers(df: DataFrame, node: list[str], order: tuple[str, ...] = (TS, "seq"), *, spread: bool = False) -> DataFrame:
    """One counter from 1 for all streams of a node."""
    return numbered(df, node, order, "stream_frame_number", spread=spread)


def with_metadata(df: DataFrame, column: str = "metadata", **values: Column) -> DataFrame:
    new = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return df.withColumn(column, F.map_concat(F.map_filter(F.coalesce(F.col(column), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(list(values))), new))
