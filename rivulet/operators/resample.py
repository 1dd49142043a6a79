"""Frame-rate and sample-rate changes, and sampling."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.operators.ordered import Run, as_of, numbered, scan
from rivulet.operators.sorted_fold import fold_sorted
from rivulet.operators.temporal import extract
from rivulet.schema import SECOND

TS, SEQ = "ts_us", "seq"


def slots(df: DataFrame, fps: float, ts: str = TS) -> DataFrame:
    """Every row with its slot, the time rounded to the rate (pass-through)."""
    return df.withColumn("slot", F.round(F.col(ts) * F.lit(fps) / SECOND).cast("long"))


def constant_rate(df: DataFrame, keys: list[str], step_us: int, ts: str = TS, seq: str = SEQ, *, spread: bool = False) -> DataFrame:
    """A row at each step from each stream's first time to its last, with the latest row at or before it."""
    span = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    grid = span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.lit(step_us))).alias(ts)).withColumn(seq, F.lit(0).cast("long"))
    return as_of(grid, df, keys, ts=ts, seq=seq, payload="row", spread=spread).drop(seq)


def variable_rate(df: DataFrame, keys: list[str], fps: float, ts: str = TS, seq: str = SEQ) -> DataFrame:
    """At most one row, the first, for each slot."""
    return extract(df, keys, fps, ts, seq)


def audio_fifo(df: DataFrame, keys: list[str], samples: str, size: int, rate: float, order: tuple[str, ...] = (SEQ,), *, spread: bool = False) -> DataFrame:
    """The samples of a stream cut anew into frames of ``size``; the last may be short.

    pts is the whole microseconds of the samples before.  Running sums of lengths
    place each chunk; what is shuffled are its slices, one for each frame it overlaps.
    """
    n = F.size(samples).cast("long")
    placed = scan(df, keys, order, {"_before": Run("sum", n, "before")}, spread=spread)
    first, last = F.floor(F.col("_offset") / size).cast("long"), F.floor((F.col("_offset") + n - 1) / size).cast("long")
    each = placed.where(n > 0).withColumn("_offset", F.coalesce("_before", F.lit(0)).cast("long"))
    each = each.select(*keys, "_offset", F.col(samples), F.explode(F.sequence(first, last)).alias("frame"))
    low = F.greatest(F.col("frame") * size, F.col("_offset")) - F.col("_offset")
    high = F.least((F.col("frame") + 1) * size - F.col("_offset"), n)
    parts = each.select(*keys, "frame", F.struct((low + F.col("_offset")).alias("at"), F.slice(samples, (low + 1).cast("int"), (high - low).cast("int")).alias("x")).alias("_part"))
    frames = parts.groupBy(*keys, "frame").agg(F.flatten(F.transform(F.array_sort(F.collect_list("_part")), lambda p: p["x"])).alias(samples))
    return frames.select(*keys, "frame", F.floor(F.col("frame") * size * SECOND / F.lit(rate)).cast("long").alias("pts_us"), samples)


def segment_ticks(df: DataFrame, duration: str) -> DataFrame:
    """Intervals (seconds) to look at: none of a clip under 24 s (all of it counts), 6 of 4 s up to 600 s, else 8 over at most 1000 s.

    Where 6 or 8 intervals would lie under half a second apart, the whole clip is one.
    """
    d = F.col(duration)
    n = F.when(d < 24, 0).when(d <= 600, 6).otherwise(8)
    total = F.when(d > 600, F.least(d, F.lit(1000.0))).otherwise(d)
    gap = (total - n * 4) / (n - 1)
    spread_out = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.round(k * (gap + 4), 3).alias("start"), F.round(k * (gap + 4) + 4, 3).alias("end")))
    whole = F.array(F.struct(F.lit(0.0).alias("start"), F.round(d, 3).alias("end")))
    return df.withColumn("ticks", F.when(n == 0, F.filter(whole, lambda _: F.lit(False))).when(gap < 0.5, whole).otherwise(spread_out))


#: Slots of lateness: what a constant rate forgives, and from where a variable rate keeps or moves a frame.
STEADY_SLACK, LOOSE_SLACK, FIRST_SLACK = 1.1, 0.6, 0.5
#: A frame may be repeated so often (30 hours at 30 a second).
MOST_COPIES = 30 * 3600 * 30
_NUDGE = 2.0**-17


class RateClock:
    """One stream's output slots.

    A frame covers the interval [at, at + length) of the slot axis; slots are filled
    in turn, ``slot`` being the next.  What a frame fills follows from where its
    interval lies:

    * constant rate: slots up to the interval's end, rounded, at least one; none if
      the end lies over STEADY_SLACK before the next slot.  Slots well before the
      interval's start (rounded after LOOSE_SLACK is taken off) show the frame before.
    * constant rate from the first frame ("vscfr"): likewise, but the first frame
      moves the slots to itself if it comes FIRST_SLACK late.
    * variable rate: one slot, the one nearest to the start if the end lies over
      LOOSE_SLACK after the next slot; none if it lies that far before it.
    * passthrough, drop: the slot nearest to the start.

    A frame that begins before the next slot and ends after it is clipped to it.
    At the end the last frame fills as many slots as the median of the last three
    counts of frames shown again, or what is missing to ``min_frames``.
    """

    def __init__(self, method: str, max_frames: int | None = None, min_frames: int = 0):
        if method not in _FILLS:
            raise ValueError(method)
        self.fill, self.max_frames, self.min_frames = _FILLS[method], max_frames, min_frames
        self.slot = self.emitted = self.read = self.dropped = self.duplicated = 0
        self.again: deque[int] = deque([0, 0, 0], 3)
        self.shown: tuple | None = None  # the frame before
        self.pending = False  # it has not been shown

    def feed(self, frame: tuple, at: float, length: float) -> list[tuple[int, tuple, int, bool]]:
        """(first slot, frame, number of slots, whether it is shown again) of what comes out."""
        self.read += 1
        at += np.sign(at) * _NUDGE
        slot, again, copies = self.fill(self, float(at), float(length))
        out = self._put(slot, copies, again, frame)
        if out is not None:
            self.shown = frame
        return out or []

    def end(self) -> list[tuple[int, tuple, int, bool]]:
        n = sorted(self.again)[1]
        if 0 < self.min_frames and self.emitted <= self.min_frames:
            n = self.min_frames - self.emitted
        return self._put(self.slot, n, n, None) or []

    def _put(self, slot: int, copies: int, again: int, frame: tuple | None) -> list | None:
        if self.max_frames is not None:
            copies = min(copies, self.max_frames - self.emitted)
        again = min(again, copies)
        self.again.appendleft(again)
        self.slot = slot
        self.dropped += again == 0 and self.pending
        wanted = (again > 0 and self.pending) + (copies > again)  # slots that show a frame for the first time
        if copies > max(wanted, MOST_COPIES):
            self.dropped += 1
            return None
        self.duplicated += max(0, copies - wanted)
        self.pending = copies == again and frame is not None
        runs = [(slot, self.shown or frame, again, self.shown is not None), (slot + again, frame, copies - again, False)]
        self.slot, self.emitted = slot + copies, self.emitted + copies
        return [r for r in runs if r[2] > 0 and r[1] is not None]


def _rounded(x: float) -> int:
    return int(np.rint(x))


def _steady(clock: RateClock, at: float, length: float) -> tuple[int, int, int]:
    """The next slot, how many show the frame before, how many in all."""
    lag, reach = at - clock.slot, at + length - clock.slot
    if lag < 0 < reach:
        lag = 0.0
    return clock.slot, max(0, _rounded(lag - LOOSE_SLACK)), 0 if reach < -STEADY_SLACK else max(1, _rounded(reach))


def _steady_from_first(clock: RateClock, at: float, length: float) -> tuple[int, int, int]:
    if clock.emitted == 0 and at - clock.slot >= FIRST_SLACK:
        return _rounded(at), 0, max(1, _rounded(length))
    return _steady(clock, at, length)


def _loose(clock: RateClock, at: float, length: float) -> tuple[int, int, int]:
    reach = at + length - clock.slot
    start = max(at, float(clock.slot)) if reach > 0 else at
    return (_rounded(start) if reach > LOOSE_SLACK else clock.slot), 0, int(reach > -LOOSE_SLACK)


def _nearest(clock: RateClock, at: float, length: float) -> tuple[int, int, int]:
    return _rounded(at), 0, 1


_FILLS = {"cfr": _steady, "vscfr": _steady_from_first, "vfr": _loose, "passthrough": _nearest, "drop": _nearest}


class _Resync:
    """The clock fed with times and lengths in microseconds; ``report`` asks for the counters alone."""

    def __init__(self, clock: RateClock, rate: float, length: float, report: bool):
        self.clock, self.rate, self.length, self.report = clock, rate, length, report

    def feed(self, ts: int, seq: int, seconds: float | None = None) -> list[tuple]:
        own = _rounded(seconds * self.rate) if seconds is not None else 0
        return self._rows(self.clock.feed((seq,), ts * self.rate / SECOND, own if own > 0 else self.length))

    def end(self) -> list[tuple]:
        out, c = self._rows(self.clock.end()), self.clock
        return [(c.read, c.emitted, c.dropped, c.duplicated)] if self.report else out

    def _rows(self, runs: list[tuple[int, tuple, int, bool]]) -> list[tuple]:
        return [] if self.report else [(slot, frame[0], n, again) for slot, frame, n, again in runs]


def _fold(df: DataFrame, keys: list[str], method: str, rate: float, duration: str | None, max_frames: int | None, min_frames: int, input_rate: float | None, ts: str, seq: str, report: bool) -> DataFrame:
    length = rate / input_rate if input_rate else 1.0
    fields = [ts, seq, *([duration] if duration else [])]
    RateClock(method)  # a wrong method is an error of the plan
    out = "frames_in long, frames_out long, dropped long, duplicated long" if report else "first long, seq long, n long, repeated boolean"
    return fold_sorted(df.where(F.col(ts).isNotNull()), keys, [ts, seq], fields, lambda: _Resync(RateClock(method, max_frames, min_frames), rate, length, report), out)


def resync(df: DataFrame, keys: list[str], method: str, rate: float, *, duration: str | None = None, max_frames: int | None = None, min_frames: int = 0, input_rate: float | None = None, ts: str = TS, seq: str = SEQ) -> DataFrame:
    """Exact rate conversion (see ``RateClock``): keys, slot, seq of the frame shown, repeated.

    ``duration`` names a column with a frame's length in seconds (else, or where it
    rounds to no slot, that of ``input_rate``, else one slot).  The fold gives a row for
    each run of slots; they are counted out in the JVM.  Rows without a time are left out.
    """
    runs = _fold(df, keys, method, rate, duration, max_frames, min_frames, input_rate, ts, seq, False)
    return runs.select(*keys, F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"), F.col("seq").alias("seq"), "repeated")


def resync_report(df: DataFrame, keys: list[str], method: str, rate: float, *, duration: str | None = None, max_frames: int | None = None, min_frames: int = 0, input_rate: float | None = None, ts: str = TS, seq: str = SEQ) -> DataFrame:
    """keys, frames_in, frames_out, dropped, duplicated of the same conversion."""
    return _fold(df, keys, method, rate, duration, max_frames, min_frames, input_rate, ts, seq, True)


def output_rate_mode(container: str, *, variable_rate: bool = False, no_timestamps: bool = False, copy_ts: bool = False, max_rate: float | None = None) -> str:
    """What "auto" means: avi and a given ``max_rate`` have a variable rate; containers of variable rate too, or none to change if
    they have no times; others a constant one, from the first frame where times are copied."""
    if max_rate is not None or container == "avi":
        return "vfr"
    if variable_rate:
        return "passthrough" if no_timestamps else "vfr"
    return "vscfr" if copy_ts else "cfr"


class _Apart:
    def __init__(self, at: int, gap_us: int):
        self.at, self.gap_us, self.last = at, gap_us, None

    def feed(self, *row: object) -> list[tuple]:
        if row[self.at] is None or (self.last is not None and row[self.at] < self.last + self.gap_us):
            return []
        self.last = row[self.at]
        return [row]

    def end(self) -> list[tuple]:
        return []


def at_least_apart(df: DataFrame, keys: list[str], gap_us: int, ts: str = TS, seq: str = SEQ) -> DataFrame:
    """Rows at least ``gap_us`` after the last one taken (a greedy fold over each stream)."""
    rest = [f for f in df.schema if f.name not in keys]
    names = [f.name for f in rest]
    at = names.index(ts)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return fold_sorted(df, keys, [ts, seq], names, lambda: _Apart(at, gap_us), out).select(*df.columns)


def resample_audio(df: DataFrame, samples: str, from_rate: float, to_rate: float) -> DataFrame:
    """Linear interpolation to another rate (no band filter)."""

    @F.pandas_udf("array<double>")
    def change(s: pd.Series) -> pd.Series:
        def one(x) -> list[float] | None:
            if x is None:
                return None
            n = int(np.floor(len(x) * to_rate / from_rate))
            return np.interp(np.arange(n) * from_rate / to_rate, np.arange(len(x)), x).tolist() if len(x) else []

        return s.map(one)

    return df.withColumn(samples, change(F.col(samples)))


def ticks(spark, lo_us: int, hi_us: int, step_us: int, name: str = TS) -> DataFrame:
    """Clock times from lo to hi."""
    return spark.range(lo_us, hi_us + 1, step_us).withColumnRenamed("id", name)


def row_slots(df: DataFrame, keys: list[str], fps: float, order: tuple[str, ...] = (TS, SEQ), *, spread: bool = False) -> DataFrame:
    """Times n / fps by row number from 0."""
    return numbered(df, keys, order, "_n", spread=spread).withColumn("clock_us", ((F.col("_n") - 1) * SECOND / F.lit(fps)).cast("long")).drop("_n")
