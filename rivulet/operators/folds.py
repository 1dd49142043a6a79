"""Sequential recurrences over a stream, as small state machines.

Each machine is a class fed row by row, so that the batch form (a fold over each
group) and the streaming form (state kept between micro-batches) share it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.operators.sorted_fold import fold_sorted
from rivulet.schema import SECOND

TS, SEQ = "ts_us", "seq"


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)


class ClockRepair:
    """Time stamps made continuous: counter wraps are undone, jumps taken out.

    A time is expected where the one before ended.  In a discontinuous format a
    jump over ``jump_us``, or backwards by over ``back_us``, moves all that follows;
    otherwise a jump of over 30 hours makes the time unknown.
    """

    def __init__(self, discontinuous: bool = True, wrap: int | None = None, jump_us: int = 10 * SECOND, back_us: int = SECOND // 10, lost_us: int = 30 * 3600 * SECOND):
        self.discontinuous, self.wrap = discontinuous, wrap
        self.jump_us, self.back_us, self.lost_us = jump_us, back_us, lost_us
        self.turns = self.offset = 0
        self.raw: int | None = None
        self.expected: int | None = None

    def feed(self, ts: int | None, duration: int = 0) -> int | None:
        if ts is None:
            return None
        if self.wrap and self.raw is not None:
            if ts < self.raw - self.wrap // 2:
                self.turns += 1
            elif ts > self.raw + self.wrap // 2 and self.turns:
                self.turns -= 1
        self.raw = ts
        out = ts + self.turns * (self.wrap or 0) + self.offset
        if self.expected is not None:
            jump = out - self.expected
            if self.discontinuous and (abs(jump) > self.jump_us or jump < -self.back_us):
                self.offset -= jump
                out -= jump
            elif not self.discontinuous and abs(jump) > self.lost_us:
                return None
        self.expected = out + duration
        return out


def pts_repair(df: DataFrame, keys: list[str], *, ts: str = TS, seq: str = SEQ, duration: str | None = None, **options) -> DataFrame:
    """df with ``fixed_us``."""
    rest = [c for c in df.columns if c not in keys]
    at, length = rest.index(ts), rest.index(duration) if duration else None

    class Repair:
        def __init__(self) -> None:
            self.clock = ClockRepair(**options)

        def feed(self, *row: object) -> list[tuple]:
            return [(*row, self.clock.feed(row[at], 0 if length is None else int(row[length] or 0)))]

        def end(self) -> list[tuple]:
            return []

    return fold_sorted(df, keys, [seq], rest, Repair, f"{_fields(df, rest)}, fixed_us long").select(*df.columns, "fixed_us")


def connection_bases(starts: list[int], lengths: list[int], cut_off_us: int, interval_us: int) -> list[tuple[int, int | None]]:
    """For each connection its base time, and the last time put out before it."""
    out, last = [], None
    for start, length in zip(starts, lengths):
        base = start if last is None or last < start < last + cut_off_us else last + interval_us
        out.append((base, last))
        last = base + length if last is None else max(last, base + length)
    return out


def live_repair(df: DataFrame, keys: list[str], connection: str, start: str, *, ts: str = TS, cut_off_us: int = 10 * SECOND, interval_us: int = SECOND // 30) -> DataFrame:
    """Rows of reconnected live streams on one clock; what does not pass the last output is dropped.

    ``ts`` counts from the connection's ``start``.  Only one row for each
    connection is folded; the rows themselves are joined back.
    """
    spans = df.groupBy(*keys, connection).agg(F.min(start).alias("_start"), F.max(ts).alias("_length"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(connection)
        found = connection_bases(pdf["_start"].tolist(), pdf["_length"].tolist(), cut_off_us, interval_us)
        return pdf[[*keys, connection]].assign(_base=[b for b, _ in found], _last=pd.array([x for _, x in found], "Int64"))

    bases = spans.groupBy(*keys).applyInPandas(fold, _fields(df, [*keys, connection]) + ", _base long, _last long")
    bases = bases.select(*keys, connection, "_base", "_last")
    moved = df.join(bases, [*keys, connection]).withColumn(ts, F.col(ts) + F.col("_base"))
    return moved.where(F.col("_last").isNull() | (F.col(ts) > F.col("_last"))).select(*df.columns)


class JitterBuffer:
    """A cache that starts to give rows when it holds enough, and fills up again when it runs low.

    ``put`` adds a row; ``get`` gives the row for a tick: the last one at or before
    it, dropping those before.  On the tick at which streaming begins, the first cached
    row is bound to that tick, but rows are given from the next one on.  Video repeats
    its last row while there is none; audio gives nothing.
    """

    def __init__(self, video: bool = True, high_us: int = 600_000, low_us: int = 400_000):
        self.video, self.high_us, self.low_us = video, high_us, low_us
        self.times: list[int] = []
        self.rows: list[object] = []
        self.offset = 0
        self.streaming = self.ended = False
        self.last: object | None = None

    def put(self, ts: int, row: object) -> None:
        self.times.append(ts)
        self.rows.append(row)

    def end(self) -> None:
        self.ended = True

    def cached_us(self) -> int:
        return self.times[-1] - self.times[0] if self.times else 0

    def get(self, tick: int) -> object | None:
        if not self.streaming and self.times and (self.cached_us() > self.high_us or self.ended):
            self.streaming, self.offset = True, tick - self.times[0]
            return self.last if self.video else None
        if self.streaming and self.cached_us() < self.low_us and not self.ended:
            self.streaming = False
        if not self.streaming or not self.times:
            return self.last if self.video else None
        k = bisect_right(self.times, tick - self.offset)
        if k == 0:
            return self.rows[0]
        self.last = self.rows[k - 1]
        del self.times[:k], self.rows[:k]
        return self.last


def jitter_buffer(df: DataFrame, keys: list[str], ticks_us: int, *, arrival: str = "arrival_us", ts: str = TS, seq: str = SEQ, **options) -> DataFrame:
    """keys, tick, seq of the row shown: ticks from each source's first arrival until its last row is shown."""

    class Ticks:
        def __init__(self) -> None:
            self.buffer, self.tick = JitterBuffer(**options), None

        def feed(self, at: int, time: int, row: object) -> Iterator[tuple]:
            self.tick = at if self.tick is None else self.tick
            while self.tick < at:
                yield self._get()
            self.buffer.put(time, row)

        def end(self) -> Iterator[tuple]:
            self.buffer.end()
            while self.buffer.times:
                yield self._get()

        def _get(self) -> tuple:
            now, self.tick = self.tick, self.tick + ticks_us
            return now, self.buffer.get(now)

    return fold_sorted(df, keys, [arrival, seq], [arrival, ts, seq], Ticks, "tick long, seq long")


def fold_groups(df: DataFrame, keys: list[str], order: list[str], machine: Callable[[], Callable[[dict], list[dict]]], schema: str) -> DataFrame:
    """Any machine over each group: made anew for each, fed dicts in order, giving dicts."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        feed, rows = machine(), []
        for row in pdf.sort_values(order).to_dict("records"):
            rows += feed(row)
        return pd.DataFrame(rows)

    return df.groupBy(*keys).applyInPandas(fold, schema)
