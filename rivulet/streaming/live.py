"""Live runs on Structured Streaming: pushed input, bounded micro-batches, state, jobs, resets.

Results equal those of the batch operators as long as each key's rows arrive in
order across micro-batches (the as-of join takes a delay); inside one they are sorted.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rivulet.operators.folds import JitterBuffer
from rivulet.plans.graph import Graph

TS, SEQ = "ts_us", "seq"
#: Added to times before they bound a stream: Spark drops rows at or before 1970 as late.
_SHIFT = 10**15


def push(df: DataFrame, path: str) -> None:
    """Hand rows to a running stream: they are files in a watched folder."""
    df.write.mode("append").parquet(path)


def source(spark: SparkSession, path: str, schema, *, queue_limit: int = 5) -> DataFrame:
    """Pushed rows as a stream; at most ``queue_limit`` files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", queue_limit).parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append", timeout: float | None = None) -> DataFrame:
    """Run a stream over all that is there, into a table; an error of the query is raised here."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    if query.awaitTermination(timeout) is False:
        query.stop()
        raise TimeoutError(f"nothing was finished in {timeout} s")
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def bounded(stream: DataFrame, event_time: str, delay: str = "0 seconds") -> DataFrame:
    """A watermark: of several streams the least bound holds, and later rows are dropped."""
    stream.sparkSession.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    return stream.withWatermark(event_time, delay)


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], value: str, ts: str = TS, seq: str = SEQ, *, delay: str = "1 millisecond") -> DataFrame:
    """Left rows (keys, ts, seq) with seq and value of the latest right row at or before them.

    A left row waits until both sides have come past its time by ``delay``, so that the match is that of the batch
    form however the sides interleave and up to ``delay`` out of order; later rows are dropped, as are those
    without a time.  What waits when both sides fall silent is given when a later row of any key moves the bound.
    A key holds the right rows of the last ``delay``, one before them, and its waiting left rows.
    """
    names = [*keys, ts, seq, "right_seq", "right_value"]
    side = lambda df, is_left, v: bounded(df.where(F.col(ts).isNotNull()).select(*keys, ts, seq, F.lit(is_left).alias("is_left"), v.cast("double").alias("v"), F.timestamp_micros(F.col(ts) + _SHIFT).alias("at")), "at", delay)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, waiting = [], []
        if state.exists:
            times, seqs, values, left_times, left_seqs = map(list, state.get)
            known, waiting = list(zip(times, seqs, values)), list(zip(left_times, left_seqs))
        if not state.hasTimedOut:
            for rows in frames:
                for t, s, is_left, v in zip(rows[ts].tolist(), rows[seq].tolist(), rows["is_left"].tolist(), rows["v"].tolist()):
                    waiting.append((t, s)) if is_left else known.append((t, s, v))
        known.sort(key=lambda r: r[:2])
        waiting.sort()
        bound = state.getCurrentWatermarkMs() * 1000 - _SHIFT
        places, out = [r[0] for r in known], []
        ready = bisect_right(waiting, bound, key=lambda r: r[0])
        for t, s in waiting[:ready]:
            k = bisect_right(places, t)
            found = known[k - 1][1:] if k else (None, None)
            out.append((*key, t, s, found[0], None if pd.isna(found[1]) else found[1]))
        known, waiting = known[max(0, bisect_right(places, bound) - 1) :], waiting[ready:]
        state.update((*([r[k] for r in known] for k in range(3)), *([r[k] for r in waiting] for k in range(2))))
        if waiting:
            state.setTimeoutTimestamp(-(-(waiting[0][0] + _SHIFT) // 1000) - 1)
        yield pd.DataFrame(out, columns=names).astype({"right_seq": "Int64", "right_value": "float64"})

    both = side(left, True, F.lit(None)).unionAll(side(right, False, F.col(value)))
    held = "times array<long>, seqs array<long>, vals array<double>, left_times array<long>, left_seqs array<long>"
    schema = f"{_fields(left, keys)}, {ts} long, {seq} long, right_seq long, right_value double"
    return both.groupBy(*keys).applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.EventTimeTimeout)


def at_least_apart(stream: DataFrame, keys: list[str], gap_us: int, ts: str = TS, seq: str = SEQ) -> DataFrame:
    """Rows (keys, ts, seq) at least ``gap_us`` after the last one taken."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values([ts, seq])
        (last,), out = state.getOption or (None,), []
        for t, s in zip(rows[ts].tolist(), rows[seq].tolist()):
            if last is None or t >= last + gap_us:
                out.append((*key, t, s))
                last = t
        state.update((last,))
        yield pd.DataFrame(out, columns=[*keys, ts, seq])

    return stream.select(*keys, ts, seq).groupBy(*keys).applyInPandasWithState(step, f"{_fields(stream, keys)}, {ts} long, {seq} long", "last long", "append", GroupStateTimeout.NoTimeout)


def jitter_buffer(stream: DataFrame, keys: list[str], ticks_us: int, *, arrival: str = "arrival_us", ts: str = TS, seq: str = SEQ, idle_ms: int | None = None, **options) -> DataFrame:
    """keys, tick, seq shown, for the ticks up to the latest arrival of each micro-batch.

    A row without a time is the end of its source: what is left is shown, as the batch form does after the last
    arrival, and a row after it begins a new source.  With ``idle_ms``, a source that sends nothing for so long has ended.
    """
    names = [*keys, "tick", "seq"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, tick, out = JitterBuffer(**options), None, []
        if state.exists:
            tick, buffer.offset, buffer.streaming, buffer.last, times, cached = state.get
            buffer.times, buffer.rows = list(times), list(cached)

        def show() -> None:
            nonlocal tick
            out.append((*key, tick, buffer.get(tick)))
            tick += ticks_us

        def finish() -> None:
            nonlocal tick, buffer
            buffer.end()
            while buffer.times:
                show()
            buffer, tick = JitterBuffer(**options), None

        if state.hasTimedOut:
            finish()
        else:
            rows = pd.concat(list(frames)).sort_values([arrival, "ends", seq])
            for at, t, s, ends in zip(rows[arrival].tolist(), rows[ts].tolist(), rows[seq].tolist(), rows["ends"].tolist()):
                if ends:
                    finish()
                    continue
                tick = at if tick is None else tick
                while tick < at:
                    show()
                buffer.put(t, s)
        if tick is not None:
            state.update((tick, buffer.offset, buffer.streaming, buffer.last, buffer.times, buffer.rows))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names).astype({"seq": "Int64"})

    ends = F.col(ts).isNull()
    rows = stream.select(*keys, arrival, F.coalesce(ts, F.lit(0)).alias(ts), F.when(ends, F.lit(0)).otherwise(F.col(seq)).cast("long").alias(seq), ends.alias("ends"))
    held = "tick long, offset long, streaming boolean, last long, times array<long>, cached array<long>"
    limit = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy(*keys).applyInPandasWithState(step, f"{_fields(stream, keys)}, tick long, seq long", held, "append", limit)


def with_resets(stream: DataFrame, work: Callable[[DataFrame, dict[str, str]], DataFrame], control: str, path: str, checkpoint: str):
    """A running query whose options are read anew from a control table (key, value, version) before each micro-batch.

    Each batch is a partition of ``path`` of its own (batch_no) and replaces it, so a batch that is tried again leaves its rows once.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        newest = spark.read.parquet(control).groupBy("key").agg(F.max_by("value", "version").alias("value"))
        options = {r.key: r.value for r in newest.collect()}  # one row for each option name
        work(df, options).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_no={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Calls a function with the rows of each finished micro-batch (driver side)."""

    def __init__(self, tell: Callable[[int, int], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.tell(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


class Gateway:
    """Server mode: a graph that stays, jobs that come; results by name, all, or first in first out."""

    def __init__(self, spark: SparkSession, graph: Graph):
        self.spark, self.graph = spark, graph
        self.results: dict[str, dict[str, DataFrame]] = {}
        self.waiting: deque[str] = deque()
        self.open = True

    def process_work(self, name: str, **inputs: DataFrame) -> str:
        """Plan a job; it runs when its result is used."""
        if not self.open:
            raise RuntimeError("the gateway is closed")
        self.results[name] = self.graph.run(self.spark, **inputs)
        self.waiting.append(name)
        return name

    def request(self, name: str) -> dict[str, DataFrame]:
        self.waiting.remove(name)
        return self.results.pop(name)

    def request_next(self) -> tuple[str, dict[str, DataFrame]] | None:
        if not self.waiting:
            return None
        name = self.waiting.popleft()
        return name, self.results.pop(name)

    def request_all(self) -> dict[str, dict[str, DataFrame]]:
        out, self.results = self.results, {}
        self.waiting.clear()
        return out

    def close(self) -> None:
        self.open = False
