"""A fluent, lazy stream: a DataFrame with its keys and order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rivulet.operators import aggregate, align, combine, convert, resample, temporal, windows
from rivulet.operators.ordered import as_of
from rivulet.sources import sinks


@dataclass(frozen=True)
class Stream:
    """Rows of one or several streams told apart by ``keys``, in order of ts_us, then seq.

    ``spread`` says that a key may hold a large share of all rows.
    """

    df: DataFrame
    keys: tuple[str, ...] = ("stream_id",)
    spread: bool = False

    def _with(self, df: DataFrame) -> Stream:
        return replace(self, df=df)

    @property
    def _k(self) -> list[str]:
        return list(self.keys)

    # rows and projections
    def __getitem__(self, name: str) -> Stream:
        """The stream of that id."""
        return self._with(self.df.where(F.col(self.keys[0]) == name))

    def pass_through(self) -> Stream:
        return self

    def apply(self, f: Callable[..., DataFrame], *args, **named) -> Stream:
        """Any function of a DataFrame."""
        return self._with(f(self.df, *args, **named))

    def filter(self, condition) -> Stream:
        return self._with(self.df.where(condition))

    def volume(self, gain: float, value: str = "value") -> Stream:
        return self._with(temporal.volume(self.df, gain, value))

    def afade(self, kind: str, start: float, duration: float, value: str = "value") -> Stream:
        return self._with(temporal.fade(self.df, kind, start, duration, value))

    # time
    def trim(self, start: float = 0.0, end: float | None = None, duration: float | None = None) -> Stream:
        return self._with(temporal.trim(self.df, start, end, duration))

    atrim = trim

    def setpts(self, expression: str = "PTS-STARTPTS") -> Stream:
        """``PTS-STARTPTS``, ``PTS+x/TB`` (x in seconds) or ``k*PTS``."""
        e = expression.replace(" ", "")
        if e == "PTS-STARTPTS":
            return self._with(temporal.rebase(self.df, self._k))
        if e.startswith("PTS+") and e.endswith("/TB"):
            return self._with(temporal.shift(self.df, round(float(e[4:-3]) * 1_000_000)))
        if e.endswith("*PTS"):
            return self._with(temporal.stretch(self.df, float(e[:-4])))
        raise ValueError(f"unknown expression {expression}")

    asetpts = setpts

    def adelay(self, ms: int) -> Stream:
        return self._with(temporal.delay(self.df, ms))

    def loop(self, times: int, size: int, period_us: int) -> Stream:
        return self._with(temporal.loop(self.df, self._k, size, times, period_us, spread=self.spread))

    def limit(self, n: int) -> Stream:
        return self._with(temporal.limit(self.df, self._k, n, spread=self.spread))

    def select_scene(self, threshold: float, value: str = "value") -> Stream:
        return self._with(temporal.scene_changes(self.df, self._k, threshold, value, spread=self.spread))

    # rate
    def fps(self, rate: float, mode: str = "cfr") -> Stream:
        if mode == "cfr":
            return self._with(resample.constant_rate(self.df, self._k, round(1_000_000 / rate), spread=self.spread))
        return self._with(resample.variable_rate(self.df, self._k, rate))

    # several streams
    def concat(self, *others: Stream, frame_us: int = 40_000) -> Stream:
        """One after the other; the streams' own ids are kept in ``segment``."""
        parts = align.immediate([self.df, *[o.df for o in others]]).withColumnRenamed("input_no", "segment")
        return self._with(combine.concat(parts, "segment", frame_us))

    def amix(self, *others: Stream, value: str = "value") -> Stream:
        both = align.immediate([self.df, *[o.df for o in others]])
        return self._with(combine.mix(both, 1 + len(others), [], value=value))

    def split(self, n: int = 2) -> list[Stream]:
        return [self] * n

    def overlay(self, over: Stream, start_us: int = -(2**62), end_us: int = 2**62) -> Stream:
        return self._with(align.overlay(self.df, over.df, self._k, start_us, end_us, spread=self.spread))

    def framesync(self, other: Stream) -> Stream:
        return self._with(align.framesync(self.df, other.df, self._k, spread=self.spread))

    def synchronised(self, *others: Stream) -> Stream:
        return self._with(align.synchronised([self.df, *[o.df for o in others]], self._k))

    def as_of(self, other: Stream, payload: str = "matched") -> Stream:
        return self._with(as_of(self.df, other.df, self._k, payload=payload, spread=self.spread))

    def switch(self, control: Stream) -> Stream:
        return self._with(align.switch(self.df, control.df, self._k))

    def jobs(self, is_eof) -> Stream:
        return self._with(align.jobs(self.df, is_eof, self._k, spread=self.spread))

    # windows and reducers
    def margin(self, value: str, size: int) -> Stream:
        return self._with(windows.margin(self.df, self._k, value, size))

    def batches(self, size: int) -> Stream:
        return self._with(windows.batches(self.df, self._k, size, spread=self.spread))

    def histogram(self, value: str = "value", bins: int = 256) -> DataFrame:
        return aggregate.histogram(self.df, self._k, value, bins)

    def ff_filter(self, name: str, *args, **named) -> Stream:
        """Any operation by name: a method of this class, or a registered frame filter."""
        if hasattr(self, name):
            return getattr(self, name)(*args, **named)
        if name not in convert.FILTERS:
            raise ValueError(f"no filter {name}")
        return self._with(convert.FILTERS[name](self.df, *args, **named))

    def scale(self, width: int, height: int) -> Stream:
        return self._with(convert.FILTERS["scale"](self.df, width, height))

    # ends
    def encode(self, path: str | None = None, **options) -> DataFrame:
        return sinks.encode(self.df, path, **options)

    def start(self) -> Iterator[Row]:
        """The rows in order, one by one."""
        return sinks.generate(self.df)
