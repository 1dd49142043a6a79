"""User modules: a base class, a registry, calls as functions, and synchronous use."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

OK, STOP, ERROR = 0, 1, 2


class ModuleError(RuntimeError):
    """A module that failed, or was called wrongly."""


class ProcessDone(Exception):
    """A module that has nothing more to give."""


class Module:
    """User code over a stream.

    ``process`` takes an iterator of pandas frames and yields frames of ``schema``;
    it must have no side effects, as Spark may run a task twice.  With ``keys``
    each group is one call; ``process_pair`` takes the groups of two inputs.
    """

    schema: str = ""
    keys: tuple[str, ...] = ()

    def __init__(self, option: dict | None = None):
        self.option = dict(option or {})
        self.init()

    def init(self) -> None: ...

    def reset(self) -> None: ...

    def flush(self) -> None: ...

    def close(self) -> None: ...

    def dynamic_reset(self, option: dict) -> None:
        self.option |= option

    def process(self, frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def process_pair(self, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def apply(self, inputs: list[DataFrame]) -> DataFrame:
        """The module over whole DataFrames."""
        if len(inputs) == 2:
            a, b = (x.groupBy(*self.keys) for x in inputs)
            return a.cogroup(b).applyInPandas(lambda left, right: self.process_pair(left, right), self.schema)
        (df,) = inputs
        schema = self.schema or df.schema
        if self.keys:
            return df.groupBy(*self.keys).applyInPandas(lambda pdf: pd.concat(list(self.process(iter([pdf])))), schema)
        return df.mapInPandas(self.process, schema)


class Registry:
    """Modules by name: registered ones, then ``package.module:Class`` paths."""

    def __init__(self):
        self.known: dict[str, object] = {}
        self.tags: dict[str, frozenset[str]] = {}

    def add(self, name: str, *, tags: Iterable[str] = ()) -> Callable:
        def register(thing):
            self.known[name], self.tags[name] = thing, frozenset(tags)
            return thing

        return register

    def remove(self, name: str) -> None:
        self.known.pop(name, None)
        self.tags.pop(name, None)

    def names(self, tag: str | None = None) -> list[str]:
        return sorted(n for n in self.known if tag is None or tag in self.tags[n])

    def find(self, name: str):
        if name in self.known:
            return self.known[name]
        if ":" in name:
            path, _, attribute = name.partition(":")
            return getattr(importlib.import_module(path), attribute)
        return None


registry = Registry()


@functools.lru_cache(maxsize=16)
def shared(factory: Callable, *args):
    """Something costly, such as a model, made once in a worker and used by all its tasks."""
    return factory(*args)


class Functor:
    """A module called as a function on pandas frames: one output for each call."""

    def __init__(self, module: Module, n_inputs: int = 1):
        self.module, self.n_inputs, self.done = module, n_inputs, False

    def __call__(self, *frames: pd.DataFrame) -> pd.DataFrame:
        out = list(self.execute(*frames))
        if not out:
            self.done = True
            raise ProcessDone
        return pd.concat(out, ignore_index=True)

    def execute(self, *frames: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(frames) != self.n_inputs:
            raise ModuleError(f"{self.n_inputs} inputs are needed, not {len(frames)}")
        if self.done:
            raise ProcessDone
        if self.n_inputs == 2:
            yield self.module.process_pair(*frames)
        else:
            yield from self.module.process(iter(frames))


class SyncModule:
    """A module driven by hand: process, end, reset, close."""

    def __init__(self, module: Module, inputs: Iterable[str] = ("0",)):
        self.module, self.inputs = module, tuple(inputs)

    def process(self, frames: dict[str, pd.DataFrame]) -> pd.DataFrame:
        if unknown := set(frames) - set(self.inputs):
            raise ModuleError(f"unknown inputs {sorted(unknown)}")
        if len(self.inputs) == 2:
            return self.module.process_pair(*[frames[k] for k in self.inputs])
        return pd.concat([pd.DataFrame(), *self.module.process(iter(frames.values()))], ignore_index=True)

    def send_eof(self) -> None:
        self.module.flush()

    def dynamic_reset(self, option: dict) -> None:
        self.module.dynamic_reset(option)

    def close(self) -> None:
        self.module.close()
