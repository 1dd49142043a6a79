"""Folds over sorted streams with one row in hand, not a whole stream.

Rows are dealt by key and sorted within partitions; a worker reads them in Arrow
batches and keeps the state of one stream.  A stream's recurrence is one task, as
its state depends on all earlier rows; its memory is that of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

_ROWS = 8192


class Machine(Protocol):
    def feed(self, *values: object) -> Iterable[tuple]:
        """Rows that come out when one goes in."""

    def end(self) -> Iterable[tuple]:
        """Rows that come out when the stream ends."""


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], fields: list[str], machine: Callable[[], Machine], out: str) -> DataFrame:
    """The rows of a new machine for each key (null is one), fed ``fields`` in order: keys, then ``out``."""
    types = {f.name: f.dataType for f in df.schema}
    schema = StructType([StructField(k, types[k]) for k in keys] + _parse_datatype_string(out).fields)
    arrow = to_arrow_schema(schema)
    names, n = list(dict.fromkeys([*keys, *order, *fields])), len(keys)
    fed = [names.index(f) for f in fields]
    rows = df.select(*names)
    rows = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, *order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, ready = None, None, []

        def packed() -> pa.RecordBatch:
            columns = zip(*ready) if ready else [()] * len(arrow)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        def made(key: tuple | None, at: Machine | None, *values: object) -> Iterator[tuple]:
            rows = () if at is None else at.feed(*values) if values else at.end()
            return ((*key, *r) for r in rows)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(names)))):
                if now is None or row[:n] != key:
                    ended, key, now = (key, now), row[:n], machine()
                    some = chain(made(*ended), made(key, now, *(row[k] for k in fed)))
                else:
                    some = made(key, now, *(row[k] for k in fed))
                for r in some:
                    ready.append(r)
                    if len(ready) >= _ROWS:
                        yield packed()
                        ready = []
        for r in made(key, now):
            ready.append(r)
            if len(ready) >= _ROWS:
                yield packed()
                ready = []
        if ready:
            yield packed()

    return rows.mapInArrow(run, schema)
