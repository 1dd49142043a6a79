"""Shared plumbing for operators that work on Arrow batches of whole texts.

Texts are seen as one byte buffer plus offsets, so numpy handles every document
of a batch at once.  Batches are cut into runs of a few MB before any temporary
array is made: memory depends on that size and on the longest single text, never
on the number of rows.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled by numpy at once.
RUN_BYTES = 1 << 20
#: Bytes of a batch that ``map_parts`` hands on at once.
PART_BYTES = 4 << 20
#: Word separators: space and 0x09 to 0x0D.
SEPARATORS = b" \t\n\x0b\x0c\r"

IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; an empty or None result is skipped."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out
        pa.default_memory_pool().release_unused()  # a worker waits for its next task without it

    return df.mapInArrow(run, schema)


@functools.cache
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)  # only glibc has it


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its task and stage, and would keep it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


_KEPT: list = [None, None]


def kept[T](key: object, make: Callable[[], T]) -> T:
    """What a worker keeps for its next tasks, made once: one thing only, so that it goes when another operator's takes its place."""
    if _KEPT[0] != key:
        _KEPT[:] = None, None
        give_back()
        _KEPT[:] = key, make()
    return _KEPT[1]


def parts(batch: pa.RecordBatch, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices, in order, of at most so many bytes, or of one longer row."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
        return
    half = batch.num_rows // 2
    yield from parts(batch.slice(0, half), most)
    yield from parts(batch.slice(half), most)


def map_parts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``map_batches`` over ``parts`` of every batch, for ``fn`` that see rows one by one.

    What ``fn`` makes of its rows, and what it returns, then goes by ``PART_BYTES``, not
    by a batch of 10,000 texts, and nothing freed is kept from one batch to the next.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                if part.num_rows and (out := fn(part)) is not None and out.num_rows:
                    yield out
            give_back()
        batch = part = out = None
        give_back()

    return df.mapInArrow(run, schema)


def pick(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names: other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, or of one longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def texts(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes; nulls count as empty."""
    data, offsets = utf8(column)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a uint64 over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of any range of a sequence, by prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    steps = np.full(n, b & (2**64 - 1), np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], dtype=np.uint64, out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


_BYTE_ROLL, _WORD_ROLL = Rolling(0x9E3779B97F4A7C15), Rolling(0xD1342543DE82EF95)
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """The words of a run of documents, hashed to 64 bits.

    start, end: byte range of each word; doc: its row in the run; first: index of
    each row's first word, with one more entry at the end; hash: of its bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.data, self.offsets = data, offsets
        inside = ~IS_SEPARATOR[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | edge[1:n]
            ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        prefix = _BYTE_ROLL.prefix(_BYTE_VALUE[data])
        self.hash = mix(_BYTE_ROLL.ranges(prefix, self.start, self.end) + (self.end - self.start).astype(np.uint64))
        self._prefix: np.ndarray | None = None

    def grams(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the word ranges [start, end)."""
        if self._prefix is None:
            self._prefix = _WORD_ROLL.prefix(self.hash)
        return mix(_WORD_ROLL.ranges(self._prefix, start, end) + (end - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Indices of the words at which a window of ``size`` words of one document begins."""
        at = np.arange(len(self.start) - size + 1) if len(self.start) >= size else np.zeros(0, np.int64)
        return at[self.doc[at] == self.doc[at + size - 1]]


def covered(n: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in any range [start, start + length)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + length, -1)
    return np.cumsum(steps[:n]) > 0


def span_text(kinds: list[str], spans: Iterable[tuple[int, int, int]]) -> str:
    """kind:start:end by start, then in the order of kinds."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
