"""Sources: clocks, counters, silence, media tables by notify name, raw tensors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.schema import EOF, EOS, SECOND


def clock(spark: SparkSession, n: int, fps: float = 25.0) -> DataFrame:
    """Frame n at n / fps."""
    if fps <= 0:
        raise ValueError("fps must be positive")
    return spark.range(n).select(F.col("id").alias("n"), (F.col("id") * SECOND / F.lit(fps)).cast("long").alias("clock_us"))


def live_clock(spark: SparkSession, rows_per_second: int = 25) -> DataFrame:
    """The clock as an endless stream."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("value").alias("n"), F.unix_micros("timestamp").alias("clock_us"))


def wall_clock(spark: SparkSession, now_us: int, steps_us: dict[str, int]) -> DataFrame:
    """All ticks of each stream up to now."""
    out = None
    for name, step in steps_us.items():
        part = spark.range(0, now_us + 1, step).select(F.lit(name).alias("stream_id"), F.col("id").alias("ts_us"))
        out = part if out is None else out.unionAll(part)
    return out


def counter(spark: SparkSession, last: int = 1500, every: int = 10) -> DataFrame:
    """1, 2, ...: each multiple of ``every`` ends a job, ``last`` ends the stream."""
    value = F.col("id")
    return spark.range(1, last + 1).select(value.alias("value"), F.when(value >= last, EOS).when(value % every == 0, EOF).alias("ctl"))


def silence(spark: SparkSession, seconds: float, rate: int = 44100, size: int = 1024, channels: int = 2) -> DataFrame:
    """Frames of zero samples."""
    n = int(np.ceil(seconds * rate / size))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), size), channels)
    return spark.range(n).select(F.col("id").alias("seq"), (F.col("id") * size * SECOND / rate).cast("long").alias("ts_us"), zeros.alias("samples"))


def decode(spark: SparkSession, path: str, fmt: str = "parquet", *, kind: str = "kind", map_v: int | None = None, map_a: int | None = None, **options: str) -> dict[str, DataFrame]:
    """A media table as its streams by name: ``video`` and ``audio``; map_v and map_a choose a stream_index."""
    df = spark.read.format(fmt).options(**options).load(path)
    out = {}
    for name, index in (("video", map_v), ("audio", map_a)):
        part = df.where(F.col(kind) == name)
        out[name] = part if index is None else part.where(F.col("stream_index") == index)
    return out


def from_files(spark: SparkSession, path: str, dtype: str = "float32", count: int = -1, offset: int = 0) -> DataFrame:
    """Binary files as vectors: ``count`` values of ``dtype`` from the byte ``offset`` on (-1: all)."""

    def read(batches):
        for batch in batches:
            data = [np.frombuffer(c, dtype, -1 if count < 0 else count, offset).astype("float64") for c in batch.column("content").to_pylist()]
            yield pa.record_batch([batch.column("path"), pa.array(data, pa.list_(pa.float64()))], ["path", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, data array<double>")


def to_bytes(df: DataFrame, column: str, dtype: str = "float32") -> DataFrame:
    """A vector column as raw bytes."""

    def write(batches):
        for batch in batches:
            k = batch.schema.get_field_index(column)
            data = [None if x is None else np.array(x, dtype).tobytes() for x in batch.column(k).to_pylist()]
            columns = [pa.array(data, pa.binary()) if j == k else c for j, c in enumerate(batch.columns)]
            yield pa.record_batch(columns, batch.schema.names)

    schema = ", ".join(f"`{f.name}` {'binary' if f.name == column else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(write, schema)
