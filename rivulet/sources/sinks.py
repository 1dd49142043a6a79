"""Sinks: files by format and job, count limits and padding, results as rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from rivulet.operators.temporal import limit

#: Writer formats by file ending; segments of a playlist are partitions of a table.
FORMATS = {"mp4": "parquet", "parquet": "parquet", "orc": "orc", "json": "json", "csv": "csv", "txt": "text", "m3u8": "parquet"}


def output_path(prefix: str, job: int, ending: str = "mp4") -> str:
    return f"{prefix}/{job}/output.{ending}"


def encode(df: DataFrame, path: str | None = None, *, prefix: str | None = None, job: int = 0, fmt: str | None = None, segment_us: int | None = None, null: bool = False, mode: str = "errorifexists", **options: str) -> DataFrame:
    """Write a stream; one row with the path comes back.

    Without a path, a prefix or ``null`` there is nothing to write to.
    """
    if null:
        df.write.format("noop").mode("overwrite").save()
        return df.sparkSession.createDataFrame([(None, 1)], "path string, ts_us long")
    if path is None and prefix is None:
        raise ValueError("an output path, a prefix or null output is needed")
    path = path or output_path(prefix, job)
    ending = path.rsplit(".", 1)[-1]
    writer_format = fmt or FORMATS.get(ending, "parquet")
    if segment_us or ending == "m3u8":
        df = df.withColumn("segment", F.floor(F.col("ts_us") / (segment_us or 10_000_000)))
        df.write.format(writer_format).options(**options).mode(mode).partitionBy("segment").save(path)
    else:
        df.write.format(writer_format).options(**options).mode(mode).save(path)
    return df.sparkSession.createDataFrame([(path, 1)], "path string, ts_us long")


def push(df: DataFrame, level: int, path: str | None = None) -> DataFrame:
    """0: written; 1 and 2: packets; 3: the frames themselves."""
    if level == 0:
        return encode(df, path)
    if level == 3:
        return df
    packed = df.select(F.to_json(F.struct("*")).cast("binary").alias("data"), *[c for c in ("stream_id", "seq", "ts_us") if c in df.columns])
    return packed if level == 2 else packed.withColumn("offset", F.lit(None).cast("long")).withColumn("whence", F.lit(0))


def limited(df: DataFrame, keys: list[str], most: int, least: int = 0, frame_us: int = 40_000) -> DataFrame:
    """At most ``most`` rows a stream; the last is repeated until there are ``least``."""
    out = limit(df, keys, most)
    if not least:
        return out
    w = Window.partitionBy(*keys)
    n = out.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_rn", F.row_number().over(w.orderBy("ts_us", "seq")))
    again = F.when(F.col("_rn") == F.col("_n"), F.sequence(F.lit(0), F.greatest(F.lit(0), F.lit(least) - F.col("_n").cast("int")))).otherwise(F.array(F.lit(0)))
    return n.withColumn("_k", F.explode(again)).withColumn("ts_us", F.col("ts_us") + F.col("_k") * frame_us).select(*df.columns)


def stream_info(df: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of each stream as JSON."""
    facts = df.groupBy(*keys).agg(F.count("*").alias("frames"), ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("duration"))
    return facts.select(*keys, F.to_json(F.struct("frames", "duration")).alias("info"))


def generate(df: DataFrame, order: tuple[str, ...] = ("ts_us", "seq")) -> Iterator[Row]:
    """The rows in order, pulled partition by partition."""
    return df.orderBy(*order).toLocalIterator(prefetchPartitions=True)
