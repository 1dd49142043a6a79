"""Streams put together or taken apart: concatenation, split, mix, sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.ordered import join_on, numbered

TS, SEQ = "ts_us", "seq"


def concat(df: DataFrame, segment: str, frame_us: int, ts: str = TS) -> DataFrame:
    """Segments one after the other: each begins where those before end (last time and a frame).

    The offsets are one row a segment.
    """
    spans = df.groupBy(segment).agg((F.max(ts) + frame_us).alias("_length"))
    before = Window.partitionBy(F.lit(1)).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(segment, F.coalesce(F.sum("_length").over(before), F.lit(0)).alias("_offset"))
    return join_on(df, offsets, [segment]).withColumn(ts, F.col(ts) + F.col("_offset")).drop("_offset")


def copies(df: DataFrame, n: int) -> DataFrame:
    """Every row to each of n outputs."""
    return df.withColumn("output_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def mix(df: DataFrame, inputs: int, keys: list[str], ts: str = TS, value: str = "value") -> DataFrame:
    """The sum of all inputs at a time, each scaled by 1 / inputs; the longest input ends it."""
    return df.groupBy(*keys, ts).agg((F.sum(value) / inputs).alias(value), F.count("*").alias("n_inputs"))


def audio_mix(ticks: DataFrame, df: DataFrame, volumes: dict[str, float], source: str, tick: str = "tick", value: str = "value", accepted: Column | None = None) -> DataFrame:
    """The sum of volume-scaled values at each tick, 0 where there is none; other volumes are 1."""
    gain = F.lit(1.0)
    for name, v in volumes.items():
        gain = F.when(F.col(source) == name, v).otherwise(gain)
    df = df if accepted is None else df.where(accepted)
    mixed = df.groupBy(tick).agg(F.sum(F.col(value) * gain).alias("_mixed"))
    return ticks.join(mixed, tick, "left").select(*ticks.columns, F.coalesce("_mixed", F.lit(0.0)).alias(value))


def round_robin(df: DataFrame, n: int, keys: list[str], order: tuple[str, ...] = (TS, SEQ), *, spread: bool = False) -> DataFrame:
    """Row i goes to branch i mod n; branch_row is its place there."""
    rows = numbered(df, keys, order, "_i", spread=spread).withColumn("_i", F.col("_i") - 1)
    return rows.withColumn("branch", F.pmod("_i", F.lit(n)).cast("int")).withColumn("branch_row", F.floor(F.col("_i") / n).cast("long")).drop("_i")


def assemble(df: DataFrame, n: int, branch: str = "branch", row: str = "branch_row") -> DataFrame:
    """The inverse: ``position`` is the row's place when branches are read in turn."""
    return df.withColumn("position", F.col(row) * n + F.col(branch))


def sequence_inputs(df: DataFrame, input_no: str, order: tuple[str, ...] = (TS, SEQ), *, spread: bool = False) -> DataFrame:
    """Each input's first row goes ahead; then the inputs follow one after another.

    ``position`` counts from 1; it needs no global sort: the counts of each input give the offsets.
    """
    rows = numbered(df, [input_no], order, "_rn", spread=spread)
    counts = df.groupBy(input_no).agg((F.count("*") - 1).alias("_rest"))
    w = Window.partitionBy(F.lit(1)).orderBy(input_no)
    offsets = counts.select(input_no, F.row_number().over(w).alias("_ahead"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("_inputs"), F.coalesce(F.sum("_rest").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.when(F.col("_rn") == 1, F.col("_ahead")).otherwise(F.col("_inputs") + F.col("_before") + F.col("_rn") - 1).cast("long")
    return join_on(rows, offsets, [input_no]).withColumn("position", place).select(*df.columns, "position")


def files(df: DataFrame, paths: str = "paths") -> DataFrame:
    """One row for each file of a job, in order."""
    rest = [c for c in df.columns if c != paths]
    return df.select(*rest, F.posexplode(paths).alias("file_no", "path"))
