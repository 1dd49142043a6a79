"""Count windows and order: margins, hops, batches, priorities, key frames, clock repair."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.ordered import Run, numbered, scan
from rivulet.operators.sorted_fold import fold_sorted

TS, SEQ = "ts_us", "seq"


def margin(df: DataFrame, keys: list[str], value: str, size: int, order: tuple[str, ...] = (TS, SEQ)) -> DataFrame:
    """``around``: the values of ``size`` rows centred on each; beyond an end its first or last value is repeated.

    The window reaches ``size`` rows, never the whole stream, into memory.
    """
    m = (size - 1) // 2
    w = Window.partitionBy(*keys).orderBy(*order)
    around = F.collect_list(F.struct(value)).over(w.rowsBetween(-m, size - 1 - m))
    before = F.count(F.lit(1)).over(w.rowsBetween(-m, -1))
    plain = F.transform("_around", lambda s: s[value])
    front, back = m - F.col("_before"), size - F.size("_around") - (m - F.col("_before"))
    rows = df.select("*", around.alias("_around"), before.alias("_before"))
    return rows.withColumn("around", F.concat(F.array_repeat(F.element_at(plain, 1), front.cast("int")), plain, F.array_repeat(F.element_at(plain, -1), back.cast("int")))).drop("_around", "_before")


def hopping(df: DataFrame, keys: list[str], value: str, size: int = 7, hop: int = 3, order: tuple[str, ...] = (TS, SEQ)) -> DataFrame:
    """One row for each step: the values of up to ``size`` rows from every ``hop``-th on; shorter at the end."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.select("*", F.row_number().over(w).alias("_rn"), F.collect_list(F.struct(value)).over(w.rowsBetween(0, size - 1)).alias("_s"))
    return rows.where(F.pmod(F.col("_rn") - 1, F.lit(hop)) == 0).select(*keys, *order, F.floor((F.col("_rn") - 1) / hop).cast("long").alias("step"), F.transform("_s", lambda s: s[value]).alias("window"))


def batches(df: DataFrame, keys: list[str], size: int, order: tuple[str, ...] = (TS, SEQ), *, spread: bool = False) -> DataFrame:
    """``batch_no`` from 0, of ``size`` rows each; the last may be short."""
    rows = numbered(df, keys, order, "_rn", spread=spread)
    return rows.withColumn("batch_no", F.floor((F.col("_rn") - 1) / size).cast("long")).drop("_rn")


def oldest_first(df: DataFrame, node: list[str], number: str = "stream_frame_number") -> DataFrame:
    """The cached row with the least frame number of each node (an aggregate, no sort)."""
    return df.groupBy(*node).agg(F.min_by(F.struct(*[c for c in df.columns if c not in node]), F.struct(number)).alias("_r")).select(*node, "_r.*")


def task_order(df: DataFrame, ts: str = TS, node: str = "node_id") -> DataFrame:
    """Tasks in the order of their time, then of their node (a distributed sort)."""
    return df.orderBy(ts, node)


def least_recent(df: DataFrame, scheduled: str = "last_scheduled", node: str = "node_id", eligible: Column | None = None) -> DataFrame:
    """The eligible node scheduled longest ago."""
    df = df if eligible is None else df.where(eligible)
    return df.agg(F.min_by(node, F.struct(scheduled, node)).alias(node))


def forced_keys(df: DataFrame, keys: list[str], sn: str = "sn", order: tuple[str, ...] = (TS, SEQ), *, spread: bool = False) -> DataFrame:
    """frame_type: of rows with an odd serial number K where sn >> 1 differs from the odd one before, else N; null if even."""
    odd = F.col(sn).bitwiseAND(F.lit(1)) == 1
    group = F.shiftright(sn, 1)
    seen = scan(df, keys, order, {"_before": Run("last", F.when(odd, group), "before")}, spread=spread)
    return seen.withColumn("frame_type", F.when(odd, F.when(F.col("_before").isNull() | (F.col("_before") != group), "K").otherwise("N"))).drop("_before")


def output_counts(df: DataFrame, keys: list[str], order_no: str) -> DataFrame:
    """Output rows for each input frame from 0 to the last seen, with 0 where there are none."""
    counted = df.groupBy(*keys, F.col(order_no).alias("input_no")).agg(F.count("*").alias("n_out"))
    every = df.groupBy(*keys).agg(F.max(order_no).alias("_last")).withColumn("input_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long")))).drop("_last")
    return every.join(counted.withColumn("input_no", F.col("input_no").cast("long")), [*keys, "input_no"], "left").select(*keys, "input_no", F.coalesce("n_out", F.lit(0)).alias("n_out"))


def rising_dts(df: DataFrame, keys: list[str], dts: str = "dts", order: tuple[str, ...] = (SEQ,), *, spread: bool = False) -> DataFrame:
    """dts made to rise by at least one a row: k + max over j <= k of (dts_j - j)."""
    rows = numbered(df, keys, order, "_k", spread=spread)
    lead = scan(rows, keys, order, {"_lead": Run("max", F.col(dts) - F.col("_k"))}, spread=spread)
    return lead.withColumn("fixed_dts", F.col("_k") + F.col("_lead")).drop("_k", "_lead")


def mux_clock(df: DataFrame, keys: list[str], strict: bool = True, pts: str = "pts", dts: str = "dts", seq: str = SEQ) -> DataFrame:
    """Exact clock repair of a muxer, a fold over each stream: fixed_pts, fixed_dts.

    Where dts > pts both become the median of pts, dts and the last dts + 1; then a
    dts under the last (+ 1 if strict) rises to it and takes a pts that isn't below it along.
    """
    rest = [f for f in df.schema if f.name not in keys]
    names = [f.name for f in rest]
    p_at, d_at = names.index(pts), names.index(dts)

    class Clock:
        def __init__(self) -> None:
            self.last: int | None = None

        def feed(self, *row: object) -> list[tuple]:
            p, d = row[p_at], row[d_at]
            if p is None or d is None:
                return [(*row, p, d)]
            least = None if self.last is None else self.last + strict
            if d > p:
                p = d = p if self.last is None else sorted((p, d, self.last + 1))[1]
            if least is not None and d < least:
                p, d = max(p, least) if p >= d else p, least
            self.last = d
            return [(*row, p, d)]

        def end(self) -> list[tuple]:
            return []

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", fixed_pts long, fixed_dts long"
    return fold_sorted(df, keys, [seq], names, Clock, out).select(*df.columns, "fixed_pts", "fixed_dts")


def temporal_denoise(df: DataFrame, keys: list[str], pixels: str, width: int, height: int, keep: float = 0.5, order: tuple[str, ...] = (TS, SEQ)) -> DataFrame:
    """Each frame's 3 x 3 mean mixed with the frame put out before (a fold over each stream)."""

    rest = [f for f in df.schema if f.name not in keys]
    names = [f.name for f in rest]
    at = names.index(pixels)

    class Mix:
        def __init__(self) -> None:
            self.before: np.ndarray | None = None

        def feed(self, *row: object) -> list[tuple]:
            if row[at] is None:
                return [row]
            frame = np.pad(np.array(row[at], float).reshape(height, width), 1, mode="edge")
            mean = sum(frame[a : a + height, b : b + width] for a in range(3) for b in range(3)) / 9
            self.before = mean if self.before is None else keep * mean + (1 - keep) * self.before
            return [(*row[:at], self.before.ravel().tolist(), *row[at + 1 :])]

        def end(self) -> list[tuple]:
            return []

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return fold_sorted(df, keys, list(order), names, Mix, out).select(*df.columns)
