"""Alignment of several streams: by arrival, by equal time, as of, by nearest tick, by job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators.ordered import Run, as_of, join_on, numbered, scan

TS, SEQ = "ts_us", "seq"


def immediate(streams: list[DataFrame]) -> DataFrame:
    """All rows of all inputs; their defined order is (time, input, seq)."""
    tagged = [s.withColumn("input_no", F.lit(k)) for k, s in enumerate(streams)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def _latest_per_time(s: DataFrame, keys: list[str], ts: str, seq: str) -> DataFrame:
    rest = [c for c in s.columns if c not in (*keys, ts)]
    return s.groupBy(*keys, ts).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("row"))


def synchronised(streams: list[DataFrame], keys: list[str] | None = None, ts: str = TS, seq: str = SEQ) -> DataFrame:
    """One row for each time of any input; in0, in1, ... hold the inputs' rows of that time.

    Of rows of one input and time the last by seq is kept, as a task pops all that
    it may and keeps the last.
    """
    keys = keys or []
    parts = [_latest_per_time(s, keys, ts, seq).withColumnRenamed("row", f"in{k}") for k, s in enumerate(streams)]
    return reduce(lambda a, b: a.join(b, [*keys, ts], "full"), parts)


def framesync(sync: DataFrame, other: DataFrame, keys: list[str], ts: str = TS, seq: str = SEQ, *, spread: bool = False) -> DataFrame:
    """At each time of ``sync``: its row and the latest other row at or before it.

    After the last sync row of a key its row is repeated at each later time of the
    other stream, which then leads.  Columns: keys, ts, a (sync row), b (other row).
    """
    a_row, b_row = F.struct(*sync.columns), F.struct(*other.columns)
    a_type, b_type = sync.select(a_row.alias("x")).schema["x"].dataType, other.select(b_row.alias("x")).schema["x"].dataType
    a = sync.select(*keys, ts, F.col(seq).alias("_seq"), F.lit(1).alias("_side"), a_row.alias("_a"), F.lit(None).cast(b_type).alias("_b"))
    b = other.select(*keys, ts, F.col(seq).alias("_seq"), F.lit(0).alias("_side"), F.lit(None).cast(a_type).alias("_a"), b_row.alias("_b"))
    both = scan(a.unionAll(b), keys, [ts, "_side", "_seq"], {"a": Run("last", F.col("_a")), "b": Run("last", F.col("_b"))}, spread=spread)
    end = sync.groupBy(*keys).agg(F.max(ts).alias("_end"))
    late = join_on(both.where("_side = 0"), end, keys).where(F.col(ts) > F.col("_end"))
    out = [*keys, ts, "a", "b"]
    return both.where("_side = 1").select(*out).unionAll(late.select(*out))


def clocksync(ticks: DataFrame, stream: DataFrame, ts: str = TS, seq: str = SEQ, *, spread: bool = True) -> DataFrame:
    """For each tick the stream's row nearest to it, with every row cached beforehand.

    The first tick goes with the stream's first row; later targets keep that
    offset.  Nearest rows are found as of the target, from either side, and the
    later of two equally near wins; since a tick consumes at least one row, row
    number min(N - 1, k + max over j <= k of (nearest_j - j)) is the one used.
    """
    whole = numbered(stream.withColumn("_g", F.lit(1)), ["_g"], [ts, seq], "n", spread=spread).withColumn("n", F.col("n") - 1)
    rows = whole.select("_g", ts, seq, "n")
    clock = numbered(ticks.select(F.col(ts).alias("tick"), F.lit(1).alias("_g")), ["_g"], ["tick"], "k", spread=spread).withColumn("k", F.col("k") - 1)
    first = stream.agg(F.min(ts).alias("_s0"), F.count("*").alias("_count")).crossJoin(ticks.agg(F.min(ts).alias("_t0")))
    aimed = clock.crossJoin(F.broadcast(first)).withColumn(ts, F.col("tick") - F.col("_t0") + F.col("_s0")).withColumn(seq, F.col("k"))
    # the row at or before the target (there always is one), and the last row of the next time
    found = as_of(aimed, rows, ["_g"], ts=ts, seq=seq, payload="_before", spread=spread).withColumn("_next", F.col("_before")["n"] + 1)
    later = rows.select(F.col("n").alias("_next"), F.col(ts).alias("_later"))
    last = rows.groupBy(F.col(ts).alias("_later")).agg(F.max("n").alias("_after"))
    found = found.join(later, "_next", "left").join(last, "_later", "left")
    ahead = F.col("_later") - F.col(ts) <= F.col(ts) - F.col("_before")[ts]
    lead = scan(found.withColumn("_near", F.when(ahead, F.col("_after")).otherwise(F.col("_before")["n"])), ["_g"], ["k"], {"_lead": Run("max", F.col("_near") - F.col("k"))}, spread=spread)
    used = lead.select("k", "tick", F.col(ts).alias("target"), F.least(F.col("_count") - 1, F.col("k") + F.col("_lead")).alias("n"))
    return used.join(whole.select("n", F.struct(*stream.columns).alias("row")), "n").select("k", "tick", "target", "n", "row")


def jobs(stream: DataFrame, is_eof: Column, keys: list[str], ts: str = TS, seq: str = SEQ, *, spread: bool = False) -> DataFrame:
    """job_id: how many ends of a job came before; the end belongs to the job that it ends."""
    ends = scan(stream.withColumn("_eof", is_eof.cast("long")), keys, [ts, seq], {"job_id": Run("sum", F.col("_eof"), "before")}, spread=spread)
    return ends.withColumn("job_id", F.coalesce("job_id", F.lit(0))).drop("_eof")


def overlay(base: DataFrame, over: DataFrame, keys: list[str], start_us: int, end_us: int, ts: str = TS, seq: str = SEQ, *, repeat_last: bool = True, spread: bool = False) -> DataFrame:
    """Base rows with ``over``: the latest overlay row, shown between two times only."""
    found = as_of(base, over, keys, ts=ts, seq=seq, payload="over", spread=spread)
    if not repeat_last:
        end = over.groupBy(*keys).agg(F.max(ts).alias("_end"))
        found = found.join(end, keys, "left").withColumn("over", F.when(F.col(ts) <= F.col("_end"), F.col("over"))).drop("_end")
    return found.withColumn("over", F.when(F.col(ts).between(start_us, end_us), F.col("over")))


def divider(frames: DataFrame, keys: list[str], width: int, step: int = 5, order: tuple[str, ...] = (TS, SEQ), *, spread: bool = False) -> DataFrame:
    """x of a divider that moves by ``step`` a frame and bounces between 0 and width."""
    n = numbered(frames, keys, order, "_n", spread=spread)
    at = F.pmod((F.col("_n") - 1) * step, F.lit(2 * width))
    return n.withColumn("x_coord", F.when(at <= width, at).otherwise(2 * width - at)).drop("_n")


def switch(main: DataFrame, control: DataFrame, keys: list[str]) -> DataFrame:
    """Main rows whose gate some control row of the same keys opens."""
    return main.join(control.select(*keys).distinct(), keys, "left_semi")


def hub(ticks: DataFrame, sources: DataFrame, source_key: str, ts: str = TS, seq: str = SEQ, *, spread: bool = False) -> DataFrame:
    """For each tick the latest row of every source as a list of (source, row) by source.

    Sources are few (they are mixed on every tick), ticks many: each source is
    joined as of all ticks, with its own id as the key.
    """
    ids = sources.select(source_key).distinct()
    every = ticks.crossJoin(F.broadcast(ids))
    found = as_of(every.withColumn(seq, F.lit(0)), sources, [source_key], ts=ts, seq=seq, payload="row", spread=spread).where("row is not null")
    return found.groupBy(ts).agg(F.array_sort(F.collect_list(F.struct(source_key, "row"))).alias("rows"))
