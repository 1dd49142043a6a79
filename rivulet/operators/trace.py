"""Statistics over an event log of a run: durations, frequencies, queues, throughput.

A log has pid, tid, ts, name, cat, ph ("B" begin, "E" end, else a mark) and args.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.ordered import Run, scan

#: Categories and phases, by their number in a log.
CATEGORIES = ["INTERLATENCY", "PROCESSING", "SCHEDULE", "QUEUE_INFO", "THROUGHPUT", "CUSTOM", "TRACE_START", "GRAPH_START", "GRAPH_END"]
PHASES = ["NONE", "START", "END"]
LATENCY = "INTERLATENCY"


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """``pid,tid,ts,name,category,phase[,key:type:value...]`` with numbers for category and phase."""
    part = F.split(column, ",")
    info = F.filter(F.slice(part, 7, 10_000), lambda x: x != "")
    return lines.select(
        part[0].alias("pid"),
        part[1].alias("tid"),
        part[2].cast("long").alias("ts"),
        part[3].alias("name"),
        F.get(F.array(*map(F.lit, CATEGORIES)), part[4].cast("int")).alias("cat"),
        F.get(F.array(F.lit("N"), F.lit("B"), F.lit("E")), part[5].cast("int")).alias("ph"),
        F.map_from_entries(F.transform(info, lambda x: F.struct(F.split(x, ":")[0].alias("key"), F.split(x, ":")[2].alias("value")))).alias("args"),
    )


def pairs(log: DataFrame, keys: list[str] | None = None, *, spread: bool = False) -> DataFrame:
    """Each end with the latest begin of its name; ends without one are left out."""
    keys = keys or ["name"]
    begun = scan(log.withColumn("_end", (F.col("ph") == "E").cast("int")), keys, ["ts", "_end"], {"begin_ts": Run("last", F.when(F.col("ph") == "B", F.col("ts")))}, spread=spread)
    return begun.where("ph = 'E' and begin_ts is not null").withColumn("duration", F.col("ts") - F.col("begin_ts")).drop("_end")


def durations(log: DataFrame, *, spread: bool = False) -> DataFrame:
    """Per name total, count, mean (whole), least and most, and the share of the graph's time in percent."""
    whole = log.agg((F.max("ts") - F.min("ts")).alias("_graph"))
    stats = pairs(log.where(F.col("cat") != LATENCY), spread=spread).groupBy("name").agg(F.sum("duration").alias("total"), F.count("*").alias("count"), F.min("duration").alias("min"), F.max("duration").alias("max"))
    return stats.crossJoin(F.broadcast(whole)).select("name", "total", "count", F.expr("total div count").alias("avg"), "min", "max", F.round(F.col("total") * 100 / F.col("_graph"), 6).alias("percent"))


def frequencies(log: DataFrame) -> DataFrame:
    return log.where(F.col("cat") != LATENCY).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")


def queues(log: DataFrame, size: Column, most: Column, name: str = "name") -> DataFrame:
    rows = log.select(name, size.cast("long").alias("_size"), most.cast("long").alias("_max"))
    return rows.groupBy(name).agg(F.max("_max").alias("limit"), F.expr("sum(_size) div count(*)").alias("avg_size"), F.max("_size").alias("max_size"))


def throughput(packets: DataFrame, processed: DataFrame, node: str = "node", stream: str = "stream", duration: str = "duration") -> DataFrame:
    """Packets a second of a node's processing time, by stream."""
    n = packets.groupBy(node, stream).agg(F.count("*").alias("packets"))
    t = processed.groupBy(node).agg(F.sum(duration).alias("busy_us"))
    return n.join(t, node).select(node, stream, "packets", "busy_us", F.round(F.col("packets") * 1e6 / F.when(F.col("busy_us") > 0, F.col("busy_us")), 6).alias("fps"))


def totals(log: DataFrame) -> DataFrame:
    begin = F.min(F.when(F.col("cat") == "TRACE_START", F.col("ts")))
    return log.agg((F.max("ts") - F.min("ts")).alias("graph_us"), (F.max("ts") - F.coalesce(begin, F.min("ts"))).alias("trace_us"))


def buffers(log: DataFrame, size: int, tid: str = "tid") -> DataFrame:
    """Events of each thread's ring buffer, and those that overran it."""
    return log.groupBy(tid).agg(F.count("*").alias("total"), F.greatest(F.count("*") - size, F.lit(0)).alias("overflowed"))


def begins_shown_twice(log: DataFrame, *, spread: bool = False) -> DataFrame:
    """The begins that a viewer needs again: one for each further end of the same begin."""
    ends = pairs(log, spread=spread)
    w = Window.partitionBy("name", "begin_ts").orderBy("ts")
    return ends.withColumn("_n", F.row_number().over(w)).where("_n > 1").select("name", F.col("begin_ts").alias("ts"), F.lit("B").alias("ph"), F.col("ts").alias("end_ts"))


def status(nodes: DataFrame, streams: DataFrame, node: str = "node") -> DataFrame:
    """A nested JSON snapshot: one row for each node, its streams inside."""
    inner = streams.groupBy(node).agg(F.array_sort(F.collect_list(F.struct(*[c for c in streams.columns if c != node]))).alias("streams"))
    return nodes.join(inner, node, "left").select(node, F.to_json(F.struct(*nodes.columns, "streams")).alias("status"))
