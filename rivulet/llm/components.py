"""Connected components of an edge table by alternating large and small stars.

Every round is a grouped minimum and an equi-join on the vertex, so a vertex of
many edges is combined before it is shuffled, and the skewed side of the join can
be split.  Nothing is brought to the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.shared_tables import discard, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): at each u, link its larger (or smaller) neighbours to the least of all."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """vertex, root (the least vertex reachable) for every vertex of edges (u, v), both long."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = None
    while True:
        after = written(_stars(_stars(now, large=True), large=False), name)
        discard(now)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("vertex"), "root").distinct())
