"""Running values over an ordered stream, also where one key holds most rows.

``scan`` adds running values (row numbers, sums, extremes, the last value seen)
over ``order`` within ``keys``.  Plainly it is a window.  With ``spread`` no key
is gathered in one task: rows are range-partitioned by key and order and written
once, a window runs inside each partition, and what earlier partitions of a key
leave is added from a table with one row for each partition of those keys that
run over several, of which there are at most as many as partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.shared import written


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys in which null equals null, as it does in a window or a group."""
    if not keys:
        return left.crossJoin(right)  # one row, as there is one stream
    named = right.select(*[F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(keys)]
    return left.join(named, reduce(and_, same), how).drop(*[f"_key{n}" for n in range(len(keys))])


@dataclass(frozen=True)
class Run:
    """kind: number (of rows), sum, max, min or last (value that isn't null).

    upto: "row" includes the row itself, "before" doesn't.
    """

    kind: str
    value: Column | None = None
    upto: str = "row"

    def over(self, window, order: Sequence[Column]) -> Column:
        end = 0 if self.upto == "row" else -1
        w = window.orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        if self.kind == "number":
            return F.count(F.lit(1)).over(w)
        if self.kind == "last":
            return F.last(self.value, ignorenulls=True).over(w)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](self.value).over(w)

    def whole(self, place: Column) -> Column:
        if self.kind == "number":
            return F.count(F.lit(1))
        if self.kind == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), place))
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](self.value)

    def over_parts(self, value: Column, window) -> Column:
        if self.kind == "last":
            return F.last(value, ignorenulls=True).over(window)
        return {"number": F.sum, "sum": F.sum, "max": F.max, "min": F.min}[self.kind](value).over(window)

    def joined(self, carried: Column, here: Column) -> Column:
        if self.kind == "last":
            return F.coalesce(here, carried)
        if self.kind in ("number", "sum"):
            return F.when(carried.isNull(), here).otherwise(carried + F.coalesce(here, F.lit(0)))
        return F.greatest(carried, here) if self.kind == "max" else F.least(carried, here)


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], runs: dict[str, Run], *, spread: bool = False, partitions: int | None = None) -> DataFrame:
    """df with one more column for each of ``runs``."""
    order = _columns(order)
    if not spread:
        w = Window.partitionBy(*keys)
        return df.select("*", *[r.over(w, order).alias(n) for n, r in runs.items()])
    names = df.columns
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.select("*", *[o.alias(f"_o{k}") for k, o in enumerate(order)])
    ranks = [f"_o{k}" for k in range(len(order))]
    placed = written(placed.repartitionByRange(n, *keys, *ranks).withColumn("_part", F.spark_partition_id()), "ordered")
    w = Window.partitionBy("_part", *keys)
    here = placed.select("*", *[r.over(w, _columns(ranks)).alias(f"_h_{n}") for n, r in runs.items()])

    place = F.struct(*ranks)
    parts = placed.groupBy(*keys, "_part").agg(*[r.whole(place).alias(f"_w_{n}") for n, r in runs.items()])
    by_key = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), F.lag("_part").over(Window.partitionBy(*keys).orderBy("_part")).alias("_earlier"), *[r.over_parts(F.col(f"_w_{n}"), by_key).alias(f"_c_{n}") for n, r in runs.items()])
    carried = written(carried.where("_earlier is not null").drop("_earlier"), "carried")
    condition = F.col("_part") == F.col("_p")
    for k in keys:
        condition &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = here.join(F.broadcast(carried), condition, "left")  # at most a row for each partition
    return joined.select(*names, *[r.joined(F.col(f"_c_{n}"), F.col(f"_h_{n}")).alias(n) for n, r in runs.items()])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rn", **options) -> DataFrame:
    """Row numbers from 1."""
    return scan(df, keys, order, {name: Run("number")}, **options)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], *, ts: str = "ts_us", seq: str = "seq", payload: str = "matched", strict: bool = False, spread: bool = False) -> DataFrame:
    """left with ``payload``: the latest right row (as a struct) of its keys at or, if strict, before its time.

    The struct is null only where there is no such row.  Right rows of one time:
    the largest ``seq`` holds.
    """
    body = F.struct(*[F.col(c) for c in right.columns])
    side_left, side_right = (0, 1) if strict else (1, 0)
    shared = [*keys, ts]
    a = left.select(*shared, F.col(seq).alias("_seq"), F.lit(side_left).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(body.alias("b")).schema["b"].dataType).alias("_right"))
    b = right.select(*shared, F.col(seq).alias("_seq"), F.lit(side_right).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), body.alias("_right"))
    both = scan(a.unionAll(b), keys, [ts, "_side", "_seq"], {"_found": Run("last", F.col("_right"))}, spread=spread)
    return both.where(F.col("_left").isNotNull()).select("_left.*", F.col("_found").alias(payload))
