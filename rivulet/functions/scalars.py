"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filter_params(args: Column, named: Column) -> Column:
    """``a:b:k1=v1:k2=v2`` with sorted names; quoted as a whole if it holds a comma."""
    pairs = F.array_sort(F.transform(F.map_entries(named), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    text = F.array_join(F.concat(args, pairs), ":")
    return F.when(F.contains(text, F.lit(",")), F.concat(F.lit("'"), text, F.lit("'"))).otherwise(text)


def escape(text: Column) -> Column:
    """A backslash before each of ``\\ [ ] , ;``."""
    return F.regexp_replace(text, r"([\\\[\],;])", r"\\$1")


def fraction(text: Column) -> Column:
    """``a/b`` as a number, 0 if b is; null if there are other than one or two parts."""
    p = F.split(text, "/")
    a, b = F.get(p, F.lit(0)).try_cast("double"), F.get(p, F.lit(1)).try_cast("double")
    return F.when(F.size(p) == 1, a).when(F.size(p) == 2, F.when(b == 0, 0.0).otherwise(a / b))


def rescale(value: Column, num: int, den: int) -> Column:
    """value * num / den, halves away from zero."""
    n = value * num
    return F.when(n >= 0, F.floor((2 * n + den) / (2 * den))).otherwise(-F.floor((-2 * n + den) / (2 * den))).cast("long")


def rescale_pts(pts: Column, from_num: int, from_den: int, to_num: int, to_den: int) -> Column:
    """Between time bases, halves to even."""
    return F.bround(pts * (from_num * to_den) / (from_den * to_num)).cast("long")


def identifier_parts(name: Column) -> Column:
    """``notify:name`` as a struct; notify is empty if there is no colon."""
    has = F.contains(name, F.lit(":"))
    return F.struct(F.when(has, F.substring_index(name, ":", 1)).otherwise("").alias("notify"), F.regexp_replace(name, "^[^:]*:", "").alias("name"))


def stream_name(module: Column, node: Column, index: Column) -> Column:
    return F.concat_ws("_", module, node, index)


def color(hex_text: Column) -> Column:
    """``#rrggbb`` as [r, g, b]."""
    return F.transform(F.array(F.lit(2), F.lit(4), F.lit(6)), lambda k: F.conv(F.substr(hex_text, k, F.lit(2)), 16, 10).cast("int"))


def trace_info(info: Column) -> Column:
    """``key:type:value`` items as a map of text (types: 0 text, 1 whole number, 2 number)."""
    items = F.filter(F.split(info, ","), lambda x: F.size(F.split(x, ":")) >= 3)
    return F.map_from_entries(F.transform(items, lambda x: F.struct(F.split(x, ":")[0].alias("key"), F.split(x, ":")[2].alias("value"))))


def metadata(map_: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(map_, F.lit(key)), F.lit(""))


def merge_patch(base: Column, patch: Column) -> Column:
    """JSON objects of plain values: the patch's keys win, its nulls remove."""
    a, b = (F.coalesce(F.from_json(x, "map<string,string>"), F.create_map().cast("map<string,string>")) for x in (base, patch))
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.map_concat(kept, F.map_filter(b, lambda k, v: v.isNotNull()))


def channels(layout: Column) -> Column:
    """Channels of a layout bit mask, without bit 63 (native order)."""
    return F.bit_count(layout.bitwiseAND(F.lit(2**63 - 1)))


def type_hash(name: Column) -> Column:
    """A hash of a type's name; only its equality means something."""
    return F.xxhash64(name)


def black_share(luma: Column, threshold: float = 32) -> Column:
    """Per cent of a frame's values under the threshold, in whole numbers."""
    return F.floor(100 * F.size(F.filter(luma, lambda x: x < threshold)) / F.size(luma)).cast("int")
