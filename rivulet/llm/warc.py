"""WARC records, and the resolution of not-modified revisits.

A revisit of the profile "server not modified" has no body: it stands for the
latest earlier full response of its canonical URL, provided that the validators
agree (ETag, weakly compared, else Last-Modified).  A 304 answer updates the
stored headers, except those that describe the connection or the stored body.

The as-of join never gathers a URL's records in one task.  Records (without
bodies) are range-partitioned by URL and time; inside a partition a window finds
the latest earlier response; a URL that runs over several partitions, of which
there are at most as many as partitions, hands its latest response on by a table
of one row for each of its partitions.

Defined results: a null URL or time makes a revisit an orphan and a response no
reference; of responses at one time the larger id counts as later, and none at a
revisit's own time is earlier; null headers are empty ones, header names are
case-insensitive and the last of equal names holds; repeated revisits are resolved
as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm.shared_tables import written

NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Headers that a 304 answer does not update.
KEPT_HEADERS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
#: Bytes of bodies that a reader holds before it gives them on.
READ_BYTES = 16 << 20
#: Query parameters that name a visit, not a page.
TRACKING = "utm_[a-z]+|ref|gclid|fbclid|sessionid"


def canonical_url(url: Column) -> Column:
    """Host without www or m, path without its last slash, sorted query without tracking; no scheme, port 80 or 443, or fragment."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^(www[0-9]*|m)\.", "")
    host = F.regexp_replace(host, r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(rf"^({TRACKING})(=|$)"))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise("")))


def lower_headers(headers: Column) -> Column:
    """Headers under lower-case names; the last of equal names holds."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))

    def last(all_: Column) -> Column:
        return F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda x: x["key"] == e["key"]))

    return F.map_from_entries(F.element_at(F.transform(F.array(entries), last), 1))


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored headers, with those that a 304 answer may update taken from it."""
    fresh = F.map_filter(update, lambda k, v: ~k.isin(KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.coalesce(F.map_contains_key(fresh, k), F.lit(False))), fresh)


def _agree(stored: Column, update: Column) -> Column:
    def weak(tag: Column) -> Column:
        return F.regexp_replace(tag, "^W/", "")

    tags = weak(F.get(F.map_values(F.map_filter(update, lambda k, v: k == "etag")), F.lit(0)))
    mine = weak(F.get(F.map_values(F.map_filter(stored, lambda k, v: k == "etag")), F.lit(0)))
    when = F.get(F.map_values(F.map_filter(update, lambda k, v: k == "last-modified")), F.lit(0))
    mine_when = F.get(F.map_values(F.map_filter(stored, lambda k, v: k == "last-modified")), F.lit(0))
    return F.when(tags.isNotNull(), F.coalesce(tags == mine, F.lit(False))).when(when.isNotNull(), F.coalesce(when == mine_when, F.lit(False))).otherwise(True)


def resolve_revisits(records: DataFrame, *, id_col: str = "record_id", uri_col: str = "uri", ts_col: str = "ts", type_col: str = "type", headers_col: str = "headers", partitions: int | None = None) -> DataFrame:
    """One row for each revisit: record_id, canonical_url, ts, refers_to, status, headers.

    status: resolved, mismatch (the validators of the latest earlier response
    differ; refers_to names it, headers are the revisit's own), or orphan.
    """
    spark = records.sparkSession
    rows = records.where(F.col(type_col).isin("response", "revisit")).select(
        F.col(id_col).cast("long").alias("record_id"),
        canonical_url(F.col(uri_col)).alias("canonical_url"),
        F.col(ts_col).alias("ts"),
        (F.col(type_col) == "response").alias("full"),
        lower_headers(F.col(headers_col)).alias("headers"),
    )
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.where(usable).repartitionByRange(n, "canonical_url", "ts", "full", "record_id").withColumn("part", F.spark_partition_id())
    placed = written(placed, "warc-records")

    reference = F.struct("ts", "record_id", "headers")
    order = [F.col("ts"), F.col("full"), F.col("record_id").asc_nulls_first()]
    before = Window.partitionBy("part", "canonical_url").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = placed.withColumn("found", F.last(F.when(F.col("full"), reference), ignorenulls=True).over(before)).where("not full").drop("full")

    spans = placed.groupBy("canonical_url").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("canonical_url")
    tails = placed.join(spans, "canonical_url").groupBy("canonical_url", "part").agg(F.max_by(F.when(F.col("full"), reference), F.when(F.col("full"), F.struct("ts", "record_id"))).alias("tail"))
    earlier = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(F.col("canonical_url").alias("url"), F.col("part").alias("p"), F.last("tail", ignorenulls=True).over(earlier).alias("carried")).where("carried is not null")
    carried = written(carried, "warc-carried")
    joined = here.join(carried, (F.col("canonical_url") == F.col("url")) & (F.col("part") == F.col("p")), "left")
    joined = joined.withColumn("found", F.coalesce("found", "carried"))

    lost = rows.where(~usable & ~F.col("full")).select("record_id", "canonical_url", "ts", F.lit(None).cast("long").alias("refers_to"), F.lit("orphan").alias("status"), "headers")
    stored, own = F.col("found")["headers"], F.col("headers")
    status = F.when(F.col("found").isNull(), "orphan").when(_agree(stored, own), "resolved").otherwise("mismatch")
    out = joined.withColumn("status", status).select(
        "record_id", "canonical_url", "ts", F.col("found")["record_id"].alias("refers_to"), "status", F.when(F.col("status") == "resolved", merged_headers(stored, own)).otherwise(own).alias("headers")
    )
    return out.unionAll(lost)


def with_payload(resolved: DataFrame, records: DataFrame, *, id_col: str = "record_id", payload_col: str = "payload") -> DataFrame:
    """Resolved revisits with the body they stand for (null otherwise)."""
    bodies = records.select(F.col(id_col).cast("long").alias("body_of"), F.col(payload_col).alias("payload"))
    wanted = F.when(F.col("status") == "resolved", F.col("refers_to"))
    return resolved.join(bodies, wanted == F.col("body_of"), "left").drop("body_of")


def _members(data: bytes) -> Iterator[bytes]:
    """The contents of a file, gzip members one by one; what follows a broken member is looked for behind it."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while 0 <= at < len(data):
        d = zlib.decompressobj(31)
        try:
            yield d.decompress(memoryview(data)[at:]) + d.flush()
            at = len(data) - len(d.unused_data)
        except zlib.error:
            at = data.find(b"\x1f\x8b\x08", at + 1)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a WARC file, plain or gzip by member.

    A record without its length, or cut short, has a field ``error`` and what there
    is of its block; reading goes on at the next record's first line.
    """
    rest = b""
    for member in _members(data):
        rest += member
        at = 0
        while (at := rest.find(b"WARC/", at)) >= 0:
            end = rest.find(b"\r\n\r\n", at)
            if end < 0:
                break
            fields = _fields(rest[at:end].decode("utf-8", "replace"))
            size = fields.get("content-length", "")
            if not size.isdecimal():
                following = rest.find(b"\r\nWARC/", end + 4)
                stop = len(rest) if following < 0 else following
                yield fields | {"error": f"content-length {size!r}"}, rest[end + 4 : stop]
            else:
                stop = end + 4 + int(size)
                if stop > len(rest):
                    break  # goes on in the next member
                yield fields, rest[end + 4 : stop]
            at = stop
        rest = rest[at:] if at >= 0 else b""
    if rest:
        head, _, block = rest.partition(b"\r\n\r\n")
        yield _fields(head.decode("utf-8", "replace")) | {"error": "cut short"}, block


def _fields(head: str) -> dict[str, str]:
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in head.split("\r\n")[1:])}


def http_parts(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, headers and body of an HTTP answer."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    status = lines[0].split(" ")
    fields = dict((n.strip().lower(), v.strip()) for n, _, v in (x.partition(":") for x in lines[1:]))
    return (int(status[1]) if len(status) > 1 and status[1].isdigit() else None), fields, body


def record(kind: str, uri: str, date: str, block: bytes, compress: bool = True, **fields: str) -> bytes:
    """One WARC record."""
    head = {"WARC-Type": kind, "WARC-Target-URI": uri, "WARC-Date": date, **{k.replace("_", "-"): v for k, v in fields.items()}, "Content-Length": str(len(block))}
    out = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"
    return gzip.compress(out, mtime=0) if compress else out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: type, uri, ts (WARC-Date as text), profile, status, headers, payload, error.

    A file is read whole (Spark has no other reader for binary files); its records
    are unpacked and given on one by one.  error: null, or why a record is not sound.
    """
    schema = "type string, uri string, ts string, profile string, status int, headers map<string,string>, payload binary, error string"
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
    names = ["type", "uri", "ts", "profile", "status", "headers", "payload", "error"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for data in batch.column("content"):
                for fields, block in parse(data.as_py()):
                    status, headers, body = http_parts(block)
                    rows.append((fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-profile"), status, list(headers.items()), body, fields.get("error")))
                    size += len(body)
                    if size > READ_BYTES:
                        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
                        rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
