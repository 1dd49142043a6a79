import random

import pytest
from pyspark.sql import functions as F

from rivulet.llm import queries, warc

SCHEMA = "record_id long, uri string, ts long, type string, headers map<string,string>"


def brute(rows):
    out = []
    for rid, url, ts, kind, headers in rows:
        if kind != "revisit":
            continue
        best = [(t, i, h) for i, u, t, k, h in rows if k == "response" and url is not None and u == url and None not in (t, ts) and t < ts]
        best = max(best, key=lambda x: x[:2], default=None)
        if best is None:
            out.append((rid, None, "orphan"))
        else:
            same = (headers or {}).get("etag") in (None, (best[2] or {}).get("etag"))
            out.append((rid, best[1], "resolved" if same else "mismatch"))
    return sorted(out)


@pytest.mark.parametrize(("seed", "partitions"), [(1, 1), (2, 7), (3, 40)])
def test_as_of_join_with_a_hot_url(spark, seed, partitions):
    rng = random.Random(seed)
    rows = []
    for k in range(600):
        url = "hot.example/x" if rng.random() < 0.4 else f"site.example/{rng.randrange(25)}"
        url = None if rng.random() < 0.02 else url
        ts = None if rng.random() < 0.02 else rng.randrange(200)
        rows.append((k, url, ts, rng.choice(["response", "revisit", "revisit", "request"]), rng.choice([None, {"etag": "a"}, {"etag": "b"}])))
    found = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA), partitions=partitions).collect()
    assert sorted((r.record_id, r.refers_to, r.status) for r in found) == brute(rows)


def test_query_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = queries.op8_warc(spark, sf)
    want = con.execute(queries.OP8_SQL)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    rows = got.collect()
    assert {r.status for r in rows} >= {"resolved", "mismatch", "orphan"}
    # neither the latest nor the earliest response of all would do
    assert {r.refers_to - 2 * r.page_id for r in rows if r.refers_to is not None} >= {0, 1}
    assert any(r.status == "resolved" and r.page_id % 5 == 0 and r.last_modified for r in rows)


def test_canonical_urls(spark):
    urls = ["HTTP://WWW.Example.COM:80/a/b/?b=2&utm_source=x&a=1#frag", "https://m.example.com/a/b?a=1&b=2", "example.com/a/b/?ref=q&b=2&a=1&", None, "", "https://example.com"]
    got = [r.c for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url(F.col("u")).alias("c")).collect()]
    assert got == ["example.com/a/b?a=1&b=2"] * 3 + [None, "", "example.com"]


def test_headers(spark):
    rows = [(1, "u", 1, "response", {"ETag": 'W/"a"', "Content-Type": "text/html", "Date": "old", "X": "1"}), (2, "u", 2, "revisit", {"etag": '"a"', "Content-Type": "none", "date": "new", "DATE": "newest"}), (3, "u", 3, "revisit", {"last-modified": "x"}), (4, "u", 1, "revisit", None), (5, "u", 9, "revisit", {}), (5, "u", 9, "revisit", {})]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"status": F.lit("s"), "canonical_url": F.lit("c"), "payload": F.col("type")})
    found = warc.resolve_revisits(df)
    by = {r.record_id: r for r in found.collect()}
    assert by[2].headers["content-type"] == "text/html" and by[2].headers["x"] == "1" and by[2].headers["date"] in ("new", "newest")
    assert {k: (r.status, r.refers_to) for k, r in by.items()} == {2: ("resolved", 1), 3: ("mismatch", 1), 4: ("orphan", None), 5: ("resolved", 1)}
    assert found.count() == 5
    bodies = {(r.record_id, r.payload) for r in warc.with_payload(found, df.where("type = 'response'")).collect()}
    assert bodies == {(2, "response"), (3, None), (4, None), (5, "response")}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_files(spark, tmp_path, compress):
    answer = b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\nContent-Type: text/html\r\n\r\n<p>WARC/1.1\r\n\r\n</p>"
    data = warc.record("response", "http://e.org/", "2020-01-01T00:00:00Z", answer, compress) + warc.record("revisit", "http://www.e.org", "2020-02-01T00:00:00Z", b'HTTP/1.1 304 Not Modified\r\nETag: "a"\r\n\r\n', compress, WARC_Profile=warc.NOT_MODIFIED)
    (tmp_path / "x.warc").write_bytes(data)
    records = warc.read_warc(spark, str(tmp_path)).withColumn("record_id", F.when(F.col("type") == "response", 1).otherwise(2))
    assert {(r.type, r.status, bytes(r.payload)) for r in records.collect()} == {("response", 200, b"<p>WARC/1.1\r\n\r\n</p>"), ("revisit", 304, b"")}
    r = warc.with_payload(warc.resolve_revisits(records), records).first()
    assert (r.status, r.refers_to, bytes(r.payload), r.headers["content-type"]) == ("resolved", 1, b"<p>WARC/1.1\r\n\r\n</p>", "text/html")


@pytest.mark.parametrize("compress", [True, False])
def test_bad_records_are_kept_with_a_mark(spark, tmp_path, compress):
    good = [warc.record("response", f"http://e.org/{k}", "2020", b"HTTP/1.1 200 OK\r\n\r\nbody", compress) for k in range(4)]
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nxyz\r\n\r\n"
    cut = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 900\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhalf"
    pack = (lambda b: __import__("gzip").compress(b, mtime=0)) if compress else (lambda b: b)
    broken = good[3][:12] + b"\xff\xff" + good[3][14:] if compress else b""
    (tmp_path / "x.warc").write_bytes(good[0] + pack(bad) + good[1] + broken + good[2] + pack(cut))
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.uri for r in rows if r.error is None) == [f"http://e.org/{k}" for k in range(3)]
    assert {r.error for r in rows if r.error} == {"content-length 'many'", "cut short"}
    assert {bytes(r.payload) for r in rows if r.error is None} == {b"body"}
