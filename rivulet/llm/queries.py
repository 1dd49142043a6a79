"""The queries of this subpackage: each applies one operator, with production
parameters, to its whole table, and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import base_queries, decontamination, language_id, packing, pii, quality_rules, secret_scan, simhash, substring_dedup, toxicity, warc
from rivulet.llm.textbatch import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, of spans already in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counts(spans: str, kinds: list[str]) -> list[Column]:
    def of(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [of(k) for k in kinds]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, train=~held_out(F.col("id")))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train_rows=~held_out(F.col("id")))
    found = toxicity.scored(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(table(spark, sf_dir, "documents"))
    base = F.filter("pii", lambda s: s["kind"].isin(pii.KINDS[: pii.N_BASE]))
    return found.select("doc_id", *counts("pii", pii.KINDS), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("pii")).alias("spans"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))
    base = F.filter("secrets", lambda s: s["kind"].isin(secret_scan.KINDS[: secret_scan.N_BASE]))
    return found.select("doc_id", *counts("secrets", secret_scan.KINDS), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("secrets")).alias("spans"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def crawl_of(pages: DataFrame) -> DataFrame:
    """WARC records for pages, which hold none: two full responses of each page, the second unlike the first for
    every other page, and a not-modified revisit under another form of its URL, which comes before both, between
    them, after both, or at the time of the second.  Of five revisits four give an ETag, one Last-Modified only;
    every 7th has the ETag of something else.  Pages of one canonical URL meet each other's responses."""
    page, tag = F.col("page_id"), F.col("tag")
    pages = pages.select("page_id", "url", F.md5("html").alias("tag"), F.octet_length("html").alias("size"))

    def first_or_second(n: int) -> Column:
        version = F.when((page % 2 == 0) | F.lit(n == 0), tag).otherwise(F.concat(tag, F.lit("-2")))
        headers = F.create_map(F.lit("ETag"), F.concat(F.lit('"'), version, F.lit('"')), F.lit("Last-Modified"), version, F.lit("Content-Length"), (F.col("size") + n).cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Type"), F.lit("text/html"))
        return F.struct((2 * page + n).alias("record_id"), F.col("url").alias("uri"), (8 * page + 800 * n).alias("ts"), F.lit("response").alias("type"), headers.alias("headers"))

    own = F.when(page % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit('W/"'), tag, F.lit('"')))
    validator = F.when(page % 5 == 0, F.create_map(F.lit("last-modified"), tag)).otherwise(F.create_map(F.lit("etag"), own))
    update = F.map_concat(validator, F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.concat(F.lit("max-age="), page.cast("string"))))
    uri = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_medium=again#revisit"))
    late = F.element_at(F.array(*map(F.lit, (-4, 4, 804, 800))), (page % 4 + 1).cast("int"))
    again = F.struct((-page - 1).alias("record_id"), uri.alias("uri"), (8 * page + late).alias("ts"), F.lit("revisit").alias("type"), update.alias("headers"))
    return pages.select(F.explode(F.array(first_or_second(0), first_or_second(1), again)).alias("r")).select("r.*")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(crawl_of(table(spark, sf_dir, "pages")))
    named = [F.col("headers")[k].alias(k.replace("-", "_")) for k in ("etag", "last-modified", "content-length", "cache-control", "content-type")]
    return found.select((-F.col("record_id") - 1).alias("page_id"), "canonical_url", "refers_to", "status", *named)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_pii, op4_secret_scan, op5_substring_dedup, op6_decontamination, op7_simhash, op8_warc, op9_packing, op10_quality_rules)}
    base = {"base_pii": base_queries.base_columns(op3_pii, base_queries.PII), "base_secrets": base_queries.base_columns(op4_secret_scan, base_queries.SECRETS), "base_quality": base_queries.base_quality}
    return ops | base


#: Words by their places; a window by its 50 words; the least id of each window's words.
OP5_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS seq FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), judged AS (
    SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) < doc_id AS again FROM windows
), gone AS (
    SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone_at FROM judged WHERE again GROUP BY doc_id
), kept AS (
    SELECT doc_id, w, coalesce(gone_at, []::BIGINT[]) AS gone_at FROM words LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone_at)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN len(gone_at) = 0 THEN w ELSE [w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(gone_at, k)] END, ' ')) AS kept_sha256
FROM kept
"""


OP8_SQL = r"""
WITH canon AS (
    SELECT page_id, md5(html) AS tag, strlen(html) AS size, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
), parts AS (
    SELECT page_id, tag, size,
           regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^(www[0-9]*|m)\.', ''), ':(80|443)$', '') AS host,
           regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
           list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid|sessionid)(=|$)'))) AS query
    FROM canon
), keyed AS (
    SELECT page_id, tag, size, host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS canonical_url FROM parts
), responses AS (
    SELECT canonical_url, 8 * page_id AS ts, 2 * page_id AS record_id, tag AS version, size FROM keyed
    UNION ALL
    SELECT canonical_url, 8 * page_id + 800, 2 * page_id + 1, CASE WHEN page_id % 2 = 0 THEN tag ELSE tag || '-2' END, size + 1 FROM keyed
), latest AS (
    SELECT canonical_url, ts, max(record_id) AS record_id, max_by(version, record_id) AS version, max_by(size, record_id) AS size FROM responses GROUP BY canonical_url, ts
), revisits AS (
    SELECT *, 8 * page_id + [-4, 4, 804, 800][page_id % 4 + 1] AS at FROM keyed
), judged AS (
    SELECT v.page_id, v.canonical_url, r.record_id AS refers_to, r.version, r.size, v.tag,
           CASE WHEN r.record_id IS NULL THEN 'orphan' WHEN v.tag = r.version AND (v.page_id % 5 = 0 OR v.page_id % 7 <> 0) THEN 'resolved' ELSE 'mismatch' END AS status,
           CASE WHEN v.page_id % 5 = 0 THEN NULL WHEN v.page_id % 7 = 0 THEN '"changed"' ELSE 'W/"' || v.tag || '"' END AS own
    FROM revisits v ASOF LEFT JOIN latest r ON v.canonical_url = r.canonical_url AND v.at > r.ts
)
SELECT page_id, canonical_url, refers_to, status,
       coalesce(own, CASE WHEN status = 'resolved' THEN '"' || version || '"' END) AS etag,
       CASE WHEN status = 'resolved' THEN version WHEN page_id % 5 = 0 THEN tag END AS last_modified,
       CASE WHEN status = 'resolved' THEN size::VARCHAR ELSE '0' END AS content_length,
       'max-age=' || page_id AS cache_control, CASE WHEN status = 'resolved' THEN 'text/html' END AS content_type
FROM judged
"""


def oracle_sql() -> dict[str, str]:
    base = {"base_pii": base_queries.spans_sql(base_queries.PII), "base_secrets": base_queries.spans_sql(base_queries.SECRETS), "base_quality": base_queries.QUALITY_SQL}
    return base | {"op8_warc": OP8_SQL, "op5_substring_dedup": OP5_SQL}
