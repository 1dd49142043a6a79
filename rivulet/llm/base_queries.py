"""The base columns of personal data, secrets and quality, which SQL can state: each
query takes them from its operator, each SQL finds them anew from the contract.

A pattern's matches and the gaps between them give the places; the SQL marks the
matches by a character that the texts don't hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import quality_rules

_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN i % 2 = 0 THEN substr(reverse({_DIGITS}), i + 1, 1)::INT ELSE (2 * substr(reverse({_DIGITS}), i + 1, 1)::INT - 1) % 9 + 1 END for i in range(length({_DIGITS})) if substr(reverse({_DIGITS}), i + 1, 1) <> '0'])"
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

#: Kind: pattern, and what a match v must meet.
PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len([p for p in string_split(v, '.') if coalesce(try_cast(p AS HUGEINT), 256) > 255]) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND coalesce({_LUHN}, 0) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
}
SECRETS = {
    "assign": (_ASSIGN, f"length(regexp_extract(v, '{_ASSIGN}', 2)) >= 6"),
    "access": ("AKIA[A-Z0-9]+", "length(v) >= 20"),
    "hex": ("[0-9a-f]+", "length(v) >= 24"),
}


def spans_sql(kinds: dict[str, tuple[str, str]]) -> str:
    found = " UNION ALL ".join(
        f"""SELECT doc_id, '{kind}' AS kind, {k} AS k, start, start + length(v) AS stop FROM (
            SELECT doc_id, m[i] AS v, list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS start FROM (
                SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
                    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split(regexp_replace(t, '{pattern}', chr(1), 'g'), chr(1)) AS gaps FROM texts
                )
            )
        ) WHERE {test}"""
        for k, (kind, (pattern, test)) in enumerate(kinds.items())
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in kinds)
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({found})
SELECT doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k), '')) AS base_sha256
FROM texts LEFT JOIN found USING (doc_id) GROUP BY doc_id"""


QUALITY_SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS seq FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)
), again AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, seq) AS n FROM windows) WHERE n > 1
), repeats AS (
    SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM again) GROUP BY doc_id
), counted AS (
    SELECT doc_id, len(w) AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines, coalesce(n, 0) AS n_repeat_words
    FROM words LEFT JOIN repeats USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
FROM counted
"""


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.text_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.base_failed().alias("base_failed"))


def base_columns(op: Callable[[SparkSession, str], DataFrame], kinds: dict[str, tuple[str, str]]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in kinds), "base_sha256")
