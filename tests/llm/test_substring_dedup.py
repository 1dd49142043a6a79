import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import queries
from rivulet.llm.substring_dedup import deduplicated, least_places

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - 49):
                k = tuple(w[i : i + 50])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=repr)


def corpus(seed):
    """Passages of 45 to 130 words that many documents share whole, in part, or with edits; repeats inside a document."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["la", "de", "x", "é", "wo", "ri"]) + str(rng.randrange(40))
    passages = [[word() for _ in range(n)] for n in (45, 49, 50, 51, 60, 90, 130, 130)] + [["same"] * 120, ["ab", "cd"] * 60]
    rows = []
    for d in rng.sample(range(1000), 150):
        parts = []
        for _ in range(rng.randrange(5)):
            p = list(rng.choice(passages))
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p) + 1)))
            kind = rng.randrange(4)
            p = p[a:b] if kind == 0 else p
            if kind == 1:
                p[rng.randrange(len(p))] = word()
            parts += p + [word() for _ in range(rng.randrange(30))]
        rows.append((d, rng.choice(["  ", " ", "\n", "\t "]).join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"local": 1}), (3, {"filter_bits": 64})])
def test_against_brute_force(spark, seed, options):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert sum(x[2] > 0 for x in want) > 30
    assert got(deduplicated(df, **options)) == want


def test_odd_rows(spark):
    p = " ".join(f"p{k}" for k in range(60))
    rows = [(3, p), (3, p), (4, p), (4, p + " more"), (4, "other text"), (None, p), (None, None), (1, None), (2, ""), (9, " ".join(["w"] * 100_000)), (5, " ".join(["nb"] * 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit(1), "ranges": F.lit(2), "text_hash": F.lit(3), "first": F.lit(4)})
    assert got(deduplicated(df)) == brute(rows)
    assert deduplicated(df.limit(0)).count() == 0


def test_query_against_sql_and_brute_force(spark, sf):
    import duckdb

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = sorted(tuple(r) for r in queries.op5_substring_dedup(spark, sf).collect())
    assert rows == sorted((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(docs))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.execute(queries.OP5_SQL).fetchall()) == rows


def test_least_places():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 20, 300).astype(np.uint64)
    for size in (1, 2, 7, 41):
        assert least_places(v, size).tolist() == [i + int(v[i : i + size].argmin()) for i in range(len(v) - size + 1)]
