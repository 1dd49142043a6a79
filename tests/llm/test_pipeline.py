import importlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rivulet.llm import simhash
from tests.llm.test_decontamination import plain
from tests.llm.test_jaccard import brute_roots
from tests.llm.test_packing import check
from tests.llm.test_secret_scan import brute_base


def test_stages_against_brute_force(spark, sf, tmp_path):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs, seen = documents, {r.doc_id: r.text for r in documents.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert out.dtypes == documents.dtypes
            now = {r.doc_id: r.text for r in out.collect()}
            assert len(now) == out.count()
        if name == "language_id":
            assert now.keys() == {d for d, t in seen.items() if any(c.isalpha() for c in t)}
        elif name == "simhash":
            assert now.keys() == set(brute_roots(seen).values())  # five words, Jaccard 0.8 or more
        elif name == "decontamination":
            assert {d for d, t in seen.items() if any(p in plain(t) for p in items)} <= seen.keys() - now.keys()
            assert len(now) > 0.8 * len(seen)
        elif name == "secret_scan":
            assert now.keys() == seen.keys() and not any(brute_base(t) for t in now.values())
        else:
            check(out.collect(), list(seen.items()))
            continue
        docs, seen = out, now
    whole = corpus_pipeline.run(spark, sf)
    assert whole.count() == out.count() and whole.columns == out.columns


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_on_odd_rows(spark, sf, stage):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the of and to in", "en", None, 16), (3, "the of and to in", "en", "s", 16), (3, "the of and to in", "en", "s", 16), (4, "der die das " * 30_000, "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit(1), "fp": F.lit(2), "_id": F.lit(3), "ids": F.lit("x")})
    out = stage[1](spark, docs, sf)
    if stage[0] != "packing":
        assert out.dtypes == docs.dtypes
    out.collect()
    assert stage[1](spark, docs.limit(0), sf).count() == 0


def test_representatives_of_odd_groups(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (7, "A b c D"), (None, "a b c d"), (None, "x y z w"), (None, "x y z w"), (9, None), (8, ""), (6, "one two three"), (6, "other words here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, simhash.representatives(df).collect()), key=repr)
    assert got == sorted([(5, "a b c d"), (None, "x y z w"), (8, ""), (6, "one two three"), (6, "other words here now")], key=repr)


def test_entry_registers_it():
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
