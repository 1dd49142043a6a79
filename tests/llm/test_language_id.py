import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import language_id as L
from rivulet.llm import queries
from rivulet.llm.textbatch import held_out


@pytest.fixture(scope="module")
def model(spark, sf):
    return L.fit(spark.read.parquet(f"{sf}/documents.parquet"), train=~held_out(F.col("id")))


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    changed = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert L.fit(changed, train=~held_out(F.col("id"))) == model


def test_folded_tables_equal_the_network(model):
    s = L._scorer(model)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (5, L.WINDOW + L._PAD)).astype(np.uint8)
    p = s.net.params
    emb = p["E"][x]
    want = np.concatenate([sum(emb[:, k : k + L.WINDOW] @ p[f"F{w}"][k] for k in range(w)).max(axis=1) for w in L.WIDTHS], axis=1)
    assert np.allclose(s.pooled(x), want, atol=1e-4)


def test_gradients_against_differences():
    net = L.ByteCNN(["a", "b", "c"])
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 256, (4, L.WINDOW + L._PAD)).astype(np.uint8), np.array([0, 1, 2, 1])
    g, _ = net.gradients(x, y)
    for name in net.params:
        flat, at = net.params[name].reshape(-1), int(np.abs(g[name]).argmax())
        flat[at] += 1e-5
        up = net.gradients(x, y)[1]
        flat[at] -= 2e-5
        down = net.gradients(x, y)[1]
        flat[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[name].reshape(-1)[at]) < 1e-4, name


def test_windows_cover_whole_texts():
    texts = [b"", b"abc", bytes(range(1, 201)) * 4, b"x" * 256]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    x, row = L.windows(data, offsets)
    assert row.tolist() == [1, 2, 2, 2, 2, 3]
    for k, t in enumerate(texts):
        assert b"".join(w[: L.WINDOW].tobytes() for w in x[row == k]).rstrip(b"\0") == t
    assert x[1, L.WINDOW :].tobytes() == texts[2][L.WINDOW : L.WINDOW + L._PAD] and not x[0, 3:].any()


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !! ²"), (None, "the and of to in is was"), (4, "der die das und ist nicht"), (4, "der die das und ist nicht"), (5, "the of and " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "lang_pred": F.lit("y")})
    got = L.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert by[4].lang_pred == "de" and by[5].lang_pred == "en"
    kept = L.accepted(docs, model)
    assert kept.schema == docs.schema and kept.count() == 4
    assert L.identify(docs.limit(0), model).count() == 0
    nothing = L.fit(docs.withColumn("lang", F.lit(None)), train=F.lit(True))
    assert nothing is None and {r.lang_pred for r in L.identify(docs, nothing).collect()} == {"und"}


def test_every_language_is_learned_from_a_small_sample(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = {r.lang for r in docs.where("lang is not null").select("lang").distinct().collect()}
    model = L.fit(docs, train=F.lit(True), sample=10 * len(names))
    assert set(model[0]) == names and len(names) > 2
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    assert 250 < len(L.fit(many, train=F.lit(True), sample=300)[0]) < 350
