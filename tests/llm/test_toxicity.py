import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import queries
from rivulet.llm import toxicity as X
from rivulet.llm.textbatch import held_out

INSULTS = ["idiot", "scumbag", "dummkopf", "tarado"]


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "ri", "on", "el", "sch", "mu", "dé", "go"]) for _ in range(rng.randrange(1, 4)))
    docs = []
    for k in range(n):
        words = [word() + rng.choice(["", "", ".", ","]) for _ in range(rng.randrange(5, 60))]
        y = int(k % 5 == 0)
        for _ in range(y * rng.randrange(1, 3)):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        docs.append((k, " ".join(words), y))
    return docs


@pytest.fixture(scope="module")
def model():
    m = X.train([(t.encode(), y) for _, t, y in corpus(800, 1)])
    return m.table.astype(np.float32).tobytes(), m.bias, tuple(m.logistic.tolist())


def test_new_documents(model):
    docs = corpus(300, 2)
    score, term = X.score_texts([t.encode() for _, t, _ in docs], model)
    assert all((s >= 0.7) == bool(y) for s, (_, _, y) in zip(score, docs))
    assert all(t in INSULTS for t, (_, _, y) in zip(term, docs) if y)


@pytest.mark.parametrize("text", ["i d i o t", "what an i.d.i.o.t here", "IDIOT!!", "id1ot", "i-d-i-o-t", "idiiot", "s.c.u.m.b.a.g", "dum-mkopf"])
def test_gapped_and_inserted(model, text):
    assert X.score_texts([f"go ta ri {text} on el".encode()], model)[0][0] >= 0.7


@pytest.mark.parametrize("text", ["", "a a a a a a", "tion", "go ta ri on el", "###", "éé ññ", "42 4242"])
def test_clean_texts(model, text):
    assert X.score_texts([text.encode()], model)[0][0] < 0.3


def brute_kernel(s, t):
    def phi(u):
        out = {}
        for i in range(len(u)):
            for j in range(i + 1, len(u)):
                for k in range(j + 1, min(len(u), i + X.REACH + 1)):
                    out[u[i] + u[j] + u[k]] = out.get(u[i] + u[j] + u[k], 0) + X.DECAY ** (k - i + 1)
        return out

    a, b = phi(s), phi(t)
    dot = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5


def test_kernel_against_brute_force():
    strings = ["idiot", "idiiot", "banana", "ßäüéñ", "abcabcabc", "xyz"]
    got = X.Landmarks(X._codes(strings)[0]).kernel(X._codes(strings)[0])
    assert np.allclose(got, [[brute_kernel(s, t) for t in strings] for s in strings])


def test_folded_margin_is_the_svm_on_nystroem_features():
    strings = ["idiot", "idiots", "moron", "the", "tion", "onion"]
    codes = X._codes(strings)[0]
    land = X.Landmarks(codes[:4])
    weights = np.array([0.3, -0.2, 0.9, -0.5])
    table = np.zeros(X._N**3)
    table[land.triples] = (land.dense @ weights)[:-1]
    assert np.allclose(X.Model(table, 0.25).margins(strings), land.kernel(codes) @ weights + 0.25)


def test_query(spark, sf):
    rows = queries.op2_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_fit_and_odd_rows(spark):
    docs = spark.createDataFrame([(k, t) for k, t, _ in corpus(400, 3)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in corpus(400, 3)], "doc_id long, toxic int")
    model = X.fit(docs, labels, train_rows=~held_out(F.col("id")))
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.fit(docs, flipped, train_rows=~held_out(F.col("id"))) == model
    rows = [(1, None), (2, ""), (3, "go idiot ta"), (3, "go idiot ta"), (None, "go ta ri"), (4, "ta " * 200_000 + "idiot"), (5, "x" * 300_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("a"), "term": F.lit(1)})
    got = X.scored(odd, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] < 0.3 and by[3] >= 0.7
    assert X.scored(odd.limit(0), model).count() == 0
    none = X.fit(docs, labels.where("toxic = 0"), train_rows=F.lit(True))
    assert none is None and {r.score for r in X.scored(odd, none).collect()} == {0.0}
