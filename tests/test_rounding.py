"""What rounds to zero keeps its sign, as in SQL: compared by text, as -0.0 equals 0.0 as a number."""

import duckdb
import pytest

from rivulet.catalogue import CATALOGUE

TINY = [-3e-7, -0.0, 3e-7, -5e-7, -4.9e-7, 5e-7, 0.0, -0.0078125, 0.0078125, -0.1234565, 0.1234565, -1.5, 2.25]
NAMES = ["image_rotate", "image_transfer", "mirror", "tensor_transpose", "vflip", "crop", "tensor_strided", "tensor_slice"]


@pytest.fixture(scope="module")
def tiny(tmp_path_factory):
    """Vectors of one tiny value each, and of all of them in turn."""
    d = str(tmp_path_factory.mktemp("tiny"))
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    vectors = [[v] * 64 for v in TINY] + [(TINY[k:] + TINY) * 5 for k in range(len(TINY))]
    c.executemany("INSERT INTO embeddings VALUES (?, ?, 0)", [[i, v[:64]] for i, v in enumerate(vectors)])
    c.execute(f"COPY embeddings TO '{d}/embeddings.parquet' (FORMAT parquet)")
    return c, d


@pytest.mark.parametrize("name", NAMES)
def test_sign_of_zero(spark, tiny, name):
    con, d = tiny
    result = con.execute(CATALOGUE[name].sql)
    columns = [x[0] for x in result.description]
    want = sorted(map(repr, result.fetchall()))
    got = sorted(repr(tuple(r)) for r in CATALOGUE[name].run(spark, d).select(columns).collect())
    assert got == want and any("-0.0," in w for w in want)
