"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from rivulet.catalogue import CATALOGUE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in order], sorted((tuple(r[k] for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", [n for n, q in CATALOGUE.items() if q.sql])
def test_against_sql(spark, sf, con, name):
    df = CATALOGUE[name].run(spark, sf)
    result = con.execute(CATALOGUE[name].sql)
    want = rows([d[0] for d in result.description], result.fetchall())
    got = rows(df.columns, df.collect())
    assert got == want and got[1]


@pytest.mark.parametrize("name", [n for n, q in CATALOGUE.items() if not q.sql])
def test_runs(spark, sf, name):
    assert CATALOGUE[name].run(spark, sf).count() > 0
