"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    q = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in q.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(str(r[names.index(c)]) for c in cols) for r in q.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
