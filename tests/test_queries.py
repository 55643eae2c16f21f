"""Every query with SQL gives the same rows as DuckDB; the others give rows."""

import os

import duckdb
import pytest

from brindle.plans import queries

TABLES = "documents embeddings benchmark conversations".split()


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def key(row):
    return tuple((0, "") if x is None else (1, round(x, 6)) if isinstance(x, float) else (1, x) if isinstance(x, (bool, int)) else (2, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, small, sql, name):
    df = queries.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(key(r) for r in df.select(*columns).collect())
    if name not in queries.oracle_sql():
        assert got
        return
    found = sql.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(key([r[i] for i in at]) for r in found.fetchall())


def test_entry(spark, small):
    import __spark_entry__

    assert os.path.isdir(__spark_entry__.SMOKE_DIR) and __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
