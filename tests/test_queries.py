"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from granum import queries as own

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rounded(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = own.QUERIES[name](spark, DATA)
    got = df.collect()
    want = duck.execute(own.ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(cols)
    assert rounded(got, df.columns) == rounded(want.fetchall(), cols)
