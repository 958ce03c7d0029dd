"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from skeinmill.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return str(value.replace(tzinfo=None)) if hasattr(value, "replace") and hasattr(value, "year") else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = df.collect()
    assert len(df.columns) == len(set(df.columns))
    sql = catalog.oracle_sql().get(name)
    if sql:
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, cur.fetchall())


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.queries()
