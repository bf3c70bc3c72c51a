"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from glossade.plans import registry

SF = os.environ.get("GLOSSADE_SF", "/root/testdata/sf0.001")
TABLES = "events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    names = [*want.columns]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(map(repr, got)) == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall())))
