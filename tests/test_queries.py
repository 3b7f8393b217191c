"""Every engine query against its DuckDB SQL on the smallest driver tables."""

import os

import duckdb
import pytest

from waymark.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DATA).toArrow()
    if name not in registry.ORACLES:
        assert got.num_columns > 0
        return
    want = con.sql(registry.ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    flat = lambda t: sorted(repr([r[c] for c in columns]) for r in t.to_pylist())
    assert flat(got) == flat(want)


def test_entry_points():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert registry.FLAGSHIP in q and set(registry.QUERIES) <= set(q) and set(sql) <= set(q)
