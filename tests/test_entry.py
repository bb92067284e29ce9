import os

import duckdb
import pytest

import __spark_entry__ as contract

DATA = os.environ.get("SHELFMARK_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) if not isinstance(r[i], float) else f"{r[i]:.5f}" for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(DATA)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, DATA)
    want = duck.execute(contract.oracle_sql()[name])
    assert rows_of(got.columns, got.collect()) == rows_of([c[0] for c in want.description], want.fetchall())


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
