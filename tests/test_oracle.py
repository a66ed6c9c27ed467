"""Every registered query over the domain tables against its DuckDB text, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__  # noqa: F401
from planwalk import registry
from planwalk.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(str(tuple(str(fix(r[i])) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, con, name):
    found = registry.QUERIES[name](spark, SF)
    wanted = con.execute(registry.ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, map(tuple, found.collect())) == rows(names, wanted.fetchall())


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
