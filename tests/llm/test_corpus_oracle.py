"""The queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from planwalk.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found, wanted = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    assert rows(found.columns, map(tuple, found.collect())) == rows([d[0] for d in wanted.description], wanted.fetchall())
