"""The llm queries that have SQL against it, and all of them for one row per document."""

import os

import duckdb
import pytest

from marketloom.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    ours = queries.QUERIES[name](spark, DATA).select(*names)
    assert sorted(map(tuple, ours.collect()), key=str) == sorted(map(tuple, result.fetchall()), key=str)
