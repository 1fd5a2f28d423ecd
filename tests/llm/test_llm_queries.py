"""The registered queries with SQL against DuckDB, on whole tables."""

import duckdb
import pytest

from granary.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(map(str, r)) for r in got.select(*names).collect()) == sorted(tuple(map(str, r)) for r in found.fetchall())
    assert set(ORACLE_SQL) <= set(QUERIES)
