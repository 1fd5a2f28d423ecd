"""Every registered query of the library against its SQL in DuckDB."""

import math
from decimal import Decimal

import duckdb
import pytest

from granary.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float | Decimal):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, list | tuple):
        return str([cell(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted([cell(r[c]) for c in columns] for r in got.collect())
    if name not in SQL:
        assert rows
        return
    found = duck.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted([cell(r[names.index(c)]) for c in columns] for r in found.fetchall())
    assert rows == want
