"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from citeloom import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    return "nan" if math.isnan(number) else round(number, 5) + 0.0


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    out = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(out.columns)
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in result.fetchall())
    assert sorted(repr([plain(row[c]) for c in columns]) for row in out.collect()) == expected
