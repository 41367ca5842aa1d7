"""Every query with SQL gives what DuckDB gives for it: columns and rows."""

import decimal
from pathlib import Path

import duckdb
import pytest

from shelfwise.plans import queries as plans
from shelfwise.plans import rules  # noqa: F401  registers its queries with the others


@pytest.fixture(scope="module")
def tables(sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal | float):
        return f"{float(value):.6f}"
    if isinstance(value, dict):
        return str(sorted((str(k), plain(v)) for k, v in value.items()))
    return str([plain(v) for v in value]) if isinstance(value, list | tuple) else str(value)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_is_as_its_sql(spark, sf_dir, tables, name):
    found = plans.QUERIES[name](spark, sf_dir)
    expected = tables.sql(plans.ORACLE_SQL[name])
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    chosen = ", ".join(f'"{c}"' for c in columns)
    theirs = tables.sql(f"SELECT {chosen} FROM ({plans.ORACLE_SQL[name]})").fetchall()
    mine = [tuple(r[c] for c in columns) for r in found.collect()]
    assert sorted(tuple(map(plain, r)) for r in mine) == sorted(tuple(map(plain, r)) for r in theirs)
