"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import inputs, registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def plain(rows, columns):
    """Rows by column name, every value with its type and all digits, in order."""
    return sorted([repr(r[c]) for c in sorted(columns)] for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    expected = [dict(zip(columns, r)) for r in cursor.fetchall()]
    assert plain(frame.collect(), columns) == plain(expected, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_names_are_those_of_the_modules():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) == sum(len(m.QUERIES) for m in registry.MODULES)
    assert set(inputs.TEXT).isdisjoint(inputs.TABLES)
