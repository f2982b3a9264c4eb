"""Queries of the training-data operators against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from tessera.llm import entries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SF):
        duck.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    frame = entries.queries()[name](spark, SF)
    cursor = duck.execute(entries.oracle_sql()[name])
    columns = sorted(c[0] for c in cursor.description)
    assert sorted(frame.columns) == columns
    order = [[c[0] for c in cursor.description].index(c) for c in columns]
    expected = sorted([repr(r[k]) for k in order] for r in cursor.fetchall())
    assert sorted([repr(r[c]) for c in columns] for r in frame.collect()) == expected and expected
