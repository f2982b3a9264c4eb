"""All queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import catalog, files, layouts, scalars, search, store, streams

MODULES = (store, catalog, scalars, streams, search, files, layouts)
PLACES = 6


def rounded(frame: DataFrame) -> DataFrame:
    """Doubles to ``PLACES`` places, as both engines sum in different orders; no negative zeros."""
    doubles = {c: F.round(c, PLACES) + 0.0 for c, kind in frame.dtypes if kind == "double"}
    return frame.withColumns(doubles) if doubles else frame


def queries() -> dict:
    found = {name: query for m in MODULES for name, query in m.QUERIES.items()}
    return {name: (lambda q: lambda spark, d: rounded(q(spark, d)))(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
