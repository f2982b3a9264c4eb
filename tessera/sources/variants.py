"""Probe documents whose form isn't fixed: as variants, which keep every tag, and a report of the forms there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tessera.operators.lineage import settle
from tessera.schema import PROBE
from tessera.sources import probe


def as_variant(documents: DataFrame, column: str = "json", name: str = "document") -> DataFrame:
    """``documents`` with the JSON of ``column`` as a variant; null where it is malformed."""
    return documents.withColumn(name, F.try_parse_json(F.col(column)))


def _taken(value: Column, kind) -> Column:
    """What of a variant has the type ``kind``, field by field; what is missing or of another type is null."""
    if isinstance(kind, StructType):
        fields = [_taken(F.try_variant_get(value, f"$.{f.name}", "variant"), f.dataType).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: _taken(v, kind.elementType))
    if isinstance(kind, (ArrayType, MapType)):
        return F.try_variant_get(value, "$", kind.simpleString())
    return F.try_variant_get(value, "$", kind.simpleString())


def parsed_probe(documents: DataFrame, column: str = "document") -> DataFrame:
    """``documents`` with the same figures as ``probe.parsed_probe``, by paths into a variant column."""
    return probe.with_figures(documents, _taken(F.col(column), StructType.fromDDL(PROBE)))


def tag(column: str, path: str, kind: str = "string") -> Column:
    """One value of a variant by its path, such as `$.format.tags.title`; null if it isn't there or of another type."""
    return F.try_variant_get(column, path, kind)


def merged_schema(documents: DataFrame, column: str = "document") -> DataFrame:
    """One row, schema: the one form that all documents have, where types differ the wider one or VARIANT."""
    return documents.agg(F.schema_of_variant_agg(column).alias("schema"))


def kind_of(value: Column) -> Column:
    name = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
    number = name.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    return F.when(name == "VOID", "null").when(number, "number").otherwise(F.lower(name))


def paths_and_kinds(documents: DataFrame, column: str = "document") -> DataFrame:
    """path, kind, n: each path of the documents with the kinds of its values and how many there are; elements of an array share a path.

    kind is object, array, string, number, boolean or null. A level of nesting is a pass over what the level before holds, and
    levels are taken until there are none; two levels are kept at a time, in as many parts as ``documents`` has. Malformed documents have no path. A path of several kinds is a drift of the form.
    """
    level = documents.filter(F.col(column).isNotNull()).select(F.lit("$").alias("path"), F.col(column).alias("value"))
    found, before = None, None
    while True:
        level = level.withColumn("kind", kind_of(F.col("value"))).persist()
        counted = settle(level.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n")))
        found = counted if found is None else found.unionByName(counted)
        if before is not None:
            before.unpersist()
        inner = level.filter(F.col("kind").isin("object", "array"))
        if counted.filter(F.col("kind").isin("object", "array")).isEmpty():
            level.unpersist()
            return found
        session = documents.sparkSession
        held = inner.lateralJoin(session.tvf.variant_explode(F.col("value").outer()).select("key", F.col("value").alias("held")))
        before, level = level, held.select(F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat("path", F.lit("."), "key")).alias("path"), F.col("held").alias("value"))
