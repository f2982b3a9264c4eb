"""Directories of files, lists of paths, and snapshots of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators.store import fingerprints
from tessera.sources.logs import processed_paths


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None, recursive: bool = True, content: bool = False) -> DataFrame:
    """path, size, modified (and content) of the files below ``root``; unreadable ones are left out. Content is only read if asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    files = reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return files.filter(paths.has_extension(F.col("path"), extensions)) if extensions else files


def hashed(files: DataFrame) -> DataFrame:
    """Files with content, by hashes in place of it."""
    return files.withColumns(fingerprints(F.col("content"))).drop("content")


def snapshot_key(root: str, kind: str, recursive: bool, extensions: list[str]) -> str:
    import hashlib

    return hashlib.sha256("|".join([root, kind, str(recursive), *sorted(set(map(str.lower, extensions)))]).encode()).hexdigest()


def write_snapshot(files: DataFrame, folder: str, key: str) -> None:
    files.write.mode("overwrite").parquet(f"{folder}/{key}")


def read_snapshot(spark: SparkSession, folder: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{key}")


def read_paths(spark: SparkSession, file: str) -> DataFrame:
    """One path per line, blank lines left out; a file that isn't UTF-8 throughout has none."""
    return processed_paths(spark, file)


def write_paths(files: DataFrame, file: str) -> None:
    files.select("path").distinct().write.mode("overwrite").text(file)


def read_table(spark: SparkSession, location: str, kind: str = "parquet", schema=None, **options: str) -> DataFrame:
    """A table in any format that Spark reads."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(location)


def write_table(frame: DataFrame, location: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = frame.write.format(kind).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(location)
