"""Resumable work: an append-only log of what was done, and what that leaves to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = ["size", "mtime", "ctime", "btime"]
HEADER = ["format_version", "target_dir", "output_root", "cache_algorithm_version", "cache_schema_version"]


def compatible(header: DataFrame, expected: dict) -> DataFrame:
    """The headers that equal the expected one in every field but the time."""
    same = F.lit(True)
    for field in HEADER:
        same = same & F.col(field).eqNullSafe(F.lit(expected[field]))
    return header.filter(same)


def latest(log: DataFrame) -> DataFrame:
    """The last entry of each path, by position in the log."""
    newest = F.max_by(F.struct("path", *SIGNATURE), F.col("seq"))
    return log.filter(F.col("kind") == "entry").groupBy("path").agg(newest.alias("_e")).select("_e.*")


def validity(entries: DataFrame, files: DataFrame) -> DataFrame:
    """path, status of each completed entry: valid, changed, unreadable (its size can't be read) or missing."""
    now = files.select("path", *[F.col(c).alias(f"_{c}") for c in SIGNATURE], F.lit(True).alias("_there"))
    same = F.lit(True)
    for c in SIGNATURE:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    status = F.when(F.col("_there").isNull(), "missing").when(F.col("_size").isNull(), "unreadable").when(same, "valid").otherwise("changed")
    return entries.join(now, "path", "left").select("path", status.alias("status"))


def pending(files: DataFrame, completed: DataFrame) -> DataFrame:
    """The files that aren't completed."""
    return files.join(completed.select("path"), "path", "left_anti").select(*files.columns)


def resume(files: DataFrame, log: DataFrame, expected: dict) -> DataFrame:
    """What is left to do: all files if no compatible header is there, else those without a valid last entry."""
    header = compatible(log.filter(F.col("kind") == "header"), expected).limit(1).select(F.lit(True).alias("_good"))
    entries = latest(log).join(F.broadcast(header)).drop("_good")
    good = validity(entries, files).filter(F.col("status") == "valid")
    return pending(files, good)


def compacted(log: DataFrame) -> DataFrame:
    """The log with its last header and the last entry of each path only."""
    header = log.filter(F.col("kind") == "header").orderBy(F.desc("seq")).limit(1)
    last = log.filter(F.col("kind") == "entry").groupBy("path").agg(F.max_by(F.struct(*log.columns), F.col("seq")).alias("_e")).select("_e.*")
    return header.unionByName(last)


def output_intact(outputs: DataFrame, least: int = 1) -> DataFrame:
    """``outputs`` with intact: there, and of at least ``least`` bytes."""
    return outputs.withColumn("intact", F.coalesce((F.col("length") > 0) & (F.col("length") >= least), F.lit(False)))
