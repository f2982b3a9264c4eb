"""Snapshots of a tree of files that are refreshed directory by directory."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import catalog
from tessera.sources.keyed import _children

DIRECTORY = "directory string, mtime long"
ENTRY = "directory string, path string, size long, modified long, is_directory boolean"
#: Buckets of directories that a snapshot's files are partitioned by.
PARTS = 256


def part_of(directory: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(directory), F.lit(parts)).cast("int")


def changed_directories(known: DataFrame, current: DataFrame) -> DataFrame:
    """Those of ``current`` (directory, mtime) that ``known`` doesn't have with the same time."""
    return current.join(known, ["directory", "mtime"], "left_anti")


def refreshed(files: DataFrame, known: DataFrame, current: DataFrame, listed: DataFrame) -> DataFrame:
    """The snapshot ``files`` (directory, ...) brought up to date: files of directories that are as they were, and what was ``listed`` of the changed ones.

    Directories that are gone lose their files; what ``listed`` has of unchanged ones doesn't count.
    """
    same = current.join(known, ["directory", "mtime"], "left_semi").select("directory")
    changed = changed_directories(known, current).select("directory")
    return files.join(same, "directory", "left_semi").unionByName(listed.join(changed, "directory", "left_semi").select(*files.columns))


def _times(directories: DataFrame) -> DataFrame:
    """(directory, mtime) as the file system has them now, in nanoseconds; those that are gone are left out. Tasks ask, not the driver."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for directory in batch["directory"]:
                try:
                    if os.path.isdir(directory):
                        found.append((directory, os.stat(directory).st_mtime_ns))
                except OSError:
                    continue
            yield pd.DataFrame({"directory": pd.Series([f[0] for f in found], dtype=object), "mtime": pd.Series([f[1] for f in found], dtype="int64")})

    return directories.select("directory").mapInPandas(asked, DIRECTORY)


def _entries(directories: DataFrame) -> DataFrame:
    """What the directories hold; those that can't be read hold nothing."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for directory in batch["directory"]:
                try:
                    with os.scandir(directory) as entries:
                        for e in entries:
                            info = e.stat()
                            rows.append((directory, e.path, info.st_size, info.st_mtime_ns, e.is_dir()))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["directory", "path", "size", "modified", "is_directory"], dtype=object)

    return directories.select("directory").mapInPandas(listed, ENTRY)


def image_keys(files: DataFrame, root: str) -> DataFrame:
    """Files with the keys that the image queue is sorted by, as far as their names tell; pixel_count is unknown."""
    images = files.filter(paths.kind(F.col("path")) == "image")
    return images.withColumns({"relative_depth": paths.depth(F.col("path"), root), "format_priority": paths.format_priority(F.col("path")), "pixel_count": F.lit(None).cast("long")})


def video_keys(files: DataFrame, root: str) -> DataFrame:
    videos = files.filter(paths.kind(F.col("path")) == "video")
    return videos.withColumn("relative_depth", paths.depth(F.col("path"), root))


class Snapshot:
    """A snapshot in ``folder`` of the tree below ``root``, a path that all tasks can open.

    files/part=k has the files of the directories of bucket k, with the columns that ``probe`` gives them, such as
    ``image_keys``; directories/version=n has the directories and their times. A refresh asks all known directories for their times, lists and probes only
    those that changed or are new, and overwrites the buckets that they or lost ones are in.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str, probe: Callable[[DataFrame, str], DataFrame] = image_keys, parts: int = PARTS):
        self.spark, self.root, self.folder, self.probe, self.parts = spark, os.path.abspath(root), folder, probe, parts

    def version(self) -> int | None:
        done = [f for f in _children(self.spark, f"{self.folder}/directories") if any(c.endswith("/_SUCCESS") for c in _children(self.spark, f))]
        return max((int(f.rpartition("=")[2]) for f in done), default=None)

    def directories(self) -> DataFrame:
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], DIRECTORY)
        return self.spark.read.schema(DIRECTORY).parquet(f"{self.folder}/directories/version={version:012d}")

    def files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/files").drop("part")

    def queue(self, order: list[Column] | None = None) -> DataFrame:
        """The files in order: by default that of images."""
        return self.files().orderBy(*(order or catalog.image_order()))

    def _scan(self, start: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(directories with times, entries) of ``start`` and of the directories below it that aren't known yet, level by level."""
        known = self.directories().select("directory").persist()
        times = entries = None
        level = start
        while True:
            # a directory's time is taken before its list, so that a change in between shows next time
            now = _times(level).persist()
            found = _entries(now).persist()
            times = now if times is None else times.unionByName(now)
            entries = found if entries is None else entries.unionByName(found)
            level = found.filter("is_directory").select(F.col("path").alias("directory")).join(known, "directory", "left_anti").persist()
            if level.isEmpty():
                return times, entries.filter("not is_directory").drop("is_directory")

    def refresh(self) -> DataFrame:
        """Bring the snapshot up to date and return the directories that were read again, (directory, mtime)."""
        version, known = self.version(), self.directories()
        seen = known.select("directory").union(self.spark.createDataFrame([(self.root,)], "directory string")).distinct()
        current = _times(seen.repartition("directory")).persist()
        changed, entries = self._scan(changed_directories(known, current))
        changed = changed.persist()
        part = part_of(F.col("directory"), self.parts).alias("part")
        every = current.join(changed.select("directory"), "directory", "left_anti").unionByName(changed).persist()
        lost = known.join(every, "directory", "left_anti").select("directory")
        touched = [r["part"] for r in changed.select("directory").union(lost).select(part).distinct().collect()]
        fresh = self.probe(entries, self.root)
        if version is None:
            old = fresh.limit(0)
        else:
            stored = self.spark.read.parquet(f"{self.folder}/files")
            old = stored.filter(F.col("part").isin(touched)).drop("part").join(every.join(changed.select("directory"), "directory", "left_anti").select("directory"), "directory", "left_semi")
        if touched:
            rows = old.unionByName(fresh).select("*", part).persist()
            there = {r["part"] for r in rows.select("part").distinct().collect()}  # also settles the rows before their old files go
            rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.folder}/files")
            for gone in set(touched) - there:  # nothing is left in it, which an overwrite doesn't see
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/files/part={gone}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        number = 0 if version is None else version + 1
        every.coalesce(8).write.mode("overwrite").parquet(f"{self.folder}/directories/version={number:012d}")
        return changed
