"""Tables bucketed by their key, whose buckets have versions of their own; a manifest of those is the commit point."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.store import upsert, upsert_latest

#: Most buckets of a table: what a manifest has rows for, and what the driver lists.
MAX_BUCKETS = 65_536
#: Bytes of a bucket that ``vacuum`` aims at.
TARGET_BYTES = 128 << 20
#: Partitions that one statement adds to the catalog.
ADDED = 500
#: Bucket of the manifest's row about the table itself.
HEAD = -1
_MANIFEST = "bucket int, folder string, bytes long, low long, about string"


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, folder: str) -> list[str]:
    path, files = _path(spark, folder)
    return sorted(s.getPath().toString() for s in files.listStatus(path)) if files.exists(path) else []


def current_version(spark: SparkSession, location: str) -> int | None:
    """The last committed version of a keyed table, None before the first."""
    found = [f for f in _children(spark, f"{location}/manifest") if any(c.endswith("/_SUCCESS") for c in _children(spark, f))]
    return max((int(f.rpartition("=")[2]) for f in found), default=None)


def manifest(spark: SparkSession, location: str, version: int | None = None) -> DataFrame:
    """bucket, folder, bytes, low of each bucket that has rows, as of ``version`` or the last one; the row of bucket HEAD tells what the table is."""
    version = current_version(spark, location) if version is None else version
    if version is None:
        raise ValueError(f"no keyed table at {location}")
    return spark.read.schema(_MANIFEST).parquet(f"{location}/manifest/version={version:012d}")


def _about(rows: DataFrame) -> dict:
    return json.loads(rows.filter(F.col("bucket") == HEAD).first()["about"])


def bucket_of(key: list[str], buckets: int) -> Column:
    """The bucket that Spark deals a row to."""
    return F.pmod(F.hash(*key), F.lit(buckets)).cast("int")


def _slot(about: dict) -> Column:
    return bucket_of(about["key"], about["buckets"]).alias("_slot")


def _write(rows: DataFrame, location: str, about: dict) -> DataFrame:
    """Manifest rows of a new folder with ``rows``, one sorted file for each bucket."""
    spark, name = rows.sparkSession, f"keyed_{uuid.uuid4().hex}"
    folder, key = f"{location}/data/{name}", about["key"]
    writer = rows.select("*", _slot(about)).repartition("_slot").write.format("parquet").option("path", folder).partitionBy("_slot")
    for column in about["bloom"]:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    for option, value in about["options"].items():
        writer = writer.option(option, value)
    writer.bucketBy(about["buckets"], *key).sortBy(*key).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    slot = F.regexp_extract("path", r"/_slot=(\d+)/", 1).cast("int").alias("bucket")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select(slot, "length")
    made = files.groupBy("bucket").agg(F.sum("length").alias("bytes"))
    if about["low"]:
        lows = spark.read.parquet(folder).groupBy(F.col("_slot").alias("bucket")).agg(F.min(about["low"]).cast("long").alias("low"))
        made = made.join(lows, "bucket", "left")
    else:
        made = made.withColumn("low", F.lit(None).cast("long"))
    return made.select("bucket", F.concat(F.lit(f"{folder}/_slot="), F.col("bucket").cast("string")).alias("folder"), "bytes", "low", F.lit(None).cast("string").alias("about"))


def _commit(rows: DataFrame, location: str, about: dict, version: int) -> int:
    """Note the buckets ``rows`` as a version. It counts once Spark has marked it as written to its end; a version that another writer has noted is an error."""
    head = rows.sparkSession.createDataFrame([(HEAD, None, None, None, json.dumps(about))], _MANIFEST)
    rows.unionByName(head).coalesce(1).write.mode("error").parquet(f"{location}/manifest/version={version:012d}")
    return version


def create(
    frame: DataFrame, location: str, key: list[str], buckets: int, bloom: list[str] | None = None, low: str | None = None, options: dict[str, str] | None = None
) -> int:
    """A keyed table of the rows of ``frame``, unique by ``key``: version 0.

    Files have Bloom filters on the columns ``bloom``, by default the key; of the column ``low`` the manifest keeps each bucket's least value. ``options`` are Parquet's. Rows
    with a null key are rows like others. There may be no table at ``location`` yet.
    """
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"{buckets} buckets: from 1 to {MAX_BUCKETS}")
    if "_slot" in map(str.lower, frame.columns):
        raise ValueError("_slot is the name of the bucket")
    about = {"key": key, "buckets": buckets, "bloom": key if bloom is None else bloom, "low": low, "options": options or {}, "schema": frame.schema.json()}
    return _commit(_write(frame, location, about), location, about, 0)


def read(spark: SparkSession, location: str, version: int | None = None) -> DataFrame:
    """The table as of ``version``, or the last committed one.

    Spark knows it as bucketed and sorted: joins and aggregates on the key don't shuffle it, and a filter on one key reads one bucket.
    """
    version = current_version(spark, location) if version is None else version
    rows = manifest(spark, location, version)
    about = _about(rows)
    name = f"keyed_{hashlib.sha256(location.encode()).hexdigest()[:24]}_{version}"
    schema = StructType.fromJson(json.loads(about["schema"]))
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = ", ".join(f"`{c}`" for c in about["key"])
        spark.sql(f"CREATE TABLE {name} ({columns}, _slot INT) USING parquet PARTITIONED BY (_slot) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {about['buckets']} BUCKETS LOCATION '{location}/data'")
        live = [f"PARTITION (_slot={r['bucket']}) LOCATION '{r['folder']}'" for r in rows.filter(F.col("bucket") != HEAD).select("bucket", "folder").collect()]
        for at in range(0, len(live), ADDED):
            spark.sql(f"ALTER TABLE {name} ADD {' '.join(live[at : at + ADDED])}")
    return spark.table(name)


def _plain(table: DataFrame) -> DataFrame:
    return table.drop("_slot")


def records(spark: SparkSession, location: str, version: int | None = None) -> DataFrame:
    """``read`` with the table's own columns only."""
    return _plain(read(spark, location, version))


def point(spark: SparkSession, location: str, key: dict) -> DataFrame:
    """The row of one ``key`` (column -> value): one bucket's file is read, and of it the row groups that may hold the key."""
    version = current_version(spark, location)
    about, table = _about(manifest(spark, location, version)), read(spark, location, version)
    values = {c: F.lit(key[c]).cast(table.schema[c].dataType) for c in about["key"]}
    found = table.filter(F.col("_slot") == F.pmod(F.hash(*values.values()), F.lit(about["buckets"])))
    for column, value in values.items():
        found = found.filter(F.col(column) == value)
    return _plain(found)


def _replace(spark: SparkSession, location: str, touched: list[int], changed, more: dict | None = None) -> int:
    """Commit ``changed`` (the touched buckets' rows -> what stays of them) in place of the touched buckets."""
    version = current_version(spark, location)
    old = manifest(spark, location, version)
    about = _about(old) | (more or {})
    rows = _plain(read(spark, location, version).filter(F.col("_slot").isin(touched)))
    made = _write(changed(rows), location, about)
    kept = old.filter((F.col("bucket") != HEAD) & ~F.col("bucket").isin(touched))
    return _commit(kept.unionByName(made), location, about, version + 1)


def put(changes: DataFrame, location: str, order: list[str], latest: bool = False) -> int | None:
    """Rows of ``changes`` in place of those of the same key, the last by ``order`` of several; the new version, None if there are none.

    With ``latest`` a row that is there stays if it comes after the change by ``order``, which the table must have, so that changes may be put in any order.
    Only the buckets that the changes fall in are read and written; the others stay as they are, and readers see all of the new
    version or nothing of it.
    """
    spark = changes.sparkSession
    about = _about(manifest(spark, location))
    touched = [r["_slot"] for r in changes.select(_slot(about)).distinct().collect()]
    merge = upsert_latest if latest else upsert
    return _replace(spark, location, touched, lambda rows: merge(rows, changes, about["key"], order)) if touched else None


def expire(spark: SparkSession, location: str, before: int) -> int | None:
    """Remove the rows whose ``low`` column is below ``before``; buckets whose least value isn't are not even read. The new version, None if nothing can go."""
    old = manifest(spark, location)
    column = _about(old)["low"]
    touched = [r["bucket"] for r in old.filter((F.col("bucket") != HEAD) & (F.col("low") < before)).select("bucket").collect()]
    return _replace(spark, location, touched, lambda rows: rows.filter((F.col(column) >= before) | F.col(column).isNull())) if touched else None


def packed_buckets(lengths: int, buckets: int, target: int = TARGET_BYTES) -> int:
    """The least number of buckets, the present one halved again and again, of which each has about ``target`` bytes at most."""
    while buckets > 1 and buckets % 2 == 0 and lengths / (buckets // 2) <= target:
        buckets //= 2
    return buckets


def compact(spark: SparkSession, location: str, target: int = TARGET_BYTES) -> int | None:
    """Fewer buckets, where the live ones' lengths say that they are too small for ``target``: each new one is the union of two, four or more. The new version, None if none is needed."""
    old = manifest(spark, location)
    about = _about(old)
    fewer = packed_buckets(old.agg(F.sum("bytes")).first()[0] or 0, about["buckets"], target)
    if fewer == about["buckets"]:
        return None
    every = [r["bucket"] for r in old.filter(F.col("bucket") != HEAD).select("bucket").collect()]
    return _replace(spark, location, every, lambda rows: rows, {"buckets": fewer})


def remove_unreferenced(spark: SparkSession, location: str, keep: int = 1) -> int:
    """Delete the bucket folders that none of the last ``keep`` committed versions names, and older manifests; how many folders went.

    No writer may be under way: what it has written and not committed goes, too.
    """
    last = current_version(spark, location)
    live = [v for v in range(max(0, last - keep + 1), last + 1)]
    named = manifest(spark, location, live[0]).select("folder")
    for version in live[1:]:
        named = named.union(manifest(spark, location, version).select("folder"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{location}/data").select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"))
    plain = F.regexp_extract("folder", r"(/data/[^/]+/_slot=\d+)$", 1)  # the same folder may be named with another scheme
    gone = files.select("folder", plain.alias("own")).filter("own <> ''").distinct().join(named.select(plain.alias("own")), "own", "left_anti")
    folders = [r["folder"] for r in gone.select("folder").collect()]
    for folder in folders:
        path, system = _path(spark, folder)
        system.delete(path, True)
    for folder in _children(spark, f"{location}/manifest"):
        if int(folder.rpartition("=")[2]) < live[0]:
            path, system = _path(spark, folder)
            system.delete(path, True)
    return len(folders)


def vacuum(spark: SparkSession, location: str, target: int = TARGET_BYTES, keep: int = 1) -> int:
    """``compact``, then ``remove_unreferenced``: how many folders went."""
    compact(spark, location, target)
    return remove_unreferenced(spark, location, keep)


def exists(spark: SparkSession, location: str) -> bool:
    return current_version(spark, location) is not None

