"""The analysis store: records by content hash, an index by path, and their upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import values as V
from tessera.operators.catalog import with_rank

TABLES = ("analysis", "quality", "video")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def version_histogram(tables: dict[str, DataFrame], current: int = V.ALGORITHM_VERSION) -> DataFrame:
    """algorithm_version, records, state: records of each version over all tables, marked stale, current or future."""
    versions = union_all([t.select("algorithm_version") for t in tables.values()])
    state = F.when(F.col("algorithm_version") < current, "stale").when(F.col("algorithm_version") == current, "current").otherwise("future")
    return versions.groupBy("algorithm_version").agg(F.count(F.lit(1)).alias("records")).withColumn("state", state)


def counts(tables: dict[str, DataFrame], path_index: DataFrame) -> DataFrame:
    """source, records: rows of each table and of the path index, 0 for an empty one."""
    every = [t.agg(F.count(F.lit(1)).alias("records")).select(F.lit(k).alias("source"), "records") for k, t in (*tables.items(), ("path_index", path_index))]
    return union_all(every)


def statistics(tables: dict[str, DataFrame], path_index: DataFrame, size_bytes: int, current: int = V.ALGORITHM_VERSION) -> DataFrame:
    """One row: records of each table, in all, stale ones, and the size in 1024-based units."""
    rows = union_all([t.select(F.lit(k).alias("source"), "algorithm_version") for k, t in tables.items()])
    rows = rows.unionByName(path_index.select(F.lit("path_index").alias("source"), F.lit(None).cast("int").alias("algorithm_version")))
    of = lambda k: F.count_if(F.col("source") == k)
    return rows.agg(
        *[of(k).alias(f"{k}_records") for k in TABLES], of("path_index").alias("path_index_entries"),
        F.count_if(F.col("source") != "path_index").alias("total_records"), F.count_if(F.col("algorithm_version") < current).alias("stale_records"),
    ).withColumns({"size_mb": F.lit(size_bytes / 1024.0**2), "size_gb": F.lit(size_bytes / 1024.0**3)})


def stale(table: DataFrame, current: int = V.ALGORITHM_VERSION) -> DataFrame:
    return table.filter(F.col("algorithm_version") < current)


def purge_stale(table: DataFrame, current: int = V.ALGORITHM_VERSION) -> DataFrame:
    """What is left once older versions go; rows without a version stay."""
    return table.filter((F.col("algorithm_version") >= current) | F.col("algorithm_version").isNull())


def expire(table: DataFrame, now: int, max_age_secs: int = V.EXPIRE_SECS) -> DataFrame:
    """What is left once records created before now - max_age_secs go."""
    return table.filter(F.col("created_at") >= now - max_age_secs)


def drop_orphans(path_index: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Index entries whose content some table still holds."""
    hashes = union_all([t.select("content_hash") for t in tables.values()])
    return path_index.join(hashes, "content_hash", "left_semi").select(*path_index.columns)


def oldest(table: DataFrame, quota: int) -> DataFrame:
    """The ``quota`` oldest records; ties by content hash. As the quota grows with the table, rows are ranked in partitions, never merged into one task."""
    return with_rank(table, [F.col("created_at"), F.col("content_hash")], "_rank").filter(F.col("_rank") <= quota).drop("_rank")


def evict(tables: dict[str, DataFrame], path_index: DataFrame, size_bytes: int, limit: int = V.SIZE_LIMIT_BYTES) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables and index after one pass of eviction: nothing happens below the limit.

    The quota is a seventh of the analysis records, at least one, and holds for
    each table. Only hashes and times are ranked, and only their hashes joined.
    """
    if size_bytes < limit:
        return tables, path_index
    quota = max(tables["analysis"].count() // V.EVICT_SHARE, 1)
    kept = {}
    for name, table in tables.items():
        gone = oldest(table.select("content_hash", "created_at"), quota).select("content_hash")
        kept[name] = table.join(gone, "content_hash", "left_anti").select(*table.columns)
    return kept, drop_orphans(path_index, kept)


def upsert(table: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``table`` with ``changes`` in place of rows of the same key; of several changes the last by ``order`` counts.

    Old rows meet the changes' distinct keys only; the order is settled among the changes, by an aggregate that combines before it shuffles.
    """
    last = latest(changes, key, order)
    untouched = table.join(changes.select(*key), key, "left_anti").select(*table.columns)
    return untouched.unionByName(last.select(*table.columns))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; rows whose key is null have one key."""
    newest = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*key).agg(newest.alias("_row")).select("_row.*")


def upsert_latest(table: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` among those of ``table`` and ``changes``, in whatever order they came; of equal ones that of ``changes``."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.select(*table.columns).withColumn("_new", F.lit(1)))
    return latest(both, key, [*order, "_new"]).select(*table.columns)


def put_metadata(table: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """key, value settings with those of ``changes`` in place of the same keys; of several the last by ``order``."""
    return upsert(table, changes, ["key"], order)


def metadata_value(table: DataFrame, key: str) -> DataFrame:
    """value: that of one key, no row if it isn't set."""
    return table.filter(F.col("key") == key).select("value")


def store_analysis(table: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """Upsert by content hash of the analyses that didn't fail."""
    good = changes.filter(F.col("analysis_error").isNull()).select(*table.columns, *[c for c in order if c not in table.columns])
    return upsert(table, good, ["content_hash"], order)


def migrate(table: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """``table`` with the columns (name -> type, default) that it lacks."""
    missing = {k: F.lit(default).cast(kind) for k, (kind, default) in columns.items() if k not in table.columns}
    return table.withColumns(missing) if missing else table


def migrate_store(tables: dict[str, DataFrame], version: int) -> tuple[dict[str, DataFrame], int]:
    """Tables at the current schema version; only version 2 lacks columns, others keep what they have."""
    if version == 2:
        added = {"content_fingerprint_hash": ("string", None), "data_checksum": ("bigint", None)}
        tables = {k: migrate(t, added) for k, t in tables.items()}
    return tables, max(version, V.SCHEMA_VERSION)


def invalidate(tables: dict[str, DataFrame], path_index: DataFrame, current: int = V.ALGORITHM_VERSION) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without older versions, and the index without what that orphans."""
    kept = {k: purge_stale(t, current) for k, t in tables.items()}
    return kept, drop_orphans(path_index, kept)


def fingerprints(content: Column) -> dict[str, Column]:
    """Hash of the whole content and of its first 64 KiB, and the checksum of a payload."""
    return {
        "content_hash": F.sha2(content, 256),
        "content_fingerprint_hash": F.sha2(F.substring(content, 1, 65_536), 256),
        "data_checksum": F.crc32(content),
    }


def options_hash(options: Column) -> Column:
    """The same for the same options in any order."""
    return F.xxhash64(F.array_sort(F.map_entries(options)).cast("string"))


def lookup(
    probes: DataFrame, path_index: DataFrame, records: DataFrame, checksum_ok: Column, current: int | None = V.ALGORITHM_VERSION
) -> DataFrame:
    """``probes`` (file_path, mtime, file_size, ctime, btime, content_hash) with ``status``.

    hit_path: the index has the same path, time and size, its other times are 0
    or equal, and the record is current. hit_hash: otherwise, a record with
    the content. corrupt: the record met first has another checksum. stale:
    its version is too old. miss: none. Without ``current`` versions don't
    count. ``checksum_ok`` is over the record's columns, null for those without one.
    The index is unique by path and the records by hash, so both joins keep one row per probe.
    """
    known = records.withColumn("_ok", F.coalesce(checksum_ok, F.lit(True)))
    fresh = F.lit(True) if current is None else F.coalesce(F.col("algorithm_version") >= current, F.lit(True))
    known = known.withColumn("_fresh", fresh).select("content_hash", "_ok", "_fresh")
    times = ["mtime", "file_size", "ctime", "btime"]
    indexed = path_index.select("file_path", *[F.col(c).alias(f"_{c}") for c in times], F.col("content_hash").alias("_hash"))
    by_path = known.select(F.col("content_hash").alias("_hash"), F.col("_ok").alias("_path_ok"), F.col("_fresh").alias("_path_fresh"))
    met = probes.join(indexed, "file_path", "left").join(by_path, "_hash", "left").join(known, "content_hash", "left")
    same = (F.col("_mtime") == F.col("mtime")) & (F.col("_file_size") == F.col("file_size")) & F.col("_path_ok").isNotNull()
    strict = F.lit(True)
    for c in ("ctime", "btime"):
        strict = strict & ((F.col(f"_{c}") == 0) | (F.col(f"_{c}") == F.col(c)))
    usable = F.coalesce(same & strict & F.col("_path_fresh"), F.lit(False))
    status = (
        F.when(usable, F.when(F.col("_path_ok"), "hit_path").otherwise("corrupt"))
        .when(F.col("_ok").isNull(), "miss").when(~F.col("_fresh"), "stale").when(F.col("_ok"), "hit_hash").otherwise("corrupt")
    )
    return met.select(*[F.col(c) for c in probes.columns], status.alias("status"))


def back_fill(path_index: DataFrame, looked_up: DataFrame) -> DataFrame:
    """The index with the paths that were found by their content."""
    found = looked_up.filter(F.col("status") == "hit_hash")
    missing = [F.lit(None).cast(path_index.schema[c].dataType).alias(c) for c in path_index.columns if c not in found.columns]
    found = found.select(*[c for c in path_index.columns if c in found.columns], *missing)
    return upsert(path_index, found, ["file_path"], ["mtime", "content_hash"])


def most_recent(entries: DataFrame, capacity: int) -> DataFrame:
    """key, accessed: the keys used last, at most ``capacity`` and at least one; ties by key."""
    used = entries.groupBy("key").agg(F.max("accessed_at").alias("accessed"))
    return used.orderBy(F.desc("accessed"), "key").limit(max(capacity, 1))


def ranked_latest(table: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return table.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
