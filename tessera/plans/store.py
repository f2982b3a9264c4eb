"""The analysis store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import store
from tessera.plans.inputs import SHA, ctes, load

CURRENT = 1087
RECORDS = ("content_hash", "created_at", "algorithm_version")
ALL = ("analysis_records", "quality_records", "video_records", "path_index")


def tables(spark, d):
    return {k: load(spark, d, f"{k}_records") for k in store.TABLES}


def version_histogram(spark, d):
    return store.version_histogram(tables(spark, d), CURRENT)


def cache_counts(spark, d):
    return store.counts(tables(spark, d), load(spark, d, "path_index"))


def store_statistics(spark, d):
    return store.statistics(tables(spark, d), load(spark, d, "path_index"), 123_456_789_012, CURRENT)


def stale_records(spark, d):
    return store.stale(load(spark, d, "analysis_records"), CURRENT).select(*RECORDS)


def purge_stale(spark, d):
    return store.purge_stale(load(spark, d, "quality_records"), CURRENT).select(*RECORDS)


def expire_records(spark, d):
    return store.expire(load(spark, d, "analysis_records"), 1_700_030_000, 20_000).select(*RECORDS)


def orphan_paths(spark, d):
    t = tables(spark, d)
    return store.drop_orphans(load(spark, d, "path_index"), {"analysis": t["analysis"].filter("algorithm_version > 1086"), "video": t["video"]})


def invalidate_old(spark, d):
    return store.invalidate(tables(spark, d), load(spark, d, "path_index"), CURRENT)[1]


def evict_oldest(spark, d):
    kept, index = store.evict(tables(spark, d), load(spark, d, "path_index"), 2, 1)
    rows = [t.select(F.lit(k).alias("source"), "content_hash") for k, t in kept.items()] + [index.select(F.lit("path_index").alias("source"), F.col("file_path").alias("content_hash"))]
    return store.union_all(rows)


def upsert_records(spark, d):
    old = load(spark, d, "analysis_records")
    return store.store_analysis(old, load(spark, d, "changes"), ["created_at"]).select("content_hash", "created_at", "algorithm_version", "data_checksum")


def upsert_paths(spark, d):
    looked = load(spark, d, "lookups").withColumn("atime", F.col("mtime"))
    return store.upsert(load(spark, d, "path_index"), looked, ["file_path"], ["mtime"]).select("file_path", "content_hash", "mtime", "file_size", "ctime", "btime")


def _lookup(spark, d, table, current):
    ok = F.col("data_checksum") == F.col("payload_checksum")
    return store.lookup(load(spark, d, "lookups"), load(spark, d, "path_index"), load(spark, d, table), ok, current).select("file_path", "status")


def lookup_analysis(spark, d):
    return _lookup(spark, d, "analysis_records", CURRENT)


def lookup_quality(spark, d):
    return _lookup(spark, d, "quality_records", None)


def lookup_video(spark, d):
    return _lookup(spark, d, "video_records", None)


def lookup_back_fill(spark, d):
    ok = F.col("data_checksum") == F.col("payload_checksum")
    index = load(spark, d, "path_index")
    found = store.lookup(load(spark, d, "lookups"), index, load(spark, d, "analysis_records"), ok, CURRENT)
    return store.back_fill(index, found).select("file_path", "content_hash", "mtime", "ctime")


def schema_migrate(spark, d):
    old = {k: t.select(*RECORDS) for k, t in tables(spark, d).items()}
    new, version = store.migrate_store(old, 2)
    return new["analysis"].withColumn("schema_version", F.lit(version))


def content_fingerprints(spark, d):
    docs = load(spark, d, "documents")
    made = store.fingerprints(F.col("text").cast("binary"))
    return docs.select("doc_id", made["content_hash"].alias("content_hash"), made["content_fingerprint_hash"].alias("fingerprint"))


def recent_keys(spark, d):
    used = load(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("accessed_at"))
    return store.most_recent(used, 25)


def latest_records(spark, d):
    return store.ranked_latest(load(spark, d, "changes"), ["content_hash"], ["created_at"]).select("content_hash", "created_at")


QUERIES = {
    f.__name__: f for f in (
        version_histogram, cache_counts, store_statistics, stale_records, purge_stale, expire_records, orphan_paths, invalidate_old, evict_oldest, upsert_records,
        upsert_paths, lookup_analysis, lookup_quality, lookup_video, lookup_back_fill, schema_migrate, content_fingerprints, recent_keys, latest_records,
    )
}

_UNION = " UNION ALL ".join(f"SELECT '{k}' AS source, content_hash, created_at, algorithm_version FROM {k}_records" for k in store.TABLES)


def _lookup_sql(table: str, versions: bool) -> str:
    fresh = "coalesce(algorithm_version >= 1087, TRUE)" if versions else "TRUE"
    return f"""WITH {ctes('lookups', 'path_index', table)},
    r AS (SELECT content_hash AS h, coalesce(data_checksum = payload_checksum, TRUE) AS ok, {fresh} AS fresh FROM {table}),
    m AS (SELECT l.*, EXISTS (SELECT 1 FROM path_index p JOIN r ON r.h = p.content_hash WHERE p.file_path = l.file_path AND p.mtime = l.mtime AND p.file_size = l.file_size
            AND (p.ctime = 0 OR p.ctime = l.ctime) AND (p.btime = 0 OR p.btime = l.btime) AND r.fresh) AS by_path,
          (SELECT r.ok FROM path_index p JOIN r ON r.h = p.content_hash WHERE p.file_path = l.file_path) AS path_ok FROM lookups l),
    looked AS (SELECT m.*, CASE WHEN by_path THEN CASE WHEN path_ok THEN 'hit_path' ELSE 'corrupt' END WHEN r.h IS NULL THEN 'miss' WHEN NOT r.fresh THEN 'stale'
      WHEN r.ok THEN 'hit_hash' ELSE 'corrupt' END AS status FROM m LEFT JOIN r ON r.h = m.content_hash)"""


SQL = {
    "version_histogram": f"""WITH {ctes(*ALL[:3])}, u AS ({_UNION}) SELECT algorithm_version, count(*) AS records,
        CASE WHEN algorithm_version < 1087 THEN 'stale' WHEN algorithm_version = 1087 THEN 'current' ELSE 'future' END AS state FROM u GROUP BY 1""",
    "cache_counts": f"WITH {ctes(*ALL)} " + " UNION ALL ".join(f"SELECT '{t.replace('_records', '')}' AS source, count(*) AS records FROM {t}" for t in ALL),
    "store_statistics": f"""WITH {ctes(*ALL)}, u AS ({_UNION}) SELECT count(*) FILTER (source = 'analysis') AS analysis_records, count(*) FILTER (source = 'quality') AS quality_records,
        count(*) FILTER (source = 'video') AS video_records, (SELECT count(*) FROM path_index) AS path_index_entries, count(*) AS total_records,
        count(*) FILTER (algorithm_version < 1087) AS stale_records, round(123456789012 / 1048576.0e0, 6) AS size_mb, round(123456789012 / 1073741824.0e0, 6) AS size_gb FROM u""",
    "stale_records": f"WITH {ctes('analysis_records')} SELECT content_hash, created_at, algorithm_version FROM analysis_records WHERE algorithm_version < 1087",
    "purge_stale": f"WITH {ctes('quality_records')} SELECT content_hash, created_at, algorithm_version FROM quality_records WHERE (algorithm_version < 1087) IS NOT TRUE",
    "expire_records": f"WITH {ctes('analysis_records')} SELECT content_hash, created_at, algorithm_version FROM analysis_records WHERE NOT created_at < 1700030000 - 20000",
    "orphan_paths": f"""WITH {ctes('analysis_records', 'video_records', 'path_index')} SELECT * FROM path_index WHERE content_hash IN
        (SELECT content_hash FROM analysis_records WHERE algorithm_version > 1086 UNION SELECT content_hash FROM video_records)""",
    "invalidate_old": f"""WITH {ctes(*ALL)}, u AS ({_UNION}) SELECT * FROM path_index WHERE content_hash IN (SELECT content_hash FROM u WHERE (algorithm_version < 1087) IS NOT TRUE)""",
    "evict_oldest": f"""WITH {ctes(*ALL)}, u AS ({_UNION}), ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at, content_hash) AS k FROM u),
        kept AS (SELECT source, content_hash FROM ranked WHERE k > greatest((SELECT count(*) FROM analysis_records) // 7, 1))
        SELECT * FROM kept UNION ALL SELECT 'path_index', file_path FROM path_index WHERE content_hash IN (SELECT content_hash FROM kept)""",
    "upsert_records": f"""WITH {ctes('analysis_records', 'changes')}, good AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY created_at DESC) AS k FROM changes WHERE analysis_error IS NULL)
        SELECT content_hash, created_at, algorithm_version, data_checksum FROM good WHERE k = 1
        UNION ALL SELECT content_hash, created_at, algorithm_version, data_checksum FROM analysis_records WHERE content_hash NOT IN (SELECT content_hash FROM good)""",
    "upsert_paths": f"""WITH {ctes('path_index', 'lookups')} SELECT file_path, coalesce(l.content_hash, p.content_hash) AS content_hash, coalesce(l.mtime, p.mtime) AS mtime,
        coalesce(l.file_size, p.file_size) AS file_size, coalesce(l.ctime, p.ctime) AS ctime, coalesce(l.btime, p.btime) AS btime FROM path_index p FULL JOIN lookups l USING (file_path)""",
    "lookup_analysis": _lookup_sql("analysis_records", True) + " SELECT file_path, status FROM looked",
    "lookup_quality": _lookup_sql("quality_records", False) + " SELECT file_path, status FROM looked",
    "lookup_video": _lookup_sql("video_records", False) + " SELECT file_path, status FROM looked",
    "lookup_back_fill": _lookup_sql("analysis_records", True) + """, f AS (SELECT * FROM looked WHERE status = 'hit_hash')
        SELECT file_path, content_hash, mtime, ctime FROM f UNION ALL SELECT file_path, content_hash, mtime, ctime FROM path_index WHERE file_path NOT IN (SELECT file_path FROM f)""",
    "schema_migrate": f"""WITH {ctes('analysis_records')} SELECT content_hash, created_at, algorithm_version, CAST(NULL AS VARCHAR) AS content_fingerprint_hash,
        CAST(NULL AS BIGINT) AS data_checksum, 3 AS schema_version FROM analysis_records""",
    "content_fingerprints": "SELECT doc_id, sha256(text) AS content_hash, sha256(encode(text)[1:65536]) AS fingerprint FROM documents",
    "recent_keys": "SELECT user_id AS key, max(event_id) AS accessed FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "latest_records": f"WITH {ctes('changes')} SELECT content_hash, max(created_at) AS created_at FROM changes GROUP BY 1",
}
