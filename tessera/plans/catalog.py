"""The file catalogue, dates, and work that is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import values as V
from tessera.functions import paths
from tessera.operators import catalog, checkpoint, dates, matching, runs
from tessera.plans.inputs import ctes, load


def files_with_extension(spark, d):
    return catalog.with_extension(load(spark, d, "files"), ["JPG", "png", "mov"]).select("path")


def path_parts(spark, d):
    p = F.col("path")
    return load(spark, d, "files").select(
        "path", paths.directory(p).alias("directory"), paths.stem(p).alias("stem"), paths.extension(p).alias("extension"), paths.kind(p).alias("kind"),
        paths.shell_kind(p).alias("shell_kind"), paths.is_hidden(p).alias("hidden"), paths.should_copy(p).alias("should_copy"), paths.is_potential_media(p).alias("media"),
        paths.format_priority(p).alias("priority"), paths.depth(p, "/lib").alias("depth"), paths.converted(p, "mp4").alias("converted"),
    )


def _ranked(files, order):
    return catalog.with_rank(files, order).select("path", "rank")


def sort_size_asc(spark, d):
    return _ranked(load(spark, d, "files").filter("size is not null"), [F.asc("size"), F.asc("path")])


def sort_size_desc(spark, d):
    return _ranked(load(spark, d, "files").filter("size is not null"), [F.desc("size"), F.asc("path")])


def sort_name(spark, d):
    return _ranked(load(spark, d, "files"), [F.asc("path")])


def image_queue(spark, d):
    return _ranked(catalog.image_queue(load(spark, d, "files"), "/lib"), catalog.image_order())


def video_queue(spark, d):
    return _ranked(catalog.video_queue(load(spark, d, "files"), "/lib"), catalog.video_order())


def file_kind_counts(spark, d):
    return catalog.kind_counts(load(spark, d, "files"))


def shell_kind_counts(spark, d):
    return catalog.shell_counts(load(spark, d, "files"))


def directory_bytes(spark, d):
    return catalog.directory_bytes(load(spark, d, "files"), V.IMAGE_EXTENSIONS)


def disk_precheck(spark, d):
    return catalog.disk_precheck(load(spark, d, "files"), 1_080_000_000)


def snapshot_valid(spark, d):
    seen = load(spark, d, "directories")
    roots = seen.select("root").distinct()
    snaps = roots.select("root", F.lit(3).alias("version"), (F.col("root") != "5-LOW").alias("recursive"), F.array(F.lit("PNG"), F.lit("jpg"), F.lit("png")).alias("extensions"))
    expected = roots.select("root", F.lit(3).alias("version"), F.lit(True).alias("recursive"), F.array(F.lit("jpg"), F.lit("png")).alias("extensions"))
    now = load(spark, d, "orders").groupBy(F.concat(F.lit("/s/"), F.col("o_custkey").cast("string")).alias("path")).agg(F.max("o_orderkey").alias("mtime"))
    own = seen.join(now.select("path", F.col("mtime").alias("_n")), "path").filter("mtime = _n or root <> '2-HIGH'").drop("_n")
    return catalog.snapshot_valid(snaps, own, now, expected)


def hot_start(spark, d):
    pending = load(spark, d, "files").select(F.col("file_id").alias("index"), "path")
    return catalog.hot_start(pending, "mov", "/lib/src3")


def best_dates(spark, d):
    found = dates.best_dates(load(spark, d, "dated"))
    return found.select("path", F.date_format("best_date", "yyyy-MM-dd HH:mm:ss").alias("best_date"), "date_source", F.size("all_dates").alias("said"))


def dates_by_source(spark, d):
    return dates.by_source(dates.best_dates(load(spark, d, "dated")))


def dates_by_year(spark, d):
    return dates.by_year(dates.best_dates(load(spark, d, "dated")))


def top_months(spark, d):
    return dates.top_months(dates.best_dates(load(spark, d, "dated")))


def date_range(spark, d):
    return dates.date_range(dates.best_dates(load(spark, d, "dated"))).withColumn("best_date", F.date_format("best_date", "yyyy-MM-dd HH:mm:ss"))


def date_totals(spark, d):
    return dates.totals(dates.best_dates(load(spark, d, "dated")))


def sidecar_cascade(spark, d):
    return matching.sidecar_cascade(load(spark, d, "sidecars"), load(spark, d, "media"))


def sidecar_summary(spark, d):
    return matching.merge_summary(sidecar_cascade(spark, d), F.char_length("media_path") % 3 != 0)


def existing_sidecars(spark, d):
    return matching.existing_sidecar(load(spark, d, "media").select("path"), load(spark, d, "sidecars").select(F.col("xmp_path").alias("path")))


def live_photos(spark, d):
    group = F.floor(F.col("file_id") / 5).cast("string")
    files = load(spark, d, "files").select(F.concat(F.lit("/lp/"), group, F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("path")).distinct()
    return matching.live_photos(files)


def tree_pairs(spark, d):
    return matching.paired_trees(load(spark, d, "files"), load(spark, d, "outputs"), "/lib", "/out")


def timestamp_sources(spark, d):
    return matching.timestamp_sources(load(spark, d, "outputs"), load(spark, d, "files"), "/out", "/lib")


def completeness(spark, d):
    return runs.completeness(load(spark, d, "files"), load(spark, d, "outputs"))


def checkpoint_validity(spark, d):
    return checkpoint.validity(checkpoint.latest(load(spark, d, "log")), load(spark, d, "present"))


def pending_work(spark, d):
    good = checkpoint_validity(spark, d).filter("status = 'valid'")
    return checkpoint.pending(load(spark, d, "present"), good).select("path")


QUERIES = {
    f.__name__: f for f in (
        files_with_extension, path_parts, sort_size_asc, sort_size_desc, sort_name, image_queue, video_queue, file_kind_counts, shell_kind_counts, directory_bytes,
        disk_precheck, snapshot_valid, hot_start, best_dates, dates_by_source, dates_by_year, top_months, date_range, date_totals, sidecar_cascade, sidecar_summary,
        existing_sidecars, live_photos, tree_pairs, timestamp_sources, completeness, checkpoint_validity, pending_work,
    )
}

_LIST = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_NAME = "regexp_extract({p}, '([^/]*)$', 1)"
_EXT = "lower(regexp_extract(regexp_extract({p}, '([^/]*)$', 1), '.\\.([^.]*)$', 1))"
_STEM = "regexp_replace(regexp_extract({p}, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1')"
_DIR = "regexp_extract({p}, '^(.*)/[^/]*$', 1)"


def _parts(table: str, column: str = "path", prefix: str = "") -> str:
    f = lambda t: t.format(p=column)
    return f"(SELECT *, {f(_NAME)} AS {prefix}name, {f(_DIR)} AS {prefix}dir, {f(_STEM)} AS {prefix}stem, {f(_EXT)} AS {prefix}ext FROM {table})"


_KIND = f"CASE WHEN ext IN {_LIST(V.IMAGE_EXTENSIONS)} THEN 'image' WHEN ext IN {_LIST(V.VIDEO_EXTENSIONS)} THEN 'video' WHEN ext = 'xmp' THEN 'sidecar' ELSE 'other' END"
_SHELL = f"CASE WHEN ext IN {_LIST(V.SHELL_IMAGE_EXTENSIONS)} THEN 'image' WHEN ext IN {_LIST(V.SHELL_VIDEO_EXTENSIONS)} THEN 'video' WHEN ext = 'xmp' THEN 'sidecar' ELSE 'other' END"
_PRIORITY = "CASE " + " ".join(f"WHEN ext IN {_LIST(e.split())} THEN {k}" for k, e in V.FORMAT_PRIORITY.items()) + " ELSE 6 END"
_MEDIA = f"(ext <> '' AND ext NOT IN {_LIST(V.NOT_MEDIA_EXTENSIONS)})"
_DEPTH = "(len(string_split(path, '/')) - 3)::INT"
_FILES = f"WITH {ctes('files')}, f AS {_parts('files')}"

_DATES = f"""WITH {ctes('dated')}, said AS (SELECT id, path, unnest([xmp_ps_created, xmp_created, xmp_history, exif_original, exif_created, xmp_metadata]) AS t,
    unnest(['XMP-Photoshop', 'XMP-CreateDate', 'XMP-History', 'EXIF-Original', 'EXIF-CreateDate', 'XMP-Metadata']) AS s, unnest([0, 1, 2, 3, 4, 5]) AS k FROM dated),
  clean AS (SELECT *, replace(split_part(t, '+', 1), 'T', ' ') AS c FROM said),
  stamped AS (SELECT *, CASE WHEN t NOT LIKE '0000%' AND (regexp_full_match(c, '\\d{{4}}:\\d{{2}}:\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?') OR regexp_full_match(c, '\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?'))
    THEN try_cast(replace(c[1:10], ':', '-') || c[11:] AS TIMESTAMP) END AS ts FROM clean),
  good AS (SELECT *, CASE WHEN year(ts) BETWEEN 1990 AND 2027 THEN ts END AS g FROM stamped),
  best AS (SELECT id, path, count(t) AS said, arg_min(g, k) FILTER (g IS NOT NULL) AS best_date, coalesce(arg_min(s, k) FILTER (g IS NOT NULL), 'None') AS date_source FROM good GROUP BY id, path)"""

_PLAIN = "lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_CASCADE = f"""WITH {ctes('sidecars', 'media')}, s AS {_parts('sidecars', 'xmp_path', 'x_')}, m0 AS {_parts('media', 'path', '')}, m AS (SELECT * FROM m0 WHERE {_MEDIA}),
  found AS (
    SELECT xmp_path, path, 0 AS k, 0 AS r FROM s JOIN m0 ON lower(right(xmp_path, 4)) = '.xmp' AND path = left(xmp_path, length(xmp_path) - 4)
    UNION ALL SELECT xmp_path, path, 1, 0 FROM s JOIN m ON x_dir = dir AND (lower(x_stem) = lower(stem) OR split_part(lower(x_stem), '.', 1) = split_part(lower(stem), '.', 1)) 
    UNION ALL SELECT xmp_path, path, 2, 0 FROM s JOIN m ON x_dir = dir AND lower(x_stem) = lower(stem)
    UNION ALL SELECT xmp_path, path, 3, 0 FROM s JOIN m0 ON derived_from NOT LIKE '%uuid:%' AND path = x_dir || '/' || derived_from
    UNION ALL SELECT xmp_path, path, 3, 1 FROM s JOIN m0 ON path = x_dir || '/' || source
    UNION ALL SELECT xmp_path, path, 4, 0 FROM s JOIN m ON x_dir = dir AND s.document_id = trim(m.document_id) AND regexp_full_match(x_stem, '[0-9A-Fa-f]{{8}}-([0-9A-Fa-f]{{4}}-){{3}}[0-9A-Fa-f]{{12}}')
    UNION ALL SELECT xmp_path, path, 5, 0 FROM s JOIN m ON x_dir = dir AND {_PLAIN.format(c='x_stem')} <> '' AND ({_PLAIN.format(c='x_stem')} = {_PLAIN.format(c='stem')}
      OR {_PLAIN.format(c="split_part(x_stem, '.', 1)")} = {_PLAIN.format(c="split_part(stem, '.', 1)")})
    UNION ALL SELECT xmp_path, path, 6, 0 FROM s JOIN m ON x_dir = dir AND contains(xmp_ref, x_name)
    UNION ALL SELECT xmp_path, path, 7, 0 FROM s JOIN m ON x_dir = dir AND strlen(x_stem) >= 4 AND (contains(stem, x_stem) OR contains(x_stem, stem))
      AND least(strlen(x_stem), strlen(stem)) * 100 // greatest(strlen(x_stem), strlen(stem)) >= 70
    UNION ALL SELECT xmp_path, path, 8, 0 FROM s JOIN m ON lower(x_stem) = lower(stem) AND (dir = x_dir OR regexp_extract(dir, '^(.*)/[^/]*$', 1) = x_dir)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY xmp_path ORDER BY k, r, path) AS n FROM found),
  matched AS (SELECT s.xmp_path, path AS media_path, coalesce(['direct_match', 'same_name', 'case_insensitive', 'xmp_metadata', 'document_id', 'fuzzy_match', 'xmp_ref_scan', 'partial_match', 'subdirectory'][k + 1], 'no_match') AS strategy
    FROM s LEFT JOIN (SELECT * FROM ranked WHERE n = 1) b ON b.xmp_path = s.xmp_path)"""
_TREES = f"WITH {ctes('files', 'outputs')}"
_LATEST = f"""WITH {ctes('log', 'present')}, e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS k FROM log) WHERE k = 1),
  v AS (SELECT e.path, CASE WHEN p.path IS NULL THEN 'missing' WHEN p.size IS NULL THEN 'unreadable' WHEN (e.size, e.mtime, e.ctime, e.btime) IS NOT DISTINCT FROM (p.size, p.mtime, p.ctime, p.btime) THEN 'valid'
    ELSE 'changed' END AS status FROM e LEFT JOIN present p ON p.path = e.path)"""


def _rank(where: str, order: str) -> str:
    return f"{_FILES} SELECT path, row_number() OVER (ORDER BY {order}) AS rank FROM f WHERE {where}"


SQL = {
    "files_with_extension": f"{_FILES} SELECT path FROM f WHERE ext IN ('jpg', 'png', 'mov')",
    "path_parts": f"""{_FILES}, k AS (SELECT *, {_KIND} AS kind FROM f) SELECT path, dir AS directory, stem, ext AS extension, kind, {_SHELL} AS shell_kind, name LIKE '.%' AS hidden, name NOT LIKE '.%' AND kind = 'other' AS should_copy,
        {_MEDIA} AS media, {_PRIORITY} AS priority, {_DEPTH} AS depth, dir || '/' || stem || CASE WHEN ext = 'mp4' THEN '_hevc' ELSE '' END || '.MP4' AS converted FROM k""",
    "sort_size_asc": _rank("size IS NOT NULL", "size, path"),
    "sort_size_desc": _rank("size IS NOT NULL", "size DESC, path"),
    "sort_name": _rank("TRUE", "path"),
    "image_queue": _rank(f"{_KIND} = 'image'", f"{_DEPTH} DESC, {_PRIORITY}, size NULLS FIRST, pixel_count NULLS LAST, path"),
    "video_queue": _rank(f"{_KIND} = 'video'", f"""{_DEPTH} DESC, pixel_count * CASE WHEN frame_count > 0 THEN frame_count WHEN duration_secs > 0 AND frame_rate > 0 THEN greatest(round(duration_secs * frame_rate), 1) END NULLS LAST,
        round(duration_secs * 1000) NULLS LAST, size NULLS FIRST, pixel_count NULLS LAST, round(frame_rate * 1000) NULLS LAST, path"""),
    "file_kind_counts": f"""{_FILES}, k AS (SELECT {_KIND} AS kind FROM f WHERE name NOT LIKE '.%') SELECT count(*) AS total, count(*) FILTER (kind = 'image') AS images, count(*) FILTER (kind = 'video') AS videos,
        count(*) FILTER (kind = 'sidecar') AS sidecars, count(*) FILTER (kind = 'other') AS others, count(*) FILTER (kind <> 'sidecar') AS expected FROM k""",
    "shell_kind_counts": f"""{_FILES}, k AS (SELECT {_SHELL} AS kind, name FROM f), c AS (SELECT count(*) FILTER (name NOT LIKE '.%') AS total, count(*) FILTER (kind = 'image') AS images, count(*) FILTER (kind = 'video') AS videos,
        count(*) FILTER (kind = 'sidecar') AS sidecars FROM k) SELECT *, total - images - videos - sidecars AS others FROM c""",
    "directory_bytes": f"{_FILES} SELECT dir AS directory, count(*) AS files, sum(size)::BIGINT AS bytes FROM f WHERE ext IN {_LIST(V.IMAGE_EXTENSIONS)} GROUP BY dir",
    "disk_precheck": f"WITH {ctes('files')} SELECT (sum(size) + 1073741824)::BIGINT AS needed, sum(size) + 1073741824 <= 1080000000 AS enough FROM files",
    "snapshot_valid": f"""WITH {ctes('directories')}, now AS (SELECT '/s/' || o_custkey AS path, max(o_orderkey) AS mtime FROM orders GROUP BY 1),
        own AS (SELECT d.root, d.mtime = n.mtime AS same FROM directories d JOIN now n USING (path) WHERE d.mtime = n.mtime OR d.root <> '2-HIGH')
        SELECT r.root, r.root <> '5-LOW' AND coalesce(bool_and(own.same), TRUE) AS valid FROM (SELECT DISTINCT root FROM directories) r LEFT JOIN own ON own.root = r.root GROUP BY r.root""",
    "hot_start": f"{_FILES} SELECT file_id AS index, path FROM f WHERE file_id < 48 ORDER BY CASE WHEN ext = 'mov' THEN 4 ELSE 0 END + CASE WHEN dir = '/lib/src3' THEN 2 ELSE 0 END DESC, file_id LIMIT 1",
    "best_dates": f"{_DATES} SELECT path, strftime(best_date, '%Y-%m-%d %H:%M:%S') AS best_date, date_source, said::INT AS said FROM best",
    "dates_by_source": f"{_DATES} SELECT date_source, count(*) AS files FROM best GROUP BY 1",
    "dates_by_year": f"{_DATES} SELECT year(best_date)::INT AS year, count(*) AS files, trunc(count(*) / (sum(count(*)) OVER ()) * 100.0e0)::INT AS percent FROM best WHERE best_date IS NOT NULL GROUP BY 1",
    "top_months": f"{_DATES} SELECT strftime(best_date, '%Y-%m') AS month, count(*) AS files FROM best WHERE best_date IS NOT NULL GROUP BY 1 ORDER BY files DESC, month LIMIT 15",
    "date_range": f"""{_DATES}, o AS (SELECT *, row_number() OVER (ORDER BY best_date, path) AS a, row_number() OVER (ORDER BY best_date DESC, path DESC) AS z FROM best WHERE best_date IS NOT NULL)
        SELECT CASE WHEN a = 1 THEN 'earliest' ELSE 'latest' END AS which, path, strftime(best_date, '%Y-%m-%d %H:%M:%S') AS best_date, date_source FROM o WHERE a = 1 OR z = 1""",
    "date_totals": f"{_DATES} SELECT count(*) AS total, count(best_date) AS dated, count(*) - count(best_date) AS undated FROM best",
    "sidecar_cascade": f"{_CASCADE} SELECT * FROM matched",
    "sidecar_summary": f"""{_CASCADE} SELECT strategy, count(*) AS sidecars, count(*) FILTER (length(media_path) % 3 <> 0) AS merged, count(*) FILTER (length(media_path) % 3 = 0) AS failed,
        count(*) FILTER (media_path IS NULL) AS skipped FROM matched GROUP BY strategy""",
    "existing_sidecars": f"""WITH {ctes('sidecars', 'media')}, m AS {_parts('media')} SELECT path, CASE WHEN path || '.xmp' IN (SELECT xmp_path FROM sidecars) THEN path || '.xmp' WHEN path || '.XMP' IN (SELECT xmp_path FROM sidecars) THEN path || '.XMP'
        WHEN dir || '/' || stem || '.xmp' IN (SELECT xmp_path FROM sidecars) THEN dir || '/' || stem || '.xmp' END AS sidecar FROM m""",
    "live_photos": f"""WITH {ctes('files')}, q AS (SELECT DISTINCT '/lp/' || (file_id // 5) || regexp_extract(path, '(\\.[^./]*)$', 1) AS path FROM files), f AS {_parts('q')}, g AS (SELECT *, regexp_extract(path, '\\.([^./]*)$', 1) AS raw FROM f)
        SELECT path FROM g WHERE (ext IN ('heic', 'heif', 'hif') AND EXISTS (SELECT 1 FROM g c WHERE c.dir = g.dir AND c.stem = g.stem AND c.raw IN ('mov', 'MOV')))
        OR (ext = 'mov' AND EXISTS (SELECT 1 FROM g c WHERE c.dir = g.dir AND c.stem = g.stem AND c.raw IN ('heic', 'HEIC', 'heif', 'HEIF')))""",
    "tree_pairs": f"{_TREES} SELECT f.path AS source_path, o.path AS output_path FROM files f JOIN outputs o ON f.path[6:] = o.path[6:]",
    "timestamp_sources": f"""{_TREES}, o AS {_parts('outputs')}, f AS {_parts('files')}, g AS (SELECT *, list_position([{', '.join(repr(e) for e in V.TIMESTAMP_EXTENSIONS)}], regexp_extract(path, '\\.([^./]*)$', 1)) AS k FROM f),
        j AS (SELECT o.path AS output_path, g.path AS source_path, row_number() OVER (PARTITION BY o.path ORDER BY g.k, g.path) AS n FROM o JOIN g ON o.dir[6:] = g.dir[6:] AND o.stem = g.stem AND g.k > 0)
        SELECT output_path, source_path FROM j WHERE n = 1""",
    "completeness": f"""{_TREES}, f AS {_parts('files')}, o AS {_parts('outputs')}, c AS (SELECT (SELECT count(*) FROM f WHERE name NOT LIKE '.%' AND ext <> 'xmp') AS expected, (SELECT count(*) FROM o WHERE name NOT LIKE '.%') AS actual)
        SELECT expected, actual, expected - actual AS missing, expected <= actual AS passed FROM c""",
    "checkpoint_validity": f"{_LATEST} SELECT * FROM v",
    "pending_work": f"{_LATEST} SELECT path FROM present WHERE path NOT IN (SELECT path FROM v WHERE status = 'valid')",
}
