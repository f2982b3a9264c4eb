"""What is laid out in files: keyed tables, refreshed snapshots, logs, lists, variants, and counters of the pass that writes."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from tessera.operators import checkpoint, pixels, runs, store
from tessera.operators.lineage import shared_folder
from tessera.plans import store as store_plans
from tessera.plans import streams
from tessera.plans.inputs import ctes, load
from tessera.sources import files, keyed, logs, snapshots, variants
from tessera.streaming import resume

C = F.col
BUCKETS = 8


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/plans-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def keyed_upsert(spark, d):
    """The changes put into a table of buckets."""
    place = _folder(spark)
    keyed.create(load(spark, d, "analysis_records"), place, ["content_hash"], BUCKETS, low="created_at")
    good = load(spark, d, "changes").filter("analysis_error is null").drop("analysis_error")
    keyed.put(good, place, ["created_at"])
    return keyed.records(spark, place).select("content_hash", "created_at", "algorithm_version", "data_checksum")


def keyed_expiry(spark, d):
    place = _folder(spark)
    keyed.create(load(spark, d, "analysis_records"), place, ["content_hash"], BUCKETS, low="created_at")
    keyed.expire(spark, place, 1_700_030_000 - 20_000)
    keyed.vacuum(spark, place)
    return keyed.records(spark, place).select(*store_plans.RECORDS)


def keyed_lookup(spark, d):
    """Lookups whose index and records lie in buckets, so that only the probes move."""
    index, records = _folder(spark), _folder(spark)
    keyed.create(load(spark, d, "path_index"), index, ["file_path"], BUCKETS)
    keyed.create(load(spark, d, "analysis_records"), records, ["content_hash"], BUCKETS)
    ok = C("data_checksum") == C("payload_checksum")
    found = store.lookup(load(spark, d, "lookups"), keyed.records(spark, index), keyed.records(spark, records), ok, store_plans.CURRENT)
    return found.select("file_path", "status")


_OLD_FILES = """SELECT '/s/' || CAST(o_custkey AS STRING) AS directory, '/s/' || CAST(o_custkey AS STRING) || '/' || CAST(o_orderkey AS STRING) AS path, o_orderkey AS size FROM orders
  UNION ALL SELECT '/x/' || CAST(s_suppkey AS STRING) AS directory, '/x/' || CAST(s_suppkey AS STRING) || '/gone' AS path, s_suppkey AS size FROM supplier"""
_KNOWN = """SELECT '/s/' || CAST(o_custkey AS STRING) AS directory, max(o_orderkey) AS mtime FROM orders GROUP BY o_custkey
  UNION ALL SELECT '/x/' || CAST(s_suppkey AS STRING) AS directory, s_suppkey AS mtime FROM supplier"""
_CURRENT = """SELECT '/s/' || CAST(c_custkey AS STRING) AS directory, coalesce(max(o_orderkey), 0) + CASE WHEN max(c_mktsegment) = 'BUILDING' THEN 1 ELSE 0 END AS mtime
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""
_LISTED = """SELECT '/s/' || CAST(c_custkey AS STRING) AS directory, '/s/' || CAST(c_custkey AS STRING) || '/new' AS path, c_custkey * 10 AS size FROM customer"""


def _made(spark, d, text: str):
    used = {name: load(spark, d, name) for name in ("orders", "supplier", "customer") if re.search(rf"\b(FROM|JOIN) {name}\b", text)}
    return spark.sql(re.sub(r"\b(FROM|JOIN) (orders|supplier|customer)\b", r"\1 {\2}", text), **used)


def snapshot_refresh(spark, d):
    """A snapshot whose directories were changed, added and lost meanwhile."""
    return snapshots.refreshed(*(_made(spark, d, t) for t in (_OLD_FILES, _KNOWN, _CURRENT, _LISTED))).select("path", "size")


def log_generations(spark, d):
    """The last entry of each path after two appends and a compaction between them."""
    place, entries = _folder(spark), load(spark, d, "log")
    half = C("event_type") == "click"
    rows = entries.join(load(spark, d, "events").select(C("event_id").alias("seq"), "event_type"), "seq")
    logs.append_log(rows.filter(~half), place)
    logs.compact_log(spark, place)
    logs.append_log(rows.filter(half), place)
    return checkpoint.latest(logs.read_log(spark, place)).select("path", "size", "mtime", "ctime", "btime")


def processed_list(spark, d):
    """Lists of paths by source; one of a source with a byte that isn't UTF-8 gives none."""
    place = _folder(spark)
    bad = F.when((C("source") == "src3") & (C("lang") == "fr"), F.expr("CAST(X'2FFF2F' AS STRING)")).otherwise(F.lit("/"))
    lines = load(spark, d, "documents").select("source", F.concat(bad, F.coalesce("lang", F.lit("")), F.lit("/"), (C("doc_id") / 2).cast("long").cast("string"), F.lit(" ")).alias("value"))
    lines.repartition("source").write.partitionBy("source").text(place)
    return logs.processed_paths(spark, place)


def probe_variants(spark, d):
    documents = variants.as_variant(load(spark, d, "probe_json", spread=True))
    return variants.parsed_probe(documents).select("id", "codec", "width", "height", "fps", "audio_codec", "has_audio", "video_bit_rate", "bit_depth")


def probe_paths(spark, d):
    return variants.paths_and_kinds(variants.as_variant(load(spark, d, "probe_json", spread=True)))


def observed_counters(spark, d):
    """Figures of a run, counted while its results are written."""
    results = runs.classified(load(spark, d, "results"), "video").select("id", "outcome", "input_size", "output_size")
    report = runs.write_report(results, _folder(spark))
    names = ("total", "succeeded", "failed", "skipped", "paused", "input_bytes", "output_bytes")
    return spark.createDataFrame([tuple(report[n] for n in names)], ", ".join(f"{n} long" for n in names))


def gradient_banding(spark, d):
    """Images of 64 by 32 pixels whose rows are all a vector's."""
    px = load(spark, d, "pixels", spread=True).select("vec_id", F.flatten(F.array_repeat("px", 32)).alias("px"), F.lit(64).alias("width"))
    return pixels.banded(px, "vec_id", "px", "width")


def dithered(spark, d):
    """Images of 8 by 8 pixels, of which each inner one is looked at."""
    px = load(spark, d, "pixels", spread=True).select("vec_id", "px", F.lit(8).alias("width"))
    return pixels.artefacts(px, "vec_id", "px", "width").select("vec_id", "dithering")


def scanned_files(spark, d):
    """A file of names for each nation's suppliers, found again by its bytes."""
    place = _folder(spark)
    lines = load(spark, d, "supplier").select("s_nationkey", C("s_name").alias("value"))
    lines.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "value").write.partitionBy("s_nationkey").text(place)
    found = files.hashed(files.scan(spark, place, ["txt"], content=True))
    return found.select(F.regexp_extract("path", r"s_nationkey=(\d+)/", 1).cast("int").alias("nation"), "size", "content_hash")


def stored_snapshot(spark, d):
    """Files kept under the key of what was asked for, which doesn't depend on the extensions' order or case."""
    place, key = _folder(spark), files.snapshot_key("/lib", "image", True, ["jpg", "PNG"])
    files.write_snapshot(load(spark, d, "files").select("path", "size"), place, key)
    return files.read_snapshot(spark, place, files.snapshot_key("/lib", "image", True, ["png", "JPG"]))


def listed_paths(spark, d):
    place = _folder(spark)
    files.write_paths(load(spark, d, "outputs"), place)
    return files.read_paths(spark, place)


def streamed_upserts(spark, d):
    """Changes that arrive in files, the last of each key kept in a table of buckets."""
    source, table, progress = _folder(spark), _folder(spark), _folder(spark)
    changes = load(spark, d, "changes").select("content_hash", "created_at", "file_size")
    changes.write.parquet(source)
    arrived = resume.new_rows(spark, source, changes.schema, files_per_batch=1)
    resume.upsert_new(arrived, table, ["content_hash"], ["created_at"], progress, BUCKETS).awaitTermination()
    return keyed.records(spark, table)


def throughput(spark, d):
    return runs.throughput(load(spark, d, "results"), 90.0)


def alpha_seen(spark, d):
    """Whether any of every twentieth value of a vector isn't opaque, as values of 200 and more count."""
    px = load(spark, d, "pixels").select("vec_id", F.posexplode("px").alias("place", "v"))
    return pixels.has_alpha(px.select("vec_id", "place", F.when(C("v") >= 200, 255).otherwise(C("v")).alias("a")), "vec_id", 20)


QUERIES = {
    f.__name__: f for f in (
        keyed_upsert, keyed_expiry, keyed_lookup, snapshot_refresh, log_generations, processed_list, probe_variants, probe_paths, observed_counters, gradient_banding, dithered,
        scanned_files, stored_snapshot, listed_paths, streamed_upserts, throughput, alpha_seen,
    )
}

SQL = {
    "keyed_upsert": store_plans.SQL["upsert_records"],
    "keyed_expiry": store_plans.SQL["expire_records"],
    "keyed_lookup": store_plans.SQL["lookup_analysis"],
    "probe_variants": streams.SQL["probe_streams"],
    "snapshot_refresh": f"""WITH f AS ({_OLD_FILES}), k AS ({_KNOWN}), c AS ({_CURRENT}), l AS ({_LISTED})
      SELECT path, size FROM f WHERE directory IN (SELECT c.directory FROM c JOIN k ON c.directory = k.directory AND c.mtime = k.mtime)
      UNION ALL SELECT path, size FROM l WHERE directory IN (SELECT directory FROM c EXCEPT SELECT c.directory FROM c JOIN k ON c.directory = k.directory AND c.mtime = k.mtime)""",
    "log_generations": f"""WITH {ctes('log')}, r AS (SELECT log.*, row_number() OVER (PARTITION BY path ORDER BY event_type = 'click' DESC, seq DESC) AS k FROM log JOIN events ON event_id = seq)
      SELECT path, size, mtime, ctime, btime FROM r WHERE k = 1""",
    "processed_list": """SELECT DISTINCT '/' || coalesce(lang, '') || '/' || doc_id // 2 AS path FROM documents WHERE NOT source = 'src3'
      OR NOT EXISTS (SELECT 1 FROM documents WHERE source = 'src3' AND lang = 'fr')""",
    "probe_paths": f"""WITH {ctes('probe_json')}, t AS (SELECT j.fullkey AS p, j.type AS k FROM probe_json, json_tree(probe_json.json) AS j WHERE json_valid(probe_json.json))
      SELECT regexp_replace(replace(p, '"', ''), '\\[[0-9]+\\]', '[]', 'g') AS path,
        CASE k WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, count(*) AS n FROM t GROUP BY ALL""",
    "observed_counters": f"""{streams._STATUS} SELECT count(*) FILTER (video <> 'paused') AS total, {', '.join(f"count(*) FILTER (video = '{k}') AS {k}" for k in ('succeeded', 'failed', 'skipped', 'paused'))},
      coalesce(sum(input_size) FILTER (video = 'succeeded'), 0)::BIGINT AS input_bytes, coalesce(sum(output_size) FILTER (video = 'succeeded'), 0)::BIGINT AS output_bytes FROM r""",
    "gradient_banding": f"""WITH RECURSIVE {ctes('pixels')}, starts AS (SELECT unnest(range(0, 64, 8)) AS first),
      shape AS (SELECT 0 AS line, 0 AS first, 1 AS turn, 64 AS n UNION ALL SELECT 1 + first, first, 1, least(64 - first, 32) FROM starts UNION ALL SELECT 100 + first, first, -1, least(first + 1, 32) FROM starts WHERE first > 0),
      steps AS (SELECT vec_id, line, i, abs(px[first + turn * i + 1] - px[first + turn * (i - 1) + 1]) AS step FROM pixels, (SELECT *, unnest(range(1, n)) AS i FROM shape)),
      scan AS (
        SELECT vec_id, line, 0 AS i, 0 AS long, 0 AS bands, 0 AS last, NULL::DOUBLE AS share FROM pixels, shape
        UNION ALL
        SELECT vec_id, line, i, CASE WHEN ended THEN 0 ELSE grown END, CASE WHEN ended THEN 0 ELSE b END, CASE WHEN band OR over THEN i ELSE last END,
          CASE WHEN over AND b / grown > 0.08e0 AND b / grown < 0.5e0 THEN b / grown END
        FROM (SELECT *, NOT gentle AND grown > 20 AS over, NOT gentle AND (grown > 20 OR line > 0) AS ended FROM (
          SELECT s.vec_id, s.line, t.i, last, gentle, gentle AND step > 3 AND (line > 0 OR t.i - last > 3) AS band, long + gentle::INT AS grown, bands + (gentle AND step > 3 AND (line > 0 OR t.i - last > 3))::INT AS b
          FROM scan s JOIN (SELECT *, step > 0 AND step < 20 AS gentle FROM steps) t USING (vec_id, line) WHERE t.i = s.i + 1)))
      SELECT vec_id, round(least(least(coalesce(avg(share) FILTER (line = 0), 0), 1) * 0.7e0 + least(coalesce(avg(share) FILTER (line > 0), 0), 1) * 0.3e0, 1), 6) AS banding FROM scan GROUP BY vec_id""",
    "scanned_files": """WITH f AS (SELECT s_nationkey, string_agg(s_name, chr(10) ORDER BY s_name) || chr(10) AS body FROM supplier GROUP BY 1)
      SELECT s_nationkey::INT AS nation, strlen(body) AS size, sha256(body) AS content_hash FROM f""",
    "stored_snapshot": f"WITH {ctes('files')} SELECT path, size FROM files",
    "listed_paths": f"WITH {ctes('outputs')} SELECT DISTINCT path FROM outputs",
    "streamed_upserts": f"WITH {ctes('changes')} SELECT content_hash, max(created_at) AS created_at, arg_max(file_size, created_at) AS file_size FROM changes GROUP BY content_hash",
    "throughput": f"WITH {ctes('results')} SELECT count(*) AS files, round(90e0 / count(*), 6) AS average_secs FROM results",
    "alpha_seen": f"WITH {ctes('pixels')} SELECT vec_id, len([k FOR k IN range(64) IF k % 20 = 0 AND px[k + 1] < 200]) > 0 AS has_alpha FROM pixels",
    "dithered": f"""WITH {ctes('pixels')}, p AS (SELECT vec_id, unnest(px)::DOUBLE AS v, unnest(range(64)) AS k FROM pixels), g AS (SELECT vec_id, k // 8 AS y, k % 8 AS x, v FROM p),
      far AS (SELECT a.vec_id, a.y, a.x, b.y - a.y AS dy, b.x - a.x AS dx, sqrt((2 + (a.v + b.v) / 2 / 256) * (a.v - b.v) ** 2 + 4 * (a.v - b.v) ** 2 + (2 + (255 - (a.v + b.v) / 2) / 256) * (a.v - b.v) ** 2) AS d
        FROM g a JOIN g b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y)),
      near AS (SELECT vec_id, y, x, count(*) FILTER (d > 30 AND d < 100) AS n, max(d) FILTER (dy = 0 AND dx = 1) + max(d) FILTER (dy = 1 AND dx = 0) AS straight, max(d) FILTER (dy = 1 AND dx = 1) AS across FROM far WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY ALL),
      joined AS (SELECT near.*, far.d AS other FROM near JOIN far ON far.vec_id = near.vec_id AND far.y = near.y AND far.x = near.x + 1 AND dy = 1 AND dx = -1)
      SELECT vec_id, round(greatest(least(1, 5 * avg((n >= 3)::INT)), least(1, 4 * avg((straight > 40 AND across + other < straight * 0.5e0)::INT) FILTER (x % 2 = 1 AND y % 2 = 1))), 6) AS dithering FROM joined GROUP BY vec_id""",
}
