"""File bodies, built byte by byte from keys, and the text that tools leave behind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import values as V
from tessera.functions import grades, images, text, video
from tessera.operators import catalog, checkpoint, runs, store, traces
from tessera.plans.inputs import ctes, load, pick
from tessera.sources import compression, magic, probe

C = F.col


def _hex(number: Column, size: int) -> Column:
    return F.lpad(F.hex(number.cast("long")), 2 * size, F.lit("0"))


def _name(name: str) -> Column:
    return F.lit(name.encode().hex())


def _box(name: str, *parts: Column) -> Column:
    body = F.concat(*parts)
    return F.concat(_hex(F.char_length(body) / 2 + 8, 4), _name(name), body)


def _part(name: str, *parts: Column) -> Column:
    """A PNG chunk, with an empty checksum."""
    body = F.concat(*parts)
    return F.concat(_hex(F.char_length(body) / 2, 4), _name(name), body, F.lit("00000000"))


def _zeros(size: Column | int) -> Column:
    return F.repeat(F.lit("00"), size if isinstance(size, Column) else F.lit(size))


def _if(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise("")


# Bare JPEG XL headers (the lossy default, the other colour space, the lossy one named, a cut one), and a box around a JPEG.
JXL_BODIES = {"FF0A4102": False, "FF0A410000": True, "FF0A410001": False, "FF0A4100": None, "0000000C4A584C200D0A870A0000000A6A6272640000": True}


def lossless_streams(spark, d):
    """HEIC, AVIF and JPEG XL bodies by key: profiles, chroma, depth and colour of every combination."""
    p = load(spark, d, "part").select(C("p_partkey").alias("id"))
    n, whole = F.floor(C("id") / 3).cast("int"), lambda c: F.lit(c)
    colour = _if(C("id") % 7 == 0, _box("colr", _name("nclx"), whole("0001000D000080")))
    deep = _if(C("id") % 13 == 0, _box("pixi", whole("030C0C0C")))
    hvcc = _box("hvcC", whole("01"), _hex(C("id") % 11, 1), F.when(C("id") % 5 == 0, "08").otherwise("00"), _zeros(13), _hex(n % 4, 1), _zeros(6))
    av1c = _box("av1C", whole("81"), _hex(F.shiftleft((C("id") % 5 % 3).cast("int"), 5), 1), _hex(F.shiftleft(n % 32, 2), 1), whole("00"))
    tree = lambda brand, config: F.concat(_box("ftyp", _name(brand), _zeros(8)), _box("meta", _zeros(4), _box("iprp", _box("ipco", config, colour, deep))))
    jxl = F.get(F.array(*[F.lit(b) for b in JXL_BODIES]), n % len(JXL_BODIES))
    kind = F.when(C("id") % 3 == 0, "HEIC").when(C("id") % 3 == 1, "AVIF").otherwise("JXL")
    body = F.when(C("id") % 3 == 0, tree("heic", hvcc)).when(C("id") % 3 == 1, tree("avif", av1c)).otherwise(jxl)
    files = p.select(C("id").cast("string").alias("path"), kind.alias("format"), F.unhex(body).alias("content"))
    return compression.with_compression(files).select(C("path").cast("long").alias("id"), "lossless")


def header_streams(spark, d):
    """WebP, TIFF, OpenEXR and JPEG 2000 bodies, and moving PNGs, by key."""
    p = load(spark, d, "part").select(C("p_partkey").alias("id"))
    n, kinds = C("id") % 9, ("WebP", "TIFF", "EXR", "JP2", "PNG")
    bodies = {
        "WebP": F.concat(F.lit("52494646000000005745425056503858020000000000"), F.when(n % 2 == 0, _name("VP8L")).otherwise(_name("VP8 ")), F.lit("020000000000")),
        "TIFF": F.concat(F.lit("49492A0008000000" "0100" "0301" "0300" "01000000"), F.concat(_hex(n, 1), F.lit("000000")), F.lit("00000000")),
        "EXR": F.concat(F.lit("762F310102000000"), _name("compression"), F.lit("00"), _name("compression"), F.lit("0001000000"), _hex(n, 1), F.lit("00")),
        "JP2": F.concat(F.lit("FF4FFF5100040000" "FF52000C"), _zeros(9), _hex(n % 3, 1), F.lit("FF93")),
        "PNG": F.concat(F.lit("89504E470D0A1A0A"), _part("IHDR", _zeros(13)), _if(n % 2 == 1, _part("acTL", _hex(n, 4), _zeros(4))), _part("IEND", F.lit(""))),
    }
    kind, body = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, name in enumerate(kinds):
        kind, body = F.when(C("id") % 5 == k, name).otherwise(kind), F.when(C("id") % 5 == k, bodies[name]).otherwise(body)
    files = p.select(C("id").cast("string").alias("path"), kind.alias("format"), F.unhex(body).alias("content"))
    return compression.with_compression(files).select(C("path").cast("long").alias("id"), "lossless", "frames")


def byte_figures(spark, d):
    """PNG chunks, GIF blocks and JPEG quantisation tables by key."""
    p = load(spark, d, "part").select(C("p_partkey").alias("id"))
    n = C("id") % 4
    png = F.concat(F.lit("89504E470D0A1A0A"), _part("IHDR", _zeros(13)), F.repeat(_part("IDAT", F.lit("0102")), n.cast("int")), _if(C("id") % 5 == 0, _part("acTL", _zeros(8))), _part("IEND", F.lit("")))
    frame = F.concat(F.lit("21F90400"), _hex(C("id") % 100, 1), F.lit("000000" "2C"), _zeros(9), F.lit("02024C0100"))
    gif = F.concat(F.lit("4749463839610A000A00"), _hex(128 + C("id") % 8, 1), F.lit("0000"), _zeros(F.expr("3 * shiftleft(2, CAST(id % 8 AS INT))")), F.lit("21FF0B4E45545343415045322E300301000000"), F.repeat(frame, n.cast("int")), F.lit("3B"))
    values = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: _hex((C("id") + k) % 200 + 1, 1)), "")
    jpeg = F.concat(F.lit("FFD8FFDB004300"), values, F.lit("FFDA"))
    files = p.select(C("id").cast("string").alias("path"), F.unhex(F.when(C("id") % 3 == 0, png).when(C("id") % 3 == 1, gif).otherwise(jpeg)).alias("content"))
    got = magic.byte_figures(files)
    table = {f"q{k}": C("quant_table")[k] for k in (0, 1, 8, 9, 63)}
    return got.select(
        C("path").cast("long").alias("id"), C("chunks")["IDAT"].alias("idat"), C("chunks")["acTL"].alias("actl"), "palette", "frames", "duration",
        F.get("vendors", F.lit(0)).alias("vendor"), *[v.alias(k) for k, v in table.items()],
    )


def sidecar_lines(spark, d):
    """Short-form sidecar text: three tags by position, some blank, some missing."""
    third = _if(C("p_partkey") % 3 > 0, F.concat(F.lit("\n"), C("p_name")))
    tags = F.concat(F.lit(" doc "), C("p_partkey").cast("string"), F.lit("\n"), _if(C("p_partkey") % 4 > 0, C("p_brand")), third)
    return probe.sidecar_text(load(spark, d, "part").select(C("p_partkey").alias("id"), tags.alias("text"))).select("id", "document_id", "derived_from", "source")


def exif_dates(spark, d):
    """Arrays of two metadata records, one with a history list."""
    o = load(spark, d, "orders").select(F.to_json(F.array(
        F.create_map(F.lit("SourceFile"), F.concat(F.lit("/a"), C("o_orderkey").cast("string")), F.lit("ExifIFD:DateTimeOriginal"), C("o_orderdate").cast("string")),
        F.create_map(F.lit("SourceFile"), F.concat(F.lit("/b"), C("o_orderkey").cast("string")), F.lit("XMP-xmp:CreateDate"), F.lit("-")),
    )).alias("json"))
    history = F.regexp_replace("json", '"XMP-xmp:CreateDate"', '"XMP-xmpMM:HistoryWhen":["2001:02:03","x"],"XMP-xmp:CreateDate"')
    return probe.exif_records(o.select(history.alias("json"))).select("path", "exif_original", "xmp_created", "xmp_history")


def _run_logs(spark, d):
    counted = lambda label, c: F.concat(F.lit(f"{label}: "), c.cast("string"), F.lit("\n"))
    log = F.concat(counted("Succeeded", C("event_id") % 7), _if(C("event_id") % 3 > 0, counted("Failed", C("event_id") % 5)), counted("Succeeded", C("user_id")))
    return load(spark, d, "events").select(C("event_id").alias("id"), log.alias("text"))


def run_log_counts(spark, d):
    return probe.run_counts(_run_logs(spark, d)).select("id", "succeeded", "skipped", "failed")


def merged_log_lines(spark, d):
    """The lines of two logs of suppliers and nations, counted by section, place and text."""
    first = load(spark, d, "supplier").select(F.concat(F.lit("start\n"), C("s_name")).alias("text"))
    second = load(spark, d, "nation").select(C("n_name").alias("text"))
    return probe.merged_logs([first, second]).groupBy("section", "line_no", "line").agg(F.count(F.lit(1)).alias("lines"))


def text_figures(spark, d):
    p = load(spark, d, "part").select(C("p_partkey").alias("id"), C("p_name").alias("name"))
    clock = F.expr(pick("id", "1-02:03:04", "02:03", "10:00:59", "x", "7"))
    log = F.concat(F.lit("All "), F.expr(pick("id", "SSIM: ", "ssim=", "PSNR: ")), F.expr(pick("id", "0.", "inf", "")), _if(C("id") % 3 != 1, (C("id") % 90 + 10).cast("string")))
    return p.select(
        "id", text.truncated(C("name"), 12).alias("short"), text.truncated(C("name"), 3).alias("shortest"), text.digits(F.concat(C("name"), C("id").cast("string"))).alias("digits"),
        text.elapsed_secs(clock).alias("secs"), text.metric(log, "SSIM").alias("ssim"), text.number_or(clock, 4.5).alias("number"),
    )


def option_hashes(spark, d):
    """Options in another order hash alike, other options don't."""
    one, two = (C("p_size").cast("string"), C("p_type"))
    made = lambda *pairs: store.options_hash(F.create_map(*[x for p in pairs for x in p]))
    a, b = (F.lit("crf"), one), (F.lit("preset"), two)
    p = load(spark, d, "part")
    return p.select(C("p_partkey").alias("id"), (made(a, b) == made(b, a)).alias("same"), (made(a, b) == made((F.lit("crf"), two), (F.lit("preset"), one))).alias("swapped"))


def grade_checks(spark, d):
    t = load(spark, d, "trace")
    least = grades.search_limits(C("crf"), "hevc_videotoolbox" if "hevc_videotoolbox" in grades.SCALES else next(iter(grades.SCALES)))["min_ssim"]
    return t.select(
        "event_id", grades.about(C("ssim"), F.round("ssim", 2)).alias("round"), grades.meets_ssim(C("ssim"), least).alias("meets"), grades.crf_within(C("crf"), 15.0, 30.0).alias("within"),
        grades.luma_weighted(C("ssim"), C("psnr") / 97.0, C("crf") / 89.0).alias("weighted"), grades.overall_confidence(C("ssim"), C("psnr") / 53.0, C("crf") / 47.0, C("ssim")).alias("confidence"),
        grades.same_duration(C("secs"), F.when(C("event_id") % 4 > 0, C("secs") + C("event_id") % 3 / 4.0), 0.25).alias("same_length"), traces.overall_eta(C("secs"), C("event_id") % 5, F.lit(60)).alias("eta"),
        grades.warm_start(F.when(C("event_id") % 2 == 0, C("crf")), F.when(C("event_id") % 3 == 0, C("psnr")), F.when(C("event_id") % 5 == 0, C("ssim")), F.lit(1.0)).alias("start"),
    )


def intact_outputs(spark, d):
    o = load(spark, d, "files").select("file_id", C("size").alias("length"))
    return checkpoint.output_intact(o, 400).select("file_id", "intact")


def resumed_batch(spark, d):
    """What a run with a header of its own still has to do, of files present now."""
    fields = {f: 1 if k else 2 for k, f in enumerate(checkpoint.HEADER)}
    entries = load(spark, d, "log").withColumns({f: F.lit(None).cast("string") for f in checkpoint.HEADER})
    header = spark.range(1).select(F.lit("header").alias("kind"), *[F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in entries.columns if c not in ("kind", *fields)], *[F.lit(str(v)).alias(f) for f, v in fields.items()])
    expected = {f: str(v) for f, v in fields.items()}
    return checkpoint.resume(load(spark, d, "present"), entries.unionByName(header), expected).select("path")


def _sorted(how: str):
    def query(spark, d):
        files = load(spark, d, "files").select("path", "size")
        order = [catalog.SORTS[how][0](catalog.SORTS[how][1]), F.asc("path")]
        return catalog.with_rank(catalog.sort_files(files, how), order).select("path", "rank")

    return query


def stored_metadata(spark, d):
    """The schema version and other settings after a replacement."""
    old = load(spark, d, "nation").select(C("n_name").alias("key"), C("n_regionkey").cast("string").alias("value"))
    name = F.when(C("n_nationkey") % 3 == 0, C("n_name")).otherwise(F.concat(F.lit("new "), C("n_name")))
    new = load(spark, d, "nation").select(name.alias("key"), F.lit("3").alias("value"), C("n_nationkey").alias("at"))
    return store.put_metadata(old, new, ["at"])


def metadata_value(spark, d):
    return store.metadata_value(stored_metadata(spark, d), "FRANCE")


def copy_counts(spark, d):
    return runs.copy_counts(load(spark, d, "results").select("ok", "skipped"), C("ok") & ~C("skipped"), C("skipped"))


def target_formats(spark, d):
    names = F.array(*[F.lit(t) for t in (*V.TARGETS, "Other")])
    p = load(spark, d, "part").select(C("p_partkey").alias("id"), F.get(names, (C("p_partkey") % (len(V.TARGETS) + 1)).cast("int")).alias("target"))
    formats = F.expr(pick("id", "HEIC", "PNG", "AVIF", "JXL", "HEIF", "JPEG", None))
    return p.select("id", video.target_extension(C("target")).alias("extension"), video.target_label(C("target")).alias("label"), images.is_modern_format(formats).alias("modern"))


QUERIES = {
    f.__name__: f for f in (
        lossless_streams, header_streams, byte_figures, sidecar_lines, exif_dates, run_log_counts, merged_log_lines, text_figures, option_hashes, grade_checks, intact_outputs,
        resumed_batch, stored_metadata, metadata_value, copy_counts, target_formats,
    )
} | {f"sorted_{how}": _sorted(how) for how in catalog.SORTS}

_IN = lambda *names: ", ".join(f"'{n}'" for n in names)
_RANKED = "WITH {ctes} SELECT path, row_number() OVER (ORDER BY {order}) AS rank FROM files {where}"

SQL = {
    "lossless_streams": f"""WITH p AS (SELECT p_partkey AS id, p_partkey // 3 AS n, p_partkey % 11 AS profile, p_partkey // 3 % 4 AS chroma, p_partkey % 7 = 0 AS rgb, p_partkey % 13 = 0 AS deep, p_partkey % 5 % 3 AS av1,
        p_partkey // 3 % 32 & 1 = 1 AS half_y, p_partkey // 3 % 32 & 2 = 2 AS half_x, p_partkey // 3 % 32 & 4 = 4 AS mono, p_partkey // 3 % 32 & 24 > 0 AS bits FROM part)
      SELECT id, CASE id % 3 WHEN 0 THEN CASE WHEN chroma IN (1, 2) OR profile IN (1, 2, 3) THEN FALSE WHEN profile IN (4, 9) THEN CASE WHEN chroma = 3 OR rgb OR deep THEN TRUE END WHEN id % 5 = 0 THEN CASE WHEN chroma = 3 THEN TRUE END ELSE FALSE END
        WHEN 1 THEN CASE WHEN half_x OR (mono AND half_y) THEN FALSE WHEN rgb THEN TRUE WHEN half_y THEN NULL WHEN av1 = 0 OR bits OR mono OR deep THEN TRUE END
        ELSE {pick('n', *JXL_BODIES.values())} END AS lossless FROM p""",
    "header_streams": """WITH p AS (SELECT p_partkey AS id, p_partkey % 9 AS n FROM part)
      SELECT id, CASE id % 5 WHEN 0 THEN n % 2 = 0 WHEN 1 THEN n NOT IN (6, 7) WHEN 2 THEN n < 5 WHEN 3 THEN n % 3 = 1 END AS lossless, CASE WHEN id % 5 = 4 AND n % 2 = 1 THEN n ELSE 1 END AS frames FROM p""",
    "byte_figures": """WITH p AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS png, p_partkey % 3 = 1 AS gif, p_partkey % 3 = 2 AS jpeg, p_partkey % 4 AS n FROM part)
      SELECT id, CASE WHEN png THEN n ELSE 0 END AS idat, CASE WHEN png AND id % 5 = 0 THEN 1 ELSE 0 END AS actl, CASE WHEN gif THEN CAST(power(2, 1 + id % 8) AS BIGINT) END AS palette, CASE WHEN gif THEN n ELSE 0 END AS frames,
      round(CASE WHEN gif THEN n * (id % 100) / 100e0 ELSE 0e0 END, 6) AS duration, CASE WHEN gif THEN 'NETSCAPE2.0' END AS vendor, """
    + ", ".join(f"CASE WHEN jpeg THEN (id + {place}) % 200 + 1 END AS q{k}" for k, place in ((0, 0), (1, 1), (8, 2), (9, 4), (63, 63))) + " FROM p",
    "sidecar_lines": """SELECT p_partkey AS id, 'doc ' || p_partkey AS document_id, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS derived_from, CASE WHEN p_partkey % 3 > 0 THEN trim(p_name) END AS source FROM part""",
    "exif_dates": """SELECT '/a' || o_orderkey AS path, CAST(o_orderdate AS VARCHAR) AS exif_original, CAST(NULL AS VARCHAR) AS xmp_created, CAST(NULL AS VARCHAR) AS xmp_history FROM orders
      UNION ALL SELECT '/b' || o_orderkey, NULL, '-', '2001:02:03' FROM orders""",
    "run_log_counts": "SELECT event_id AS id, user_id AS succeeded, 0::BIGINT AS skipped, CASE WHEN event_id % 3 > 0 THEN event_id % 5 ELSE 0 END AS failed FROM events",
    "merged_log_lines": """SELECT section, line_no, line, count(*) AS lines FROM (SELECT 0 AS section, 0 AS line_no, 'start' AS line FROM supplier UNION ALL SELECT 0, 1, s_name FROM supplier UNION ALL SELECT 1, 0, n_name FROM nation) GROUP BY ALL""",
    "text_figures": f"""WITH p AS (SELECT p_partkey AS id, p_name AS name, {pick('p_partkey', 93784, 123, 36059, None, None)} AS secs FROM part)
      SELECT id, CASE WHEN length(name) <= 12 THEN name ELSE left(name, 9) || '...' END AS short, CASE WHEN length(name) <= 3 THEN name ELSE '...' END AS shortest, regexp_replace(name || id, '[^0-9]', '', 'g') AS digits, secs::BIGINT AS secs,
      CASE id % 3 WHEN 0 THEN round(('0.' || (id % 90 + 10))::DOUBLE, 6) WHEN 1 THEN 'inf'::DOUBLE END AS ssim, CASE WHEN id % 5 = 4 THEN 7e0 ELSE 4.5e0 END AS number FROM p""",
    "option_hashes": "SELECT p_partkey AS id, TRUE AS same, p_size::VARCHAR = p_type AS swapped FROM part",
    "grade_checks": f"""WITH {ctes('trace')}, q AS (SELECT *, least(greatest(CASE WHEN crf < 20 THEN 0.95e0 WHEN crf < 30 THEN 0.95e0 - (crf - 20) / 10 * 0.03e0 ELSE 0.92e0 - least((crf - 30) / 20, 1) * 0.04e0 END, 0.85e0), 0.98e0) AS least_ssim FROM trace)
      SELECT event_id, abs(ssim - round(ssim, 2)) < {grades.EPSILON!r}::DOUBLE AS round, ssim >= least_ssim - {grades.SSIM_EPSILON!r}::DOUBLE AS meets, crf BETWEEN 15e0 - {grades.CRF_EPSILON!r}::DOUBLE AND 30e0 + {grades.CRF_EPSILON!r}::DOUBLE AS within,
      round((6 * ssim + psnr / 97 + crf / 89) / 8, 6) AS weighted, round(least(ssim * 0.3e0 + psnr / 53 * 0.3e0 + crf / 47 * 0.2e0 + ssim * 0.2e0, 1), 6) AS confidence, event_id % 4 > 0 AND event_id % 3 < 2 AS same_length,
      round(CASE WHEN event_id % 5 > 0 THEN secs / (event_id % 5) * (60 - event_id % 5) END, 6) AS eta, round(CASE WHEN event_id % 2 = 0 THEN crf WHEN event_id % 3 = 0 THEN psnr WHEN event_id % 5 = 0 THEN ssim ELSE 1e0 END, 6) AS start FROM q""",
    "intact_outputs": f"WITH {ctes('files')} SELECT file_id, coalesce(size > 0 AND size >= 400, FALSE) AS intact FROM files",
    "resumed_batch": f"""WITH {ctes('log', 'present')}, e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS k FROM log) WHERE k = 1)
      SELECT path FROM present p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.path = p.path AND e.size = p.size AND e.mtime = p.mtime AND e.ctime = p.ctime AND e.btime = p.btime)""",
    "stored_metadata": """SELECT n_name AS key, CASE WHEN n_nationkey % 3 = 0 THEN '3' ELSE n_regionkey::VARCHAR END AS value FROM nation
      UNION ALL SELECT 'new ' || n_name, '3' FROM nation WHERE n_nationkey % 3 > 0""",
    "metadata_value": "SELECT CASE WHEN n_nationkey % 3 = 0 THEN '3' ELSE n_regionkey::VARCHAR END AS value FROM nation WHERE n_name = 'FRANCE'",
    "copy_counts": f"WITH {ctes('results')} SELECT count(*) AS total, count(*) FILTER (ok AND NOT skipped) AS copied, count(*) FILTER (skipped) AS skipped, count(*) FILTER (NOT ok AND NOT skipped) AS failed FROM results",
    "target_formats": f"""WITH t AS (SELECT p_partkey AS id, {pick('p_partkey', *V.TARGETS, 'Other')} AS target, {pick('p_partkey', 'HEIC', 'PNG', 'AVIF', 'JXL', 'HEIF', 'JPEG', None)} AS format FROM part)
      SELECT id, CASE {' '.join(f"WHEN target = '{k}' THEN '{e}'" for k, (e, _) in V.TARGETS.items())} END AS extension, CASE {' '.join(f"WHEN target = '{k}' THEN '{n}'" for k, (_, n) in V.TARGETS.items())} END AS label, coalesce(format IN ({_IN(*V.MODERN_FORMATS)}), FALSE) AS modern FROM t""",
    "sorted_size_asc": _RANKED.format(ctes=ctes("files"), order="size, path", where="WHERE size IS NOT NULL"),
    "sorted_size_desc": _RANKED.format(ctes=ctes("files"), order="size DESC, path", where="WHERE size IS NOT NULL"),
    "sorted_name": _RANKED.format(ctes=ctes("files"), order="path", where=""),
}
