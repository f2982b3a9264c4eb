"""Probe JSON, colours, search limits and what else describes streams and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import color, errors, grades, images, text
from tessera.operators import catalog, matching, runs
from tessera.plans.inputs import ctes, load, pick
from tessera.plans.scalars import _STATUS
from tessera.sources import magic, probe

C = F.col


def stream_sizes(spark, d):
    return probe.stream_sizes(load(spark, d, "probe_json")).select("id", "video_size", "audio_size", "overhead", "method")


def precheck_figures(spark, d):
    return probe.precheck_figures(load(spark, d, "probe_json")).select("id", "duration", "fps", "frames", "bpp")


def probe_streams(spark, d):
    return probe.parsed_probe(load(spark, d, "probe_json")).select("id", "codec", "width", "height", "fps", "audio_codec", "has_audio", "video_bit_rate", F.col("bit_depth"))


def color_codes(spark, d):
    c = load(spark, d, "colors")
    p, t, m = C("primaries"), C("transfer"), C("matrix")
    return c.select(
        "id", color.cicp(p, t, m).alias("cicp"), color.encoder_arguments(p, t, m).alias("arguments"), color.dolby_profile(C("profile"), C("compat")).alias("dolby"),
        color.audio_arguments(C("audio"), C("container")).alias("audio"), color.subtitle_arguments(C("subtitle"), C("container"), C("id") % 3 > 0).alias("subtitles"),
    )


def search_limits(spark, d):
    t = load(spark, d, "trace")
    limits = {e: grades.search_limits(C("crf"), e) for e in grades.SCALES}
    c = grades.calibrated(C("crf"), C("size"), C("input_size"), 4.0)
    return t.select(
        "event_id", *[v[f].alias(f"{e}_{f}") for e, v in limits.items() for f in ("max_crf", "min_ssim")], c["crf"].alias("cpu_crf"), c["confidence"].alias("trust"),
        grades.anchor_offset(C("size") / 20_011.0).alias("anchor"), grades.most_iterations(C("secs") * 400.0).alias("iterations"), text.eta_text(C("size") * C("secs")).alias("eta"),
    )


def png_verdicts(spark, d):
    names = [n for group in images.QUANTISATION.values() for n in group]
    signs = {n: (C("id") * (7 + k) % 11) / 10.0 for k, n in enumerate(names)}
    i = load(spark, d, "images").select("id", "quality", images.quantisation_score(signs).alias("score"), images.truecolour_verdict(C("edge_density"), C("contrast"), C("noise_level")).alias("t"))
    v = images.quantisation_verdict(C("score"), C("id") % 13 == 0)
    return i.select(
        "id", "score", v["quantised"].alias("quantised"), v["confidence"].alias("confidence"), C("t.quantised").alias("true_quantised"), C("t.confidence").alias("true_confidence"),
        images.quick_jpeg_quality(F.when(C("id") % 9 > 0, C("quality"))).alias("jpeg"), images.quick_webp_quality(C("quality")).alias("webp"),
    )


def metadata_sidecars(spark, d):
    return matching.metadata_sidecar(load(spark, d, "media").select("path"), load(spark, d, "sidecars").select("xmp_path"))


def run_counters(spark, d):
    r = runs.classified(load(spark, d, "results"), "image").withColumn("medium", F.when(C("id") % 3 == 0, "image").otherwise("video"))
    return runs.counters(r)


def error_categories(spark, d):
    e = load(spark, d, "events")
    kinds = F.array(*[F.lit(k) for group in errors.CATEGORIES.values() for k in group.split()], F.lit("Unheard"))
    kind = F.get(kinds, (C("event_id") % F.size(kinds)).cast("int"))
    return e.select("event_id", errors.category(kind).alias("category"), F.coalesce(errors.is_skip(kind), F.lit(False)).alias("skip"))


_SIGNS = ("indexed_with_alpha", "large_palette", "colour_anomaly", "entropy_anomaly", "size_anomaly")


def png_quantisation(spark, d):
    p = load(spark, d, "pngs").withColumn("area", C("width").cast("bigint") * C("height"))
    raw = images.png_raw_size(C("width"), C("height"), C("colour_type"), C("bit_depth"))
    signs = images.png_signs(C("colour_type"), C("has_transparency"), C("area"), C("palette"), C("used"), C("entropy"), C("entropy_ratio"), C("size"), raw)
    p = p.withColumns(signs)
    known = {k: C(k) for k in signs} | {"tool_signature": C("tool"), "dithering": C("dithering"), "banding": C("banding"), "frequency": C("frequency")}
    v = images.png_verdict(known, C("colour_type"), C("bit_depth"), C("entropy_ratio"), C("area"))
    return p.select("id", *_SIGNS, v["quantised"].alias("quantised"), v["confidence"].alias("confidence"))


def hdr_side_data(spark, d):
    side = load(spark, d, "side_data").withColumn("side", F.from_json("json", "array<map<string,string>>"))
    return probe.hdr_side_data(side).select("id", "dolby_vision", "dv_profile", "hdr10_plus", "mastering_display", "max_cll")


def expired_logs(spark, d):
    logs = load(spark, d, "orders").select(F.concat(F.lit("/logs/"), F.when(C("o_custkey") % 3 == 0, "img_").otherwise("vid_"), C("o_orderkey").cast("string"), F.lit(".log")).alias("path"), C("o_custkey").alias("modified"))
    return catalog.expired_logs(logs, "img_", 500)


# Beginnings of files, and their formats.
HEADS = {
    "89504E470D0A1A0A": "PNG", "FFD8FFE0": "JPEG", "474946383961": "GIF", "524946460000000057454250": "WebP", "0000002066747970617669660000": "AVIF", "00000020667479706865696300": "HEIC",
    "0000002066747970686569660000": "HEIF", "00000020667479706D6966310000000061766966": "AVIF", "000000206674797069736F6D": "Unknown", "FF0A": "JXL", "0000000C4A584C20": "JXL", "4D4D002A": "TIFF",
    "424D": "BMP", "716F6966": "QOI", "FF4FFF51": "JP2", "00000100": "ICO", "762F3101": "EXR", "464C4946": "FLIF", "00": "Unknown",
}


def image_formats(spark, d):
    heads = F.array(*[F.lit(h) for h in HEADS])
    parts = load(spark, d, "part").withColumn("head", F.get(heads, (C("p_partkey") % len(HEADS)).cast("int")))
    padded = F.unhex(F.rpad("head", F.when(C("p_partkey") % 7 == 0, 20).otherwise(80).cast("int"), F.lit("2")))
    return parts.select(C("p_partkey").alias("id"), magic.image_format(padded).alias("format"))


QUERIES = {f.__name__: f for f in (stream_sizes, precheck_figures, probe_streams, color_codes, search_limits, png_verdicts, metadata_sidecars, run_counters, error_categories, image_formats, png_quantisation, hdr_side_data, expired_logs)}

_J = f"WITH {ctes('probe_json')}"
_S = "json_extract_string(json, '$.streams[{k}].{f}')"
_RATE = "CASE WHEN contains({c}, '/') THEN try_cast(split_part({c}, '/', 1) AS DOUBLE) / nullif(try_cast(split_part({c}, '/', 2) AS DOUBLE), 0) ELSE try_cast({c} AS DOUBLE) END"
_VIDEO = lambda f: _S.format(k=0, f=f)
_FIG = f"""{_J}, a AS (SELECT *, {_RATE.format(c=_VIDEO('avg_frame_rate'))} AS mean, {_RATE.format(c=_VIDEO('r_frame_rate'))} AS real, coalesce(try_cast({_VIDEO('nb_frames')} AS BIGINT), 0) AS own, try_cast({_VIDEO('nb_read_frames')} AS BIGINT) AS counted0,
    try_cast({_VIDEO('bit_rate')} AS BIGINT) AS bits, try_cast({_VIDEO('duration')} AS DOUBLE) AS sd, try_cast(json_extract_string(json, '$.format.duration') AS DOUBLE) AS fd, {_VIDEO('width')}::BIGINT * {_VIDEO('height')}::BIGINT AS area FROM probe_json),
  b AS (SELECT *, coalesce(CASE WHEN mean > 0 AND mean <= 10000 THEN mean END, CASE WHEN real > 0 THEN real END) AS rate, CASE WHEN own = 0 THEN coalesce(counted0, own) ELSE own END AS counted FROM a),
  c AS (SELECT *, coalesce(CASE WHEN sd > 0 THEN sd END, CASE WHEN fd > 0 THEN fd END, CASE WHEN counted > 0 THEN counted / rate END) AS dur FROM b),
  e AS (SELECT *, CASE WHEN rate > 10000 AND dur >= 0.001e0 AND counted / dur > 0 AND counted / dur <= 10000 THEN counted / dur ELSE rate END AS f FROM c),
  g AS (SELECT *, CASE WHEN counted = 0 AND dur > 0 THEN trunc(dur * f)::BIGINT ELSE greatest(counted, 1) END AS n, CASE WHEN bits > 0 THEN trunc(bits * dur / 8)::BIGINT END AS sb FROM e)"""

SQL = {
    "stream_sizes": f"""{_J}, s AS (SELECT *, try_cast(json_extract_string(json, '$.format.duration') AS DOUBLE) AS secs, {_VIDEO('codec_type')} AS k0, try_cast({_VIDEO('bit_rate')} AS BIGINT) AS b0, try_cast({_S.format(k=1, f='bit_rate')} AS BIGINT) AS b1 FROM probe_json),
      v AS (SELECT *, coalesce(trunc(b0 * secs / 8)::BIGINT, 0) AS vs, coalesce(trunc(b1 * secs / 8)::BIGINT, 0) AS au, trunc(size * CASE lower(regexp_extract(path, '\\.([^.]*)$', 1)) WHEN 'mov' THEN 0.005e0 WHEN 'mp4' THEN 0.001e0 WHEN 'm4v' THEN 0.001e0 WHEN 'mkv' THEN 0.0005e0 WHEN 'webm' THEN 0.0005e0 ELSE 0.002e0 END)::BIGINT AS guess FROM s),
      w AS (SELECT *, coalesce(secs > 0 AND vs > 0, FALSE) AS known FROM v)
      SELECT id, CASE WHEN known THEN vs ELSE greatest(size - guess, 0) END AS video_size, CASE WHEN known THEN au ELSE 0 END AS audio_size, CASE WHEN known THEN greatest(size - vs - au, 0) ELSE guess END AS overhead, CASE WHEN known THEN 'BitrateCalculation' ELSE 'Estimated' END AS method FROM w""",
    "precheck_figures": f"{_FIG} SELECT id, round(dur, 6) AS duration, round(f, 6) AS fps, n AS frames, round(CASE WHEN rate IS NOT NULL AND dur IS NOT NULL THEN CASE WHEN sb > 0 THEN sb ELSE size END * 8e0 / nullif(area * n, 0) END, 6) AS bpp FROM g",
    "probe_streams": f"""{_FIG} SELECT id, {_VIDEO('codec_name')} AS codec, {_VIDEO('width')}::INT AS width, {_VIDEO('height')}::INT AS height, round(coalesce(CASE WHEN mean > 0 THEN mean END, CASE WHEN real > 0 THEN real END), 6) AS fps, {_S.format(k=1, f='codec_name')} AS audio_codec,
      {_S.format(k=1, f='codec_type')} IS NOT NULL AS has_audio, bits AS video_bit_rate, 8 AS bit_depth FROM b""",
    "color_codes": f"""WITH {ctes('colors')}, a AS (SELECT *, CASE WHEN primaries = 'bt709' THEN 1 WHEN primaries = 'bt2020' THEN 9 WHEN primaries IN ('smpte432', 'display-p3') THEN 12 WHEN transfer IN ('smpte2084', 'arib-std-b67') THEN 9 END AS p FROM colors),
      b AS (SELECT *, CASE WHEN transfer = 'smpte2084' THEN 16 WHEN transfer = 'arib-std-b67' THEN 18 WHEN transfer = 'bt709' THEN 1 WHEN transfer IN ('srgb', 'iec61966-2-1') THEN 13 WHEN p = 9 THEN 16 END AS t, CASE WHEN matrix IN ('bt2020nc', 'bt2020-ncl') THEN 9 WHEN matrix = 'bt709' THEN 1
        WHEN matrix IN ('rgb', 'gbr') THEN 0 WHEN p IN (9, 1) THEN p ELSE 0 END AS m FROM a)
      SELECT id, p || '-' || t || '-' || m AS cicp, concat_ws(' ', '-colorspace ' || matrix, '-color_trc ' || transfer, '-color_primaries ' || primaries) AS arguments, CASE profile WHEN 5 THEN '5.0' WHEN 7 THEN '8.1' WHEN 8 THEN '8.' || coalesce(compat, 1) END AS dolby,
      CASE WHEN coalesce(audio, '') = '' THEN '-an' WHEN container ILIKE 'mkv' OR NOT regexp_matches(lower(audio), 'opus|vorbis') THEN '-c:a copy' ELSE '-c:a aac -b:a 256k' END AS audio,
      CASE WHEN id % 3 = 0 THEN '' WHEN container ILIKE 'mkv' THEN '-c:s copy' WHEN lower(subtitle) IN ('srt', 'subrip', 'ass', 'ssa', 'mov_text', 'webvtt', 'text') THEN '-c:s mov_text' ELSE '-sn' END AS subtitles FROM b""",
    "search_limits": f"""WITH {ctes('trace')}, s AS (SELECT *, round(least(greatest(CASE WHEN crf < 20 THEN 0.95e0 WHEN crf < 30 THEN 0.95e0 - (crf - 20) / 10 * 0.03e0 ELSE 0.92e0 - least((crf - 30) / 20, 1) * 0.04e0 END, 0.85e0), 0.98e0), 6) AS q, size * secs AS e, size / input_size AS r FROM trace)
      SELECT event_id, {', '.join(f"round(least(crf + 8 + least(power(crf / {s}, 2), 1) * 7, {c}), 6) AS {e}_max_crf, q AS {e}_min_ssim" for e, (s, c) in grades.SCALES.items())}, round(least(greatest(crf + 4 + CASE WHEN r < 0.95e0 THEN 1e0 WHEN r < 1 THEN 0.5e0 WHEN r < 1.05e0 THEN -0.5e0 ELSE -1e0 END, 10), 51), 6) AS cpu_crf,
      CASE WHEN r < 0.95e0 THEN 0.85e0 WHEN r < 1 THEN 0.90e0 WHEN r < 1.05e0 THEN 0.80e0 ELSE 0.70e0 END AS trust, CASE WHEN r >= 1 THEN 0e0 WHEN r < 0.70e0 THEN 4e0 WHEN r < 0.80e0 THEN 3.5e0 WHEN r < 0.90e0 THEN 3e0 ELSE 2.5e0 END AS anchor,
      CASE WHEN secs * 400 >= 600 THEN 100 WHEN secs * 400 >= 300 THEN 150 ELSE 100 END AS iterations, CASE WHEN e >= 86401 THEN '>24h' WHEN e >= 3600 THEN trunc(e)::BIGINT // 3600 || 'h ' || trunc(e)::BIGINT % 3600 // 60 || 'm' WHEN e >= 60 THEN trunc(e)::BIGINT // 60 || 'm ' || trunc(e)::BIGINT % 60 || 's' ELSE trunc(e)::BIGINT || 's' END AS eta FROM s""",
    "png_verdicts": f"""WITH {ctes('images')}, s AS (SELECT *, {' + '.join(f"{w}e0 * ({' + '.join(f'(id * {7 + [n for g in images.QUANTISATION.values() for n in g].index(x)} % 11) / 10e0' for x in names)}) / {len(names)}" for w, names in images.QUANTISATION.items())} AS score,
        CASE WHEN edge_density >= 0.5e0 THEN 1 ELSE 0 END + CASE WHEN contrast >= 0.5e0 THEN 1 ELSE 0 END + CASE WHEN noise_level >= 0.5e0 THEN 1 ELSE 0 END AS strong FROM images)
      SELECT id, round(score, 6) AS score, id % 13 = 0 OR score >= 0.58e0 AS quantised, round(CASE WHEN id % 13 = 0 THEN 0.99e0 WHEN score >= 0.70e0 THEN 0.9e0 + (score - 0.70e0) * 0.33e0 WHEN score >= 0.58e0 THEN 0.7e0 + (score - 0.58e0) WHEN score >= 0.30e0 THEN 0.5e0 + (0.58e0 - score) ELSE 0.8e0 + (0.30e0 - score) * 0.67e0 END, 6) AS confidence,
      strong >= 2 AS true_quantised, round(CASE WHEN strong >= 2 THEN 0.70e0 + (edge_density + contrast + noise_level) / 3 * 0.15e0 WHEN strong = 1 THEN 0.65e0 ELSE 0.90e0 END, 6) AS true_confidence,
      CASE WHEN id % 9 = 0 THEN 85 WHEN quality <= 2 THEN 98 WHEN quality <= 5 THEN 95 WHEN quality <= 10 THEN 90 WHEN quality <= 20 THEN 85 WHEN quality <= 40 THEN 75 WHEN quality <= 60 THEN 65 ELSE 50 END AS jpeg, least((127 - quality % 128) * 100 // 127, 100)::INT AS webp FROM s""",
    "metadata_sidecars": f"""WITH {ctes('sidecars', 'media')}, f AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1') AS stem, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '.\\.([^.]*)$', 1) AS ext FROM media),
      x AS (SELECT xmp_path, regexp_extract(xmp_path, '^(.*)/[^/]*$', 1) AS xd, lower(regexp_replace(regexp_extract(xmp_path, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1')) AS xs FROM sidecars WHERE lower(right(xmp_path, 4)) = '.xmp')
      SELECT path, coalesce((SELECT min(xmp_path) FROM x WHERE f.ext <> '' AND xmp_path = f.path || '.xmp'), (SELECT min(xmp_path) FROM x WHERE xmp_path = f.dir || '/' || f.stem || '.xmp'),
        (SELECT min(xmp_path) FROM x WHERE xd = f.dir AND (xs = lower(f.stem) OR xs = lower(f.stem) || '.' || f.ext OR split_part(xs, '.', 1) = split_part(lower(f.stem), '.', 1)))) AS sidecar FROM f""",
    "run_counters": f"{_STATUS}, m AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'image' ELSE 'video' END AS medium FROM r) SELECT " + ", ".join(f"count(*) FILTER (medium = '{m}' AND image = '{o}') AS {m}_{o}" for m in ("image", "video") for o in ("succeeded", "failed", "skipped")) + " FROM m",
    "png_quantisation": f"""WITH {ctes('pngs')}, a AS (SELECT *, width::BIGINT * height AS area FROM pngs), b AS (SELECT *, palette / sqrt(area) AS density, used / palette AS share, coalesce(palette, 256) AS colours, ceil(area * CASE colour_type WHEN 2 THEN 3 WHEN 4 THEN 2 WHEN 6 THEN 4 ELSE 1 END * bit_depth / 8e0) AS raw FROM a),
      c AS (SELECT *, CASE WHEN colour_type <> 3 THEN 0e0 WHEN has_transparency THEN 0.98e0 WHEN area > 100000 THEN 0.75e0 WHEN area > 10000 THEN 0.45e0 ELSE 0.15e0 END AS indexed_with_alpha,
        CASE WHEN palette > 240 THEN 0.95e0 WHEN palette > 200 THEN 0.85e0 WHEN area > 100000 AND palette > 64 THEN 0.80e0 WHEN area > 100000 AND palette > 32 THEN 0.60e0 WHEN area > 10000 AND palette > 128 THEN 0.50e0 WHEN palette <= 16 AND density > 0.5e0 THEN 0e0
          WHEN palette <= 32 AND density > 0.3e0 THEN 0.1e0 WHEN density < 0.5e0 THEN 0.3e0 ELSE 0.15e0 END AS lp,
        CASE WHEN colour_type <> 3 OR palette IS NULL THEN 0e0 WHEN area > 100000 THEN CASE WHEN share > 0.8e0 THEN 0.85e0 WHEN share > 0.5e0 THEN 0.70e0 ELSE 0.50e0 END WHEN share > 0.9e0 AND palette > 200 THEN 0.8e0 WHEN share > 0.7e0 AND palette > 128 THEN 0.5e0 ELSE 0e0 END AS colour_anomaly,
        CASE WHEN colour_type <> 3 THEN 0e0 WHEN colours >= 64 AND entropy_ratio < 0.6e0 AND area > 10000 THEN least(0.5e0 + (0.6e0 - entropy_ratio) * 0.5e0, 0.75e0) WHEN colours >= 128 AND entropy < 5 AND area > 10000 THEN least(0.5e0 + (5 - entropy) * 0.08e0, 0.7e0)
          WHEN colours >= 64 AND entropy_ratio < 0.5e0 AND area > 5000 THEN 0.35e0 ELSE 0e0 END AS entropy_anomaly, CASE WHEN colour_type = 3 AND area > 100000 AND size < raw * 0.15e0 THEN 0.6e0 ELSE 0e0 END AS size_anomaly,
        CASE WHEN area > 10000 AND entropy_ratio < 0.55e0 THEN 0.70e0 WHEN area > 10000 AND entropy_ratio < 0.65e0 THEN 0.40e0 ELSE 0e0 END AS flat FROM b),
      e AS (SELECT *, CASE WHEN palette IS NULL THEN 0e0 WHEN area > 100000 AND palette * 1e6 < area * 50 THEN greatest(lp, 0.70e0) ELSE lp END AS large_palette FROM c),
      g AS (SELECT *, 0.25e0 * (indexed_with_alpha + large_palette) + 0.15e0 * tool + 0.0625e0 * (dithering + colour_anomaly + banding + frequency) + 0.05e0 * (size_anomaly + entropy_anomaly) AS score,
        CASE WHEN frequency >= 0.5e0 THEN 1 ELSE 0 END + CASE WHEN flat >= 0.5e0 THEN 1 ELSE 0 END + CASE WHEN banding >= 0.5e0 THEN 1 ELSE 0 END AS strong FROM e)
      SELECT id, {', '.join(f'round({x}, 6) AS {x}' for x in _SIGNS)}, CASE WHEN bit_depth = 16 THEN FALSE WHEN colour_type IN (2, 6) AND tool < 1 THEN strong >= 2 ELSE tool >= 1 OR score >= 0.58e0 END AS quantised,
      round(CASE WHEN bit_depth = 16 THEN 1e0 WHEN colour_type IN (2, 6) AND tool < 1 THEN CASE WHEN strong >= 2 THEN 0.70e0 + (frequency + flat + banding) / 3 * 0.15e0 WHEN strong = 1 THEN 0.65e0 ELSE 0.90e0 END WHEN tool >= 1 THEN 0.99e0
        WHEN score >= 0.70e0 THEN 0.9e0 + (score - 0.70e0) * 0.33e0 WHEN score >= 0.58e0 THEN 0.7e0 + (score - 0.58e0) WHEN score >= 0.30e0 THEN 0.5e0 + (0.58e0 - score) ELSE 0.8e0 + (0.30e0 - score) * 0.67e0 END, 6) AS confidence FROM g""",
    "hdr_side_data": f"""WITH {ctes('side_data')}, k AS (SELECT *, lower(json_extract_string(json, '$[0].side_data_type')) AS k0, lower(json_extract_string(json, '$[1].side_data_type')) AS k1 FROM side_data)
      SELECT id, coalesce(contains(k0, 'dovi'), FALSE) AS dolby_vision, CASE WHEN contains(k0, 'dovi') THEN try_cast(json_extract_string(json, '$[0].dv_profile') AS INT) END AS dv_profile, coalesce(contains(k0, 'hdr10+'), FALSE) AS hdr10_plus,
      CASE WHEN contains(k0, 'mastering display') THEN 'G(8500,39850)B(6550,2300)R(35400,14600)WP(15635,16450)L(' || split_part(json_extract_string(json, '$[0].max_luminance'), '/', 1) || ',50)' END AS mastering_display,
      CASE WHEN contains(k1, 'content light') THEN json_extract_string(json, '$[1].max_content') || ',200' END AS max_cll FROM k""",
    "expired_logs": """WITH l AS (SELECT '/logs/img_' || o_orderkey || '.log' AS path, o_custkey AS modified FROM orders WHERE o_custkey % 3 = 0) SELECT path, modified FROM (SELECT *, row_number() OVER (ORDER BY modified DESC, path) AS k FROM l) WHERE k > 500""",
    "image_formats": f"SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN {pick('p_partkey', *HEADS.values())} END AS format FROM part",
    "error_categories": f"""WITH k AS (SELECT event_id, {pick('event_id', *[k for g in errors.CATEGORIES.values() for k in g.split()], 'Unheard')} AS kind FROM events) SELECT event_id, CASE {' '.join(f"WHEN kind IN ({', '.join(repr(k) for k in g.split())}) THEN '{n}'" for n, g in errors.CATEGORIES.items())} END AS category, kind = 'OutputExists' AS skip FROM k""",
}
