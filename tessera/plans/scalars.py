"""Decisions, scores and gates of single rows, and rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import values as V
from tessera.functions import codecs, errors, gif, grades, images, quality, sizes, text, video
from tessera.operators import classify, runs
from tessera.plans.inputs import ctes, load

C = F.col


def source_codecs(spark, d):
    probe = load(spark, d, "probe").withColumn("source", codecs.source_codec(C("codec")))
    s = C("source")
    return probe.select(
        "id", "source", codecs.efficiency(s).alias("efficiency"), codecs.is_lossless(s).alias("lossless"), codecs.is_modern(s).alias("modern"),
        codecs.is_cutting_edge(s).alias("cutting_edge"), codecs.skip_video(s).alias("skip"), codecs.skip_video(s, True).alias("skip_apple"),
        codecs.apple_incompatible(s).alias("incompatible"), codecs.skip_image(s, C("has_alpha")).alias("skip_image"),
        codecs.keep_fallback(s, C("bitrate") % 2 == 0, C("bitrate") / 10_000_000.0, C("has_alpha"), F.lit(True), C("codec") == "gif").alias("keep"),
    )


def codec_info(spark, d):
    probe, c = load(spark, d, "probe"), C("codec")
    return probe.select(
        "id", codecs.detected(c).alias("detected"), codecs.detected_label(c).alias("label"), codecs.detected_is(c, V.DETECTED_MODERN).alias("modern"),
        codecs.detected_is(c, V.DETECTED_LOSSLESS).alias("lossless"), codecs.detected_is(c, V.DETECTED_PRODUCTION).alias("production"), codecs.info(c).alias("i"),
    ).select("id", "detected", "label", "modern", "lossless", "production", C("i.name").alias("name"), C("i.long_name").alias("long_name"), C("i.category").alias("category"), C("i.typical_extension").alias("extension"))


def bpp_factors(spark, d):
    probe = quality.with_source_codec(load(spark, d, "probe"))
    return probe.select("id", *[v.alias(k) for k, v in quality.factors(quality.Source.named()).items()])


def rate_factors(spark, d):
    f = quality.factors(quality.Source.named())
    probe = quality.with_source_codec(load(spark, d, "probe")).select("id", "content_type", "estimated_quality", *[v.alias(k) for k, v in f.items()])
    named = {k: C(k) for k in f}
    targets = [quality.effective_bpp(named, t, m).alias(f"{t}_bpp") for t, m in (("av1", "quality"), ("hevc", "size"), ("jxl", "speed"))]
    probe = probe.select("id", "content_type", "estimated_quality", *targets)
    t = C("content_type")
    return probe.select(
        "id", "av1_bpp", "hevc_bpp", "jxl_bpp", quality.rate_factor(C("av1_bpp"), t, "av1").alias("av1_crf"), quality.rate_factor(C("hevc_bpp"), t, "hevc", "aggressive").alias("hevc_crf"),
        quality.jxl_distance(C("jxl_bpp"), C("estimated_quality"), t, "conservative").alias("jxl_distance"),
    )


def match_confidence(spark, d):
    return quality.with_source_codec(load(spark, d, "probe")).select("id", quality.presence_confidence(quality.Source.named()).alias("confidence"))


def _video(spark, d):
    per_second = C("width").cast("double") * C("height") * C("fps")
    return load(spark, d, "probe").withColumn("bits", F.when(per_second > 0, C("bitrate") / F.nullif(per_second, F.lit(0.0)))).withColumn("source", codecs.source_codec(C("codec"))).withColumn("kind", video.codec_type(C("source")))


def video_quality(spark, d):
    v = _video(spark, d).withColumn("level", video.compression_level(C("bits"), C("kind"))).withColumn("chroma", video.chroma(C("pix_fmt")))
    return v.select(
        "id", "kind", "level", "chroma", video.chroma_quality(C("chroma")).alias("chroma_factor"), video.content_type(C("bits"), C("kind"), C("width"), C("height"), C("fps")).alias("content"),
        video.quality_score(C("bits"), C("kind"), C("bit_depth"), C("level")).alias("score"), video.estimated_crf(C("bits"), C("kind")).alias("crf"),
        video.confidence(C("video_bitrate").isNotNull(), C("gop_size").isNotNull(), C("duration"), (C("duration") * C("fps")).cast("bigint")).alias("confidence"),
        video.fallback_gop(C("fps")).alias("gop"), video.fallback_color_space(C("height")).alias("color_space"), video.even(C("width")).alias("even_width"), video.even(C("height"), True).alias("even_height"),
    )


def encoder_params(spark, d):
    p = C("encoder_params")
    return load(spark, d, "probe").select("id", video.crf_of_params(p).alias("crf"), video.original_crf(p).alias("original"), video.original_crf(p, False).alias("corrected"), video.preset(p).alias("preset"))


def compression_types(spark, d):
    p = C("encoder_params")
    v = load(spark, d, "probe").withColumn("level", video.compression_type(C("codec"), C("bitrate"), C("width"), C("height"), C("fps"), video.original_crf(p), p))
    plain, apple = video.strategy(C("codec"), C("level")), video.strategy(C("codec"), C("level"), True)
    return v.select(
        "id", "level", video.detected_score(C("level"), C("bit_depth"), C("width"), C("height")).alias("score"), video.is_high_fidelity(C("bit_depth"), C("level")).alias("fidelity"),
        plain["target"].alias("target"), plain["crf"].alias("crf"), apple["target"].alias("apple_target"), apple["lossless"].alias("apple_lossless"),
    )


def video_flags(spark, d):
    return load(spark, d, "probe").select(
        "id", video.fps_class(C("fps")).alias("fps_class"), video.sampling(C("duration") * 25.0).alias("sampling"), video.sampled_frames(video.sampling(C("duration") * 25.0), C("bitrate")).alias("frames"),
        video.is_variable_rate(F.when(C("has_alpha"), "mov,mp4").otherwise("matroska"), C("fps"), C("fps") - C("id") % 3, C("id") % 7 == 0).alias("variable"),
        video.is_hdr(C("is_hdr"), F.lit(None).cast("boolean"), C("preset"), F.lit(None).cast("string"), F.when(C("id") % 4 == 0, "smpte2084")).alias("hdr"),
    )


def precheck(spark, d):
    v = _video(spark, d)
    return v.select("id", video.precheck(F.lower("codec"), C("width"), C("height"), C("duration"), C("fps"), C("bitrate") / 1000.0, C("bits")).alias("advice"))


def gif_scores(spark, d):
    g = load(spark, d, "gifs")
    s = gif.scores(C("name"), C("width"), C("height"), C("duration"), C("frames"), C("size"), C("palette"))
    named = gif.name_score(C("name"))
    return g.select("id", named["raw"].alias("name_raw"), named["kind"].alias("name_kind"), *[v.alias(k) for k, v in s.items()])


def gif_verdicts(spark, d):
    g = load(spark, d, "gifs")
    s = gif.scores(C("name"), C("width"), C("height"), C("duration"), C("frames"), C("size"), C("palette"))
    g = g.select("*", s["total"].alias("total"), s["bytes_per_pixel"].alias("bpp"))
    g = g.withColumn("veto", gif.veto(C("width"), C("height"), C("duration"), C("frames"), C("bpp"), F.array("vendor")))
    return g.select("id", "veto", gif.keeps(C("veto"), C("total")).alias("keep"))


def image_advice(spark, d):
    i, f = load(spark, d, "images"), C("format")
    r, s = images.recommendation(f, C("lossless")), images.strategy(f, C("is_animated"), C("lossless"))
    area = C("width").cast("bigint") * C("height")
    return i.select(
        "id", r["recommended_format"].alias("recommended"), r["expected_saving"].alias("saving"), r["preservation"].alias("preservation"), s["target"].alias("target"), s["reduction"].alias("reduction"),
        images.route(f, C("is_animated"), C("lossless")).alias("route"), images.psnr_of_quality(C("quality")).alias("psnr"), images.ssim_of_quality(C("quality")).alias("ssim"),
        images.complexity(C("edge_density"), C("color_diversity"), C("texture_variance"), C("noise_level")).alias("overall"), images.confidence(area, C("size"), C("edge_density"), C("color_diversity")).alias("confidence"),
        images.compression_ratio(C("size"), C("width"), C("height"), F.lit(4), F.lit(8)).alias("ratio"), quality.estimated_still_quality(C("size"), area, C("id") % 3, f, C("entropy")).alias("still_quality"),
    )


def content_classes(spark, d):
    return classify.classify(load(spark, d, "images"), "id")


def _quant_tables(spark, d):
    parts = load(spark, d, "part", spread=True).select(C("p_partkey").alias("id"))
    base = classify.scaled_table(1 + C("id") * 7 % 100, V.JPEG_LUMINANCE)
    return parts.select("id", F.transform(base, lambda v, k: v + F.when((k == C("id") % 64) & (C("id") % 3 > 0), C("id") % 5).otherwise(0)).alias("table"))


def jpeg_quality(spark, d):
    return classify.jpeg_quality(_quant_tables(spark, d), "id")


def jpeg_table_errors(spark, d):
    t = _quant_tables(spark, d).withColumn("near", classify.scaled_table(F.lit(75), V.JPEG_LUMINANCE))
    return t.select("id", classify.squared_error(C("table"), C("near")).alias("sse"), classify.weighted_error(C("table"), C("near")).alias("weighted"))


def size_gates(spark, d):
    p, out = load(spark, d, "probe"), F.floor(C("file_size") * 0.97 + C("id") * 997).cast("bigint")
    p = p.withColumn("out", out)
    o, i, t = C("out"), C("file_size"), C("has_alpha")
    path = F.concat(F.lit("/v/a."), F.element_at(F.array(*map(F.lit, ("mov", "mp4", "mkv", "avi", "WEBM", "m4v"))), (C("id") % 6 + 1).cast("int")))
    return p.select(
        "id", "out", sizes.margin(i).alias("margin"), sizes.target_size(i).alias("target"), sizes.fits_with_metadata(o, i).alias("fits"), sizes.compared_size(o, i, C("id") * 50).alias("compared"),
        sizes.is_smaller(o, i, t).alias("smaller"), sizes.is_discarded(o, i, t).alias("discarded"), sizes.ratio(o, i).alias("ratio"), sizes.reduction_percent(o, i).alias("reduction"), sizes.change_percent(o, i).alias("change"),
        sizes.estimated_overhead(path, i).alias("overhead"), sizes.overhead_percent(sizes.estimated_overhead(path, i), i).alias("overhead_percent"), text.bytes_text(i).alias("shown"),
    )


def quality_gates(spark, d):
    t = load(spark, d, "trace").withColumn("ms", F.when(C("event_id") % 4 != 0, C("ssim") - 0.02)).withColumn("vmaf", 85.0 + C("event_id") % 15)
    s = F.when(C("event_id") % 7 != 0, C("ssim"))
    psnr = F.when(C("event_id") % 11 == 0, float("inf")).otherwise(C("psnr"))
    return t.select(
        "event_id", grades.passes(s, psnr, C("ms"), 0.95, 33.0).alias("passed"), grades.passes(s, psnr, C("ms"), least_ms_ssim=0.93).alias("ms_passed"),
        grades.passes_ultimate(C("vmaf"), C("event_id") % 9 * 1.0, C("psnr"), C("psnr") + 1.0).alias("ultimate"), grades.passes_fused(C("ms"), s, 0.94, C("event_id") % 2 == 0).alias("fused"),
        grades.search_ssim_grade(C("ssim")).alias("ssim_grade"), grades.search_psnr_grade(psnr).alias("psnr_grade"), grades.ms_ssim_grade(C("ms")).alias("ms_grade"),
        grades.image_ssim_grade(C("ssim")).alias("image_ssim"), grades.image_psnr_grade(psnr).alias("image_psnr"), grades.typed_ssim_grade(C("ssim")).alias("typed"), grades.psnr_to_ssim(C("psnr")).alias("guess"),
        grades.crf_key(C("crf")).alias("key"), grades.meets_ssim(C("ssim"), 0.95).alias("meets"), grades.search_score(C("ssim"), C("size"), C("input_size"), True).alias("cpu_score"),
        grades.is_better(C("ssim"), C("ms"), C("ssim"), 0.92).alias("better"), grades.zero_gains(C("secs") * 200.0, C("crf"), False).alias("zero_gains"), grades.most_walls(C("crf") * 3.0).alias("walls"),
        grades.cpu_centre(C("crf"), F.when(C("event_id") % 2 == 0, "Nvidia").otherwise("Apple"), C("secs") / 2.0).alias("centre"),
    )


def message_kinds(spark, d):
    return load(spark, d, "results").select("id", errors.severity(C("message")).alias("severity"), errors.is_disk_full(C("message")).alias("disk_full"))


def batch_summary(spark, d):
    return runs.batch_summary(runs.classified(load(spark, d, "results"), "video"))


def batch_by_severity(spark, d):
    return runs.batch_summary(runs.classified(load(spark, d, "results"), "image").withColumn("severity", errors.severity(C("message"))), ["severity"])


def video_bytes(spark, d):
    return runs.bytes_summary(runs.classified(load(spark, d, "results"), "video"), "video")


def image_bytes(spark, d):
    return runs.bytes_summary(runs.classified(load(spark, d, "results"), "image"), "image")


def health_report(spark, d):
    return runs.health(load(spark, d, "results"))


QUERIES = {
    f.__name__: f for f in (
        source_codecs, codec_info, bpp_factors, rate_factors, match_confidence, video_quality, encoder_params, compression_types, video_flags, precheck, gif_scores,
        gif_verdicts, image_advice, content_classes, jpeg_quality, jpeg_table_errors, size_gates, quality_gates, message_kinds, batch_summary, batch_by_severity, video_bytes, image_bytes, health_report,
    )
}

# --- the same in SQL ---------------------------------------------------------------------------

_P = f"WITH {ctes('probe')}"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _codec(column: str) -> str:
    """CASE over the fixed table of names."""
    out = []
    for line in V.SOURCE_CODECS.strip().splitlines():
        name, _, words = line.split(" ", 2)
        tests = [f"lower({column}) = '{w.strip('=')}'" if w.startswith("=") else " AND ".join(f"contains(lower({column}), '{x}')" for x in w.split("&")) for w in words.split("|")]
        out.append(f"WHEN {' OR '.join(f'({t})' for t in tests)} THEN '{name}'")
    return f"CASE {' '.join(out)} ELSE 'Unknown' END"


def _efficiency(codec: str) -> str:
    pairs = [line.split(" ")[:2] for line in V.SOURCE_CODECS.strip().splitlines()]
    return f"CASE {codec} " + " ".join(f"WHEN '{n}' THEN {f}e0" for n, f in pairs) + " ELSE 1e0 END"


def _table(table: str, k: int, default: str) -> str:
    return "CASE " + " ".join(f"WHEN lower(codec) IN {_IN(r[0].split(','))} THEN '{r[k]}'" for r in V.rows(table)) + f" ELSE {default} END"


_CHANGE = "CASE content_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.CONTENT_ADJUSTMENT.items()) + " ELSE 0 END"
_FACTORS = f"""{_P}, c AS (SELECT *, {_codec('codec')} AS source, width::BIGINT * height AS area FROM probe),
  b AS (SELECT *, CASE WHEN area = 0 THEN NULL WHEN bpp > 0 THEN bpp WHEN video_bitrate > 0 AND fps > 0 THEN video_bitrate / fps / area
      WHEN file_size > 0 THEN CASE WHEN duration > 0 THEN file_size * 8e0 / greatest(trunc(duration * fps)::BIGINT, CASE WHEN fps IS NULL THEN NULL ELSE 1 END) / area ELSE file_size / area END END AS raw FROM c),
  f AS (SELECT *,
    CASE WHEN gop_size IS NULL THEN 1e0 WHEN gop_size = 1 THEN 0.70e0 WHEN gop_size BETWEEN 2 AND 10 THEN 0.85e0 WHEN gop_size BETWEEN 11 AND 50 THEN 1e0 WHEN gop_size BETWEEN 51 AND 150 THEN 1.15e0
      WHEN gop_size BETWEEN 151 AND 300 THEN 1.20e0 ELSE 1.25e0 END * CASE coalesce(b_frame_count, CASE WHEN has_b_frames THEN 2 ELSE 0 END) WHEN 0 THEN 1e0 WHEN 1 THEN 1.05e0 WHEN 2 THEN 1.08e0 ELSE 1.12e0 END AS gop_factor,
    CASE WHEN contains(lower(pix_fmt), '444') THEN 1.15e0 WHEN contains(lower(pix_fmt), '422') THEN 1.05e0 WHEN contains(lower(pix_fmt), 'rgb') OR contains(lower(pix_fmt), 'gbr') THEN 1.20e0 ELSE 1e0 END AS chroma_factor,
    CASE WHEN is_hdr THEN 1.25e0 WHEN contains(lower(color_space), '2020') THEN 1.15e0 ELSE 1e0 END AS hdr_factor,
    CASE WHEN width / greatest(height, 1) > 2.5 THEN 1.08e0 WHEN width / greatest(height, 1) > 2.0 THEN 1.04e0 WHEN width / greatest(height, 1) < 0.5 THEN 1.08e0 ELSE 1e0 END AS aspect_factor,
    CASE WHEN spatial IS NOT NULL AND temporal IS NOT NULL THEN CASE WHEN spatial / 50 > 1.3e0 THEN 1.15e0 WHEN spatial / 50 < 0.7e0 THEN 0.90e0 ELSE 1e0 END * CASE WHEN temporal / 20 > 1.5e0 THEN 1.10e0 WHEN temporal / 20 < 0.5e0 THEN 0.95e0 ELSE 1e0 END
      ELSE CASE WHEN raw / CASE WHEN area > 8000000 THEN 0.15e0 WHEN area > 2000000 THEN 0.20e0 WHEN area > 500000 THEN 0.30e0 ELSE 0.50e0 END > 2 THEN 1.15e0
        WHEN raw / CASE WHEN area > 8000000 THEN 0.15e0 WHEN area > 2000000 THEN 0.20e0 WHEN area > 500000 THEN 0.30e0 ELSE 0.50e0 END > 1 THEN 1 + 0.15e0 * (raw / CASE WHEN area > 8000000 THEN 0.15e0 WHEN area > 2000000 THEN 0.20e0 WHEN area > 500000 THEN 0.30e0 ELSE 0.50e0 END - 1)
        WHEN raw / CASE WHEN area > 8000000 THEN 0.15e0 WHEN area > 2000000 THEN 0.20e0 WHEN area > 500000 THEN 0.30e0 ELSE 0.50e0 END > 0.5 THEN 1e0 ELSE 0.95e0 END END AS complexity_factor,
    CASE WHEN film_grain THEN 1.20e0 ELSE 1e0 END AS grain_factor,
    CASE WHEN area > 8000000 THEN 0.80e0 + 0.05e0 * least(8000000e0 / area, 1) WHEN area > 2000000 THEN 0.85e0 + 0.05e0 * ((8 - area / 1e6) / 6) WHEN area > 500000 THEN 0.90e0 + 0.05e0 * ((2 - area / 1e6) / 1.5e0)
      ELSE 0.95e0 + 0.05e0 * least((0.5e0 - area / 1e6) / 0.5e0, 1) END AS resolution_factor,
    CASE WHEN has_alpha THEN 0.9e0 ELSE 1e0 END AS alpha_factor,
    {_efficiency('source')} * CASE WHEN contains(lower(preset), 'placebo') OR contains(lower(preset), 'veryslow') THEN 0.85e0 WHEN contains(lower(preset), 'slow') THEN 0.90e0 WHEN contains(lower(preset), 'fast') THEN 1.15e0
      WHEN try_cast(preset AS UTINYINT) <= 2 THEN 0.80e0 WHEN try_cast(preset AS UTINYINT) <= 4 THEN 0.90e0 WHEN try_cast(preset AS UTINYINT) <= 6 THEN 1e0 WHEN try_cast(preset AS UTINYINT) <= 8 THEN 1.10e0
      WHEN try_cast(preset AS UTINYINT) <= 10 THEN 1.20e0 WHEN try_cast(preset AS UTINYINT) IS NOT NULL THEN 1.30e0 ELSE 1e0 END AS codec_factor,
    CASE WHEN bit_depth BETWEEN 1 AND 8 THEN CASE WHEN source = 'Gif' THEN 1.3e0 ELSE 1e0 END WHEN bit_depth = 10 THEN 1.25e0 WHEN bit_depth = 12 THEN 1.5e0 WHEN bit_depth = 16 THEN 2e0 ELSE 1e0 END AS depth_factor FROM b)"""
_NAMES = ["gop_factor", "chroma_factor", "hdr_factor", "aspect_factor", "complexity_factor", "grain_factor", "resolution_factor", "alpha_factor", "codec_factor", "depth_factor"]
_PRODUCT = "raw * gop_factor * chroma_factor * hdr_factor * aspect_factor * complexity_factor * grain_factor * {mode} * resolution_factor * alpha_factor / codec_factor / depth_factor / {target}"
_SAFE = "least(greatest({x}, 1e-6), 50)"


def _curve(x: str, top: int, slope: int, low: str, at_least: int, bias: int) -> str:
    safe = _SAFE.format(x=x)
    curve = f"({top} - {slope} * log2({safe} * 100))"
    bent = f"CASE WHEN {safe} < {low} THEN least(35, {curve}) WHEN {safe} > 2 THEN greatest({at_least}, {curve}) ELSE {curve} END"
    return f"CASE WHEN {x} > 0 THEN least(greatest(round(({bent} + {_CHANGE} + {bias}) * 2) / 2, 0), 51)::DOUBLE END"


_KINDS = f"""{_P}, k AS (SELECT *, {_codec('codec')} AS source, CASE WHEN width > 0 AND height > 0 AND fps > 0 THEN bitrate / (width::DOUBLE * height * fps) END AS bits FROM probe),
  v AS (SELECT *, CASE WHEN source IN ('Ffv1', 'UtVideo', 'HuffYuv') THEN 'Lossless' WHEN source IN {_IN(V.SKIPPED_VIDEO_CODECS)} THEN 'ModernEfficient' WHEN source = 'H264' THEN 'Legacy' WHEN source IN ('ProRes', 'DnxHD') THEN 'Intermediate'
    WHEN source IN ('Mjpeg', 'Gif') THEN 'Inefficient' ELSE 'Unknown' END AS kind FROM k),
  w AS (SELECT *, bits / CASE kind WHEN 'ModernEfficient' THEN 0.6e0 WHEN 'Inefficient' THEN 2e0 ELSE 1e0 END AS a, bits / CASE kind WHEN 'ModernEfficient' THEN 0.5e0 WHEN 'Intermediate' THEN 0.7e0 WHEN 'Inefficient' THEN 2e0 ELSE 1e0 END AS e FROM v),
  x AS (SELECT *, CASE WHEN kind = 'Lossless' THEN 'Lossless' WHEN kind = 'Intermediate' THEN 'VisuallyLossless' WHEN a > 1 THEN 'VisuallyLossless' WHEN a > 0.3e0 THEN 'HighQuality' WHEN a > 0.1e0 THEN 'Standard' ELSE 'LowQuality' END AS level,
    CASE WHEN regexp_matches(lower(pix_fmt), '444') THEN 'Yuv444' WHEN regexp_matches(lower(pix_fmt), '422|411') THEN 'Yuv422' WHEN regexp_matches(lower(pix_fmt), '420|nv12|^yuv|410') THEN 'Yuv420' WHEN regexp_matches(lower(pix_fmt), 'rgb|gbr|bgr') THEN 'Rgb' ELSE 'Unknown' END AS chroma FROM w)"""
_BASE = "CASE level WHEN 'Lossless' THEN 100 WHEN 'VisuallyLossless' THEN 95 WHEN 'HighQuality' THEN 80 WHEN 'Standard' THEN 60 ELSE 40 END"
_NUM = lambda key: f"try_cast(nullif(regexp_extract(lower(encoder_params), '^.*?{key}([0-9.]+)', 1), '') AS DOUBLE)"
_ORIGINAL = lambda skip: f"CASE WHEN contains(lower(encoder_params), 'crf=') THEN try_cast(nullif(regexp_extract(lower(encoder_params), '^.*?crf=([0-9.]*)', 1), '') AS DOUBLE) WHEN contains(lower(encoder_params), 'qp=') THEN try_cast(nullif(regexp_extract(lower(encoder_params), '^.*?qp={skip}([0-9.]*)', 1), '') AS DOUBLE) END"
_DETECTED = _table(V.DETECTED_CODECS, 1, "'Unknown'")
_LABEL = _table(V.DETECTED_CODECS, 2, "codec")
_TYPES = f"""{_P}, o AS (SELECT *, {_ORIGINAL('.')} AS crf0, {_DETECTED} AS detected, {_LABEL} AS label, CASE WHEN width > 0 AND height > 0 AND fps > 0 THEN bitrate * 8e0 / (width::DOUBLE * height * fps) END AS bits FROM probe),
  t AS (SELECT *, CASE WHEN detected IN {_IN(V.DETECTED_LOSSLESS)} OR coalesce(regexp_matches(encoder_params, 'lossless=1|qp=0'), FALSE) THEN 'Lossless'
    WHEN crf0 IS NOT NULL THEN CASE WHEN crf0 <= 15 THEN 'VisuallyLossless' WHEN crf0 <= 23 THEN 'HighQuality' WHEN crf0 <= 30 THEN 'Standard' ELSE 'LowQuality' END
    WHEN detected IN ('ProRes', 'DNxHD') THEN 'VisuallyLossless' WHEN bits > 2 THEN 'VisuallyLossless' WHEN bits > 0.5e0 THEN 'HighQuality' WHEN bits > 0.1e0 THEN 'Standard' ELSE 'LowQuality' END AS level, {_codec('label')} AS shown FROM o)"""
_N = lambda x, low, high: f"least(greatest(({x} - {low}) / ({high} - {low}), 0), 1)"
_GIF = f"""WITH {ctes('gifs')}, n AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem, width::BIGINT * height AS area0, greatest(width::BIGINT * height, 1)::DOUBLE AS area FROM gifs),
  w AS (SELECT *, [p FOR p IN regexp_split_to_array(stem, '[-_. ]') IF p <> ''] AS parts, size / (area * greatest(frames, 1)) AS bpp FROM n),
  c AS (SELECT *, list_sum([greatest(len(regexp_extract_all(regexp_replace(p, '[一-鿿぀-ゟ゠-ヿ가-힯]', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+')) + CASE WHEN regexp_matches(p, '[一-鿿぀-ゟ゠-ヿ가-힯]$|[一-鿿]')
      THEN greatest(ceil(len(regexp_extract_all(p, '[一-鿿぀-ゟ゠-ヿ가-힯]')) / 4), 1) ELSE 0 END, 1) FOR p IN parts]) AS words FROM w),
  k AS (SELECT *, CASE WHEN coalesce(name, '') = '' THEN NULL WHEN regexp_full_match(stem, '[0-9A-Fa-f]{{32}}') OR regexp_matches(stem, '^({'|'.join(V.MACHINE_PREFIXES)})') THEN 0.60e0 WHEN regexp_full_match(stem, '[0-9]{{10,16}}') THEN 0.58e0 END AS machine FROM c),
  r AS (SELECT *, CASE WHEN coalesce(name, '') = '' THEN 0.5e0 WHEN machine IS NOT NULL THEN machine WHEN len(parts) = 0 THEN 0.5e0 WHEN words <= 1 THEN 1e0 WHEN words = 2 THEN 0.70e0 WHEN words = 3 THEN 0.35e0 ELSE 0.20e0 END AS name_raw,
    CASE WHEN coalesce(name, '') = '' THEN 'Ambiguous' WHEN machine IS NOT NULL THEN 'MachineGenerated' WHEN len(parts) > 0 AND words <= 2 THEN 'HumanSemantic' ELSE 'Ambiguous' END AS name_kind,
    {_N('bpp', '0.03e0', '0.60e0')} AS busy, CASE WHEN height > 0 THEN width / height ELSE 1e0 END AS ratio FROM k),
  s AS (SELECT *, 1 - busy AS sharpness, 1 - {_N('area', 40000, 2073600)} AS resolution, 1 - {_N('duration', 1, 10)} AS duration_score,
    CASE WHEN ratio BETWEEN 0.75e0 AND 1.35e0 THEN 1e0 WHEN ratio NOT BETWEEN 0.5e0 AND 2 THEN 0.1e0 ELSE 0.6e0 END AS aspect,
    name_raw * (1 - CASE name_kind WHEN 'HumanSemantic' THEN 0.85e0 WHEN 'MachineGenerated' THEN 0.95e0 ELSE 1e0 END * ({_N('area', 40000, 2073600)} * 0.6e0 + {_N('duration', 1, 15)} * 0.4e0)) AS name_effective,
    CASE WHEN duration <= 0.01e0 OR frames = 0 THEN 0.5e0 ELSE least(CASE WHEN 60 / duration >= 20 THEN 1e0 WHEN 60 / duration >= 10 THEN 0.8e0 WHEN 60 / duration >= 5 THEN 0.6e0 WHEN 60 / duration >= 2 THEN 0.4e0 ELSE 0.2e0 END
      + CASE WHEN frames / duration < 5 THEN 0.2e0 WHEN frames / duration < 10 THEN 0.1e0 ELSE 0e0 END, 1) END AS loop,
    CASE WHEN coalesce(palette, 0) <= 0 THEN 0.5e0 WHEN palette IN (1, 2, 4, 8, 16, 32, 64, 128, 256) THEN CASE WHEN palette <= 32 THEN 1e0 WHEN palette <= 64 THEN 0.80e0 WHEN palette <= 128 THEN 0.55e0 ELSE 0.25e0 END
      ELSE greatest(CASE WHEN palette <= 32 THEN 1e0 WHEN palette <= 64 THEN 0.80e0 WHEN palette <= 128 THEN 0.55e0 ELSE 0.25e0 END * 0.85e0, 0.10e0) END AS palette_s FROM r),
  t AS (SELECT *, (sharpness * 0.38e0 + resolution * (0.18e0 + 0.10e0 * busy) + duration_score * (0.20e0 + 0.08e0 * busy) + aspect * 0.09e0 * (1 - 0.3e0 * busy) + name_effective * 0.08e0 + loop * 0.04e0 + palette_s * 0.05e0)
    / (0.38e0 + 0.18e0 + 0.10e0 * busy + 0.20e0 + 0.08e0 * busy + 0.09e0 * (1 - 0.3e0 * busy) + 0.08e0 + 0.04e0 + 0.05e0) AS total FROM s),
  v AS (SELECT *, CASE WHEN coalesce(regexp_matches(vendor, '^(GIPHY|TENOR|STICKER)'), FALSE) THEN 'Keep' WHEN bpp > 0.60e0 AND area0 >= 2073600 THEN 'Convert' WHEN duration > 15 AND area0 >= 2073600 THEN 'Convert'
    WHEN bpp < 0.03e0 AND area0 < 40000 THEN 'Keep' WHEN area0 <= 9216 AND duration <= 0.7e0 AND bpp <= 0.10e0 AND duration > 0.01e0 THEN 'Keep' WHEN duration <= 1 AND duration > 0.01e0 THEN 'Keep'
    WHEN frames > 0 AND frames <= 5 AND bpp <= 0.20e0 THEN 'Keep' END AS veto FROM t)"""
_RULES = []
for _position, (_name, _priority, _conditions) in enumerate(V.rows(V.CLASSIFIER)):
    _RULES.append(f"CASE WHEN {' AND '.join(_conditions.split())} THEN {int(_priority) * 100 - _position} END".replace("=true", ""))
_SCALED = lambda q, v: f"least(greatest(floor((CASE WHEN {q} < 50 THEN 5000e0 / {q} ELSE 200e0 - 2e0 * {q} END * {v} + 50) / 100), 1), 255)::INT"
_LUMA = "[" + ", ".join(map(str, V.JPEG_LUMINANCE)) + "]"
_STATUS = f"""WITH {ctes('results')}, s AS (SELECT *, lower(message) AS m, regexp_matches(lower(message), '{'|'.join(V.DISK_FULL)}') AS disk_full FROM results),
  r AS (SELECT *, CASE WHEN regexp_matches(m, 'data loss|corrupt|truncat') THEN 'Critical' WHEN contains(m, 'metadata') AND regexp_matches(m, 'lost|missing|strip') THEN 'MetadataLoss' WHEN regexp_matches(m, 'broken pipe|unexpected eof|connection reset') THEN 'PipelineBroken'
    WHEN regexp_matches(m, 'assertion failed|segmentation fault|bus error|could find no file|pattern_type') THEN 'Rare' WHEN regexp_matches(m, 'cjxl|magick|ffmpeg|ffprobe') AND regexp_matches(m, 'exit code|failed|error') THEN 'UpstreamError' ELSE 'Standard' END AS severity,
    CASE WHEN ok AND skipped THEN 'skipped' WHEN ok THEN 'succeeded' WHEN contains(message, 'Output exists:') THEN 'skipped' WHEN disk_full THEN 'paused' ELSE 'failed' END AS video,
    CASE WHEN ok AND skipped THEN 'skipped' WHEN ok THEN 'succeeded' WHEN contains(message, 'Skipped') OR contains(message, 'skip') THEN 'skipped' WHEN disk_full THEN 'paused' ELSE 'failed' END AS image FROM s)"""


def _summary(column: str, group: str = "") -> str:
    return f"""{_STATUS} SELECT {group + ',' if group else ''} count(*) FILTER ({column} <> 'paused') AS total, count(*) FILTER ({column} = 'succeeded') AS succeeded, count(*) FILTER ({column} = 'failed') AS failed,
      count(*) FILTER ({column} = 'skipped') AS skipped, count(*) FILTER ({column} = 'paused') AS paused,
      round(coalesce(count(*) FILTER ({column} = 'succeeded') * 100e0 / nullif(count(*) FILTER ({column} <> 'paused'), 0), 100), 6) AS success_rate FROM r {'GROUP BY ' + group if group else ''}"""


def _bytes(column: str, output: str) -> str:
    return f"""{_STATUS}, b AS (SELECT sum(input_size)::BIGINT AS input_bytes, sum({output})::BIGINT AS output_bytes FROM r WHERE {column} = 'succeeded')
      SELECT *, round((1 - output_bytes / input_bytes) * 100, 6) AS reduction, round(output_bytes / input_bytes, 6) AS ratio FROM b"""


_R = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
_WORDS = grades._WORDS
_GRADE = lambda c, pairs, last, op=">=": "CASE " + " ".join(f"WHEN {c} {op} {b} THEN '{w}'" for b, w in pairs) + f" ELSE '{last}' END"

SQL = {
    "source_codecs": f"""{_P}, s AS (SELECT *, {_codec('codec')} AS source FROM probe) SELECT id, source, {_efficiency('source')} AS efficiency, source IN {_IN(V.LOSSLESS_CODECS)} AS lossless, source IN {_IN(V.MODERN_CODECS)} AS modern,
        source IN ('Vvc', 'Av2') AS cutting_edge, source IN ('H265', 'Av1', 'Vp9', 'Vvc', 'Av2') AS skip, source = 'H265' AS skip_apple, source IN ('Av1', 'Vp9', 'Vvc', 'Av2') AS incompatible,
        source = 'JpegXl' OR (NOT has_alpha AND source IN ('WebpStatic', 'Avif', 'Heic')) AS skip_image, codec <> 'gif' AND source IN ('Av1', 'Vp9', 'Vvc', 'Av2') AND (bitrate % 2 = 0 OR (has_alpha AND bitrate / 1e7 < 1.01e0)) AS keep FROM s""",
    "codec_info": f"""{_P}, s AS (SELECT *, {_DETECTED} AS detected FROM probe) SELECT id, detected, {_LABEL} AS label, detected IN {_IN(V.DETECTED_MODERN)} AS modern, detected IN {_IN(V.DETECTED_LOSSLESS)} AS lossless, detected IN ('ProRes', 'DNxHD') AS production,
        {_table(V.CODEC_INFO, 1, "'Unknown'")} AS name, {_table(V.CODEC_INFO, 2, 'codec')} AS long_name, {_table(V.CODEC_INFO, 3, "'Unknown'")} AS category, {_table(V.CODEC_INFO, 5, "'mp4'")} AS extension FROM s""",
    "bpp_factors": f"{_FACTORS} SELECT id, round(raw, 6) AS raw_bpp, {_R(*_NAMES)} FROM f",
    "rate_factors": f"""{_FACTORS}, e AS (SELECT *, {_PRODUCT.format(mode='1', target='0.5e0')} AS av1_bpp, {_PRODUCT.format(mode='0.8e0', target='0.7e0')} AS hevc_bpp, {_PRODUCT.format(mode='0.9e0', target='0.8e0')} AS jxl_bpp FROM f)
        SELECT id, {_R('av1_bpp', 'hevc_bpp', 'jxl_bpp')}, {_curve('av1_bpp', 50, 6, '0.03e0', 18, 0)} AS av1_crf, {_curve('hevc_bpp', 46, 5, '0.02e0', 15, 2)} AS hevc_crf,
        round(CASE WHEN estimated_quality IS NOT NULL OR jxl_bpp > 0 THEN least(greatest(coalesce((100 - estimated_quality) / 10e0, CASE WHEN jxl_bpp > 0 THEN (100 - least(greatest(70 + 15 * log2(greatest(jxl_bpp * 5, 0.001e0)), 50), 100)) / 10 - {_CHANGE} * 0.1e0 END) - 0.2e0, 0), 5) END, 6) AS jxl_distance FROM e""",
    "match_confidence": f"""{_P}, k AS (SELECT *, {_codec('codec')} AS source FROM probe), s AS (SELECT id,
        CASE WHEN width > 0 AND height > 0 THEN 25 ELSE 0 END + CASE WHEN file_size > 0 OR video_bitrate IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN bpp > 0 THEN 10 ELSE 0 END + CASE WHEN source <> 'Unknown' THEN 8 ELSE 0 END + CASE WHEN video_bitrate IS NOT NULL THEN 5 ELSE 0 END
        + CASE WHEN gop_size IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN b_frame_count IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN pix_fmt IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN is_hdr IS NOT NULL OR color_space IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN content_type IS NOT NULL THEN 2 ELSE 0 END
        + CASE WHEN spatial IS NOT NULL AND temporal IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN duration IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN fps IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN estimated_quality IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN bit_depth > 0 THEN 3 ELSE 0 END AS score,
        CASE WHEN duration > 0 AND fps BETWEEN 1 AND 240 THEN 2 ELSE 0 END + CASE WHEN width * height > 0 AND video_bitrate > 0 AND video_bitrate / nullif(width::DOUBLE * height * fps, 0) BETWEEN 0.01e0 AND 5 THEN 2 ELSE 0 END AS bonus FROM k)
        SELECT id, round((score + bonus) / (100 + bonus), 6) AS confidence FROM s""",
    "video_quality": f"""{_KINDS} SELECT id, kind, level, chroma, CASE chroma WHEN 'Yuv422' THEN 1.05e0 WHEN 'Yuv444' THEN 1.15e0 WHEN 'Rgb' THEN 1.20e0 ELSE 1e0 END AS chroma_factor,
        CASE WHEN (width, height) IN ((1920, 1080), (2560, 1440), (3840, 2160)) AND bits < 0.1e0 THEN 'ScreenRecording' WHEN bits < 0.05e0 THEN 'Animation' WHEN kind = 'Intermediate' AND bits > 0.5e0 THEN 'FilmGrain'
          WHEN fps >= 50 AND (width, height) IN ((1920, 1080), (1280, 720)) AND bits BETWEEN 0.08e0 AND 0.5e0 THEN 'Gaming' WHEN bits BETWEEN 0.05e0 AND 0.6e0 AND kind <> 'Intermediate' THEN 'LiveAction' ELSE 'Unknown' END AS content,
        least(100, {_BASE} + CASE WHEN bit_depth >= 10 THEN 5 ELSE 0 END + CASE WHEN kind = 'ModernEfficient' THEN 3 ELSE 0 END + CASE level WHEN 'Standard' THEN round(least(greatest(bits - 0.1e0, 0), 0.2e0) / 0.2e0 * 5) WHEN 'HighQuality' THEN round(least(greatest(bits - 0.3e0, 0), 0.2e0) / 0.2e0 * 3) ELSE 0 END)::INT AS score,
        CASE WHEN kind = 'Lossless' THEN 0 WHEN e > 5 THEN 14 WHEN e > 1 THEN 18 WHEN e > 0.5e0 THEN 22 WHEN e > 0.3e0 THEN 25 WHEN e > 0.15e0 THEN 28 WHEN e > 0.08e0 THEN 32 ELSE 35 END AS crf,
        round(0.7e0 + CASE WHEN video_bitrate IS NOT NULL THEN 0.1e0 ELSE 0 END + CASE WHEN gop_size IS NOT NULL THEN 0.05e0 ELSE 0 END + CASE WHEN duration > 10 THEN 0.05e0 ELSE 0 END + CASE WHEN trunc(duration * fps) > 100 THEN 0.05e0 ELSE 0 END, 6) AS confidence,
        CASE WHEN fps IS NOT NULL THEN least(greatest(round(fps * 2.5e0), 12), 250)::INT END AS gop, CASE WHEN height <= 576 THEN 'bt601' ELSE 'bt709' END AS color_space, width - width % 2 AS even_width, height + height % 2 AS even_height FROM x""",
    "encoder_params": f"""{_P} SELECT id, least(round(coalesce({_NUM('crf=')}, {_NUM('qp=')}, {_NUM('cqp=')}, {_NUM('crf ')}, {_NUM('qp ')})), 255)::INT AS crf, {_ORIGINAL('.')} AS original, {_ORIGINAL('')} AS corrected,
        nullif(regexp_extract(lower(encoder_params), '^.*?preset=([a-z0-9]+)', 1), '') AS preset FROM probe""",
    "compression_types": f"""{_TYPES}, z AS (SELECT *, shown IN ('H265', 'Av1', 'Vp9', 'Vvc', 'Av2') AS skip FROM t) SELECT id, level, least(100, {_BASE} + CASE WHEN bit_depth >= 10 THEN 5 ELSE 0 END + CASE WHEN width >= 3840 OR height >= 2160 THEN 3 ELSE 0 END) AS score,
        bit_depth >= 10 AND level IN ('Lossless', 'VisuallyLossless') AS fidelity, CASE WHEN skip THEN 'Skip' WHEN level = 'Lossless' THEN 'HevcLosslessMkv' ELSE 'HevcMp4' END AS target,
        CASE WHEN skip OR level = 'Lossless' THEN 0e0 WHEN level = 'VisuallyLossless' THEN 18e0 ELSE 20e0 END AS crf, CASE WHEN shown = 'H265' THEN 'Skip' WHEN level = 'Lossless' THEN 'HevcLosslessMkv' ELSE 'HevcMp4' END AS apple_target, shown <> 'H265' AND level = 'Lossless' AS apple_lossless FROM z""",
    "video_flags": f"""{_P}, s AS (SELECT *, CASE WHEN duration * 25 <= 60 THEN 'Full' WHEN duration * 25 <= 300 THEN 'OneThird' WHEN duration * 25 <= 1800 THEN 'OneTenth' ELSE 'Skip' END AS sampling, fps - id % 3 AS mean FROM probe)
        SELECT id, CASE WHEN fps <= 0 OR fps > 10000 THEN 'Invalid' WHEN fps < 240 THEN 'Normal' WHEN fps <= 2000 THEN 'Extended' ELSE 'Extreme' END AS fps_class, sampling,
        CASE sampling WHEN 'Full' THEN bitrate WHEN 'OneThird' THEN bitrate // 3 WHEN 'OneTenth' THEN bitrate // 10 ELSE 0 END::BIGINT AS frames,
        coalesce(fps > 0 AND mean > 0 AND ((has_alpha AND mean >= 60 AND (id % 7 = 0 OR fps / mean > 2)) OR abs(fps - mean) > fps * 0.02e0), FALSE) AS variable, coalesce(is_hdr, FALSE) OR preset IS NOT NULL OR id % 4 = 0 AS hdr FROM s""",
    "precheck": f"""{_KINDS}, y AS (SELECT *, lower(codec) AS c, bitrate / 1000e0 AS kbps, {_efficiency('source')} AS f FROM v) SELECT id, CASE WHEN least(width, height) < 16 OR greatest(width, height) > 16384 OR duration < 0.001e0 OR fps <= 0 OR fps > 10000 THEN 'CannotProcess'
        WHEN regexp_matches(c, '{'|'.join(V.LEGACY_CODECS)}') THEN 'StronglyRecommended' WHEN regexp_matches(c, '{'|'.join(V.OPTIMAL_CODECS)}') THEN 'NotRecommended'
        WHEN kbps > 0 AND kbps < 2500e0 * (width * height / (1920e0 * 1080)) * (fps / 30) * f * 0.5e0 AND bits < 0.05e0 / f THEN 'Optional' ELSE 'Recommended' END AS advice FROM y""",
    "gif_scores": f"{_GIF} SELECT id, name_raw, name_kind, {_R('sharpness', 'resolution', 'duration_score', 'aspect', 'name_effective', 'loop')}, round(palette_s, 6) AS palette, round(bpp, 6) AS bytes_per_pixel, round(total, 6) AS total FROM v",
    "gif_verdicts": f"{_GIF} SELECT id, veto, CASE WHEN veto IS NOT NULL THEN veto = 'Keep' ELSE NOT total <= 0.40e0 END AS keep FROM v",
    "image_advice": f"""WITH {ctes('images')}, i AS (SELECT *, format IN ('PNG', 'GIF', 'TIFF', 'JPEG') OR (format IN ('WebP', 'AVIF') AND lossless) AS worth, width::BIGINT * height AS area,
          CASE WHEN format IN ('HEIC', 'HEIF', 'AVIF', 'JXL') THEN 'NoConversion' WHEN NOT is_animated AND (format = 'JPEG' OR lossless) THEN 'JXL' WHEN is_animated AND lossless THEN 'HEVCMP4' WHEN is_animated THEN 'NoConversion' ELSE 'AVIF' END AS target FROM images)
        SELECT id, CASE WHEN worth THEN 'JXL' ELSE format END AS recommended, CASE WHEN NOT worth THEN 0e0 WHEN lossless THEN 45e0 ELSE 20e0 END AS saving, CASE WHEN NOT worth THEN 'N/A' WHEN lossless THEN 'Mathematically Lossless' ELSE 'Lossless JPEG Transcode' END AS preservation,
        target, CASE WHEN target = 'NoConversion' THEN 0e0 WHEN target = 'JXL' AND format = 'JPEG' THEN 15e0 WHEN target = 'JXL' THEN 45e0 WHEN target = 'HEVCMP4' THEN 30e0 ELSE 25e0 END AS reduction,
        CASE WHEN format = 'JXL' OR (NOT lossless AND format IN ('WebP', 'AVIF', 'HEIC', 'HEIF')) THEN 'skip' WHEN is_animated THEN 'animated' WHEN format = 'JPEG' THEN 'jpeg_transcode' WHEN lossless THEN 'jxl_d0' ELSE 'jxl_d0.1' END AS route,
        round(CASE WHEN quality >= 95 THEN 45 + (quality - 95) * 0.5e0 WHEN quality >= 85 THEN 38 + (quality - 85) * 0.7e0 WHEN quality >= 75 THEN 32 + (quality - 75) * 0.6e0 WHEN quality >= 60 THEN 28 + (quality - 60) * 0.27e0 ELSE 20 + quality * 0.13e0 END, 6) AS psnr,
        round(CASE WHEN quality >= 95 THEN 0.98e0 + (quality - 95) * 0.004e0 WHEN quality >= 85 THEN 0.95e0 + (quality - 85) * 0.003e0 WHEN quality >= 75 THEN 0.90e0 + (quality - 75) * 0.005e0 WHEN quality >= 60 THEN 0.80e0 + (quality - 60) * 0.0067e0 ELSE 0.60e0 + quality * 0.003e0 END, 6) AS ssim,
        round(least(edge_density * 0.35e0 + color_diversity * 0.25e0 + texture_variance * 0.25e0 + noise_level * 0.15e0, 1), 6) AS overall,
        round(0.7e0 + CASE WHEN area > 1000000 THEN 0.1e0 WHEN area < 100000 THEN -0.1e0 ELSE 0e0 END + CASE WHEN size > 10000 AND size < 100000000 THEN 0.05e0 ELSE 0e0 END + CASE WHEN edge_density > 0.01e0 AND edge_density < 0.9e0 THEN 0.05e0 ELSE 0e0 END
          + CASE WHEN color_diversity > 0.01e0 AND color_diversity < 0.99e0 THEN 0.05e0 ELSE 0e0 END, 6) AS confidence, round(CASE WHEN area > 0 THEN size / (area * 4) ELSE 1e0 END, 6) AS ratio,
        CASE WHEN size > 0 AND area > 0 THEN trunc(least(greatest(70 + 15 * log2(greatest(size * 8e0 / area / greatest(id % 3, 1) * CASE WHEN format IN ('AVIF', 'HEIC', 'HEIF') THEN 3e0 WHEN format = 'WebP' THEN 1.5e0 ELSE 1e0 END
          * least(greatest(sqrt(7.5e0 / greatest(entropy, 1)), 0.7e0), 1.3e0) * 5, 0.001e0)), 10), 100))::INT END AS still_quality FROM i""",
    "content_classes": f"""WITH {ctes('images')}, i AS (SELECT *, width / greatest(height, 1) AS aspect_ratio FROM images), b AS (SELECT id, greatest({', '.join(_RULES)}) AS best FROM i)
        SELECT id, CASE best {' '.join(f"WHEN {int(r[1]) * 100 - k} THEN '{r[0]}'" for k, r in enumerate(V.rows(V.CLASSIFIER)))} ELSE 'UNKNOWN' END AS content_type FROM b""",
    "jpeg_quality": f"""WITH t AS (SELECT p_partkey AS id, k, {_SCALED('(1 + p_partkey * 7 % 100)', 'v')} + CASE WHEN k = p_partkey % 64 AND p_partkey % 3 > 0 THEN p_partkey % 5 ELSE 0 END AS x
          FROM part, (SELECT unnest({_LUMA}) AS v, unnest(range(64)) AS k)),
        s AS (SELECT q, k, {_SCALED('q', 'v')} AS y FROM (SELECT unnest(range(1, 101)) AS q), (SELECT unnest({_LUMA}) AS v, unnest(range(64)) AS k)),
        e AS (SELECT id, q, sum((x - y) * (x - y))::DOUBLE AS sse FROM t JOIN s USING (k) GROUP BY id, q), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sse, q) AS n FROM e)
        SELECT a.id, a.q::INT AS quality, a.sse, a.sse = 0 AS is_exact, round(a.q + CASE WHEN a.sse > 0 AND b.sse > a.sse THEN CASE WHEN b.q > a.q THEN 1 ELSE -1 END * (a.sse / (a.sse + b.sse)) * 0.5e0 ELSE 0e0 END, 6) AS interpolated
        FROM r a JOIN r b ON a.id = b.id AND a.n = 1 AND b.n = 2""",
    "jpeg_table_errors": f"""WITH t AS (SELECT p_partkey AS id, k, w, {_SCALED('(1 + p_partkey * 7 % 100)', 'v')} + CASE WHEN k = p_partkey % 64 AND p_partkey % 3 > 0 THEN p_partkey % 5 ELSE 0 END - {_SCALED('75', 'v')} AS x
          FROM part, (SELECT unnest({_LUMA}) AS v, unnest(range(64)) AS k, unnest([{', '.join(f'{w}e0' for w in V.JPEG_WEIGHTS)}]) AS w))
        SELECT id, sum(x * x)::DOUBLE AS sse, round(sum(w * x * x) / sum(w), 6) AS weighted FROM t GROUP BY id""",
    "size_gates": f"""{_P}, o AS (SELECT *, floor(file_size * 0.97e0 + id * 997)::BIGINT AS out, least(greatest(trunc(file_size * 0.005e0)::BIGINT, 2048), 102400) AS margin, ['mov', 'mp4', 'mkv', 'avi', 'webm', 'm4v'][id % 6 + 1] AS ext FROM probe),
        p AS (SELECT *, greatest(file_size - margin, 0) AS target, trunc(file_size * CASE ext WHEN 'mov' THEN 0.005e0 WHEN 'mp4' THEN 0.001e0 WHEN 'm4v' THEN 0.001e0 WHEN 'mkv' THEN 0.0005e0 WHEN 'webm' THEN 0.0005e0 ELSE 0.002e0 END)::BIGINT AS overhead FROM o)
        SELECT id, out, margin::BIGINT AS margin, target::BIGINT AS target, out < target AS fits, CASE WHEN file_size < 10485760 THEN greatest(out - id * 50, 0) ELSE out END AS compared, out < file_size + CASE WHEN has_alpha THEN 1048576 ELSE 0 END AS smaller,
        out > file_size + CASE WHEN has_alpha THEN 1048575 ELSE 0 END AS discarded, round(CASE WHEN file_size > 0 THEN out / file_size ELSE 1e0 END, 6) AS ratio, round(CASE WHEN file_size > 0 THEN (1 - out / file_size) * 100 ELSE 0e0 END, 6) + 0e0 AS reduction,
        round(CASE WHEN file_size > 0 THEN (out - file_size) / file_size * 100 END, 6) AS change, overhead, round(CASE WHEN file_size > 0 THEN overhead / file_size * 100 ELSE 0e0 END, 6) AS overhead_percent,
        CASE WHEN file_size >= 1073741824 THEN format('{{:.2f}} GB', file_size / 1073741824) WHEN file_size >= 1048576 THEN format('{{:.2f}} MB', file_size / 1048576) WHEN file_size >= 1024 THEN format('{{:.2f}} KB', file_size / 1024) ELSE file_size || ' B' END AS shown FROM p""",
    "quality_gates": f"""WITH {ctes('trace')}, t AS (SELECT *, CASE WHEN event_id % 4 <> 0 THEN ssim - 0.02e0 END AS ms, 85e0 + event_id % 15 AS vmaf, CASE WHEN event_id % 7 <> 0 THEN ssim END AS s, CASE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE ELSE psnr END AS p FROM trace)
        SELECT event_id, coalesce(s + 1e-4 >= 0.95e0 AND p >= 33, FALSE) AS passed, coalesce(ms >= 0.93e0, FALSE) AS ms_passed, vmaf >= 93 AND event_id % 9 <= 5 AND psnr >= 35 AS ultimate,
        coalesce(coalesce(0.6e0 * ms + 0.4e0 * s, ms, s) >= CASE WHEN event_id % 2 = 0 THEN 0.92e0 ELSE 0.94e0 END, FALSE) AS fused, {_GRADE('ssim', list(zip((0.98, 0.95, 0.90, 0.85), _WORDS)), _WORDS[4])} AS ssim_grade,
        CASE WHEN isinf(p) THEN 'Lossless (identical)' ELSE {_GRADE('p', list(zip((45, 40, 35, 30), _WORDS)), _WORDS[4])} END AS psnr_grade,
        {_GRADE('ms', [('0.95e0', _WORDS[0]), ('0.90e0', 'Good (streaming quality)'), ('0.85e0', 'Acceptable (mobile quality)'), ('0.80e0', _WORDS[3])], _WORDS[4])} AS ms_grade,
        {_GRADE('ssim', [('0.999e0', 'Identical'), ('0.98e0', 'Excellent - virtually lossless'), ('0.95e0', 'Very good - minimal visible difference'), ('0.90e0', 'Good - acceptable quality'), ('0.85e0', 'Fair - noticeable degradation')], 'Poor - significant quality loss')} AS image_ssim,
        CASE WHEN isinf(p) THEN 'Identical (lossless)' ELSE {_GRADE('p', [(50, 'Excellent - virtually lossless'), (40, 'Very good - minimal visible difference'), (35, 'Good - acceptable quality'), (30, 'Fair - noticeable degradation')], 'Poor - significant quality loss', '>')} END AS image_psnr,
        {_GRADE('ssim', [('0.99e0', 'Excellent (visually lossless)'), ('0.95e0', 'Very Good'), ('0.90e0', 'Good'), ('0.80e0', 'Fair')], 'Poor')} AS typed, round(least(1 - power(10, -psnr / 20), 0.9999e0), 6) AS guess, round(least(crf, 63.99e0) * 100)::INT AS key,
        ssim >= 0.95e0 - 1e-4 AS meets, round(0.7e0 * ssim + 0.3e0 * greatest(1 - size / input_size, 0), 6) AS cpu_score, CASE WHEN ssim < 0.92e0 THEN FALSE WHEN ms <= 0 THEN ssim > 0 ELSE ssim - ms > ms * 0.005e0 END AS better,
        greatest(round(CASE WHEN secs * 200 >= 300 THEN 3e0 ELSE 4e0 END * CASE WHEN crf < 20 THEN greatest(least(crf / 20, 1), 0.5e0) ELSE 1 END), 3)::INT AS zero_gains, least(greatest(ceil(log2(crf * 3)) + 8, 15), 50)::INT AS walls,
        round(crf + CASE WHEN event_id % 2 = 0 THEN 4 ELSE 5 END + CASE WHEN secs / 2 < 0.3e0 THEN 0.3e0 WHEN secs / 2 > 0.7e0 THEN -0.2e0 ELSE 0 END, 6) AS centre FROM t""",
    "message_kinds": f"{_STATUS} SELECT id, severity, disk_full FROM r",
    "batch_summary": _summary("video"),
    "batch_by_severity": _summary("image", "severity"),
    "video_bytes": _bytes("video", "coalesce(output_size, input_size)"),
    "image_bytes": _bytes("image", "output_size"),
    "health_report": f"""WITH {ctes('results')}, c AS (SELECT count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'warning') AS warnings FROM results)
        SELECT *, round(passed * 100e0 / (passed + failed + warnings), 6) AS rate FROM c""",
}
