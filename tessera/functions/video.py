"""Classes and scores of videos."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import values as V
from tessera.functions import codecs
from tessera.functions.quality import clamp, steps


def codec_type(codec: Column) -> Column:
    return (
        F.when(codec.isin("Ffv1", "UtVideo", "HuffYuv"), "Lossless")
        .when(codec.isin(V.SKIPPED_VIDEO_CODECS), "ModernEfficient")
        .when(codec == "H264", "Legacy").when(codec.isin("ProRes", "DnxHD"), "Intermediate")
        .when(codec.isin("Mjpeg", "Gif"), "Inefficient").otherwise("Unknown")
    )


def chroma(pix_fmt: Column) -> Column:
    has = lambda pattern: F.rlike(F.lower(pix_fmt), F.lit(pattern))
    return (
        F.when(has("444"), "Yuv444").when(has("422|411"), "Yuv422").when(has("420|nv12|^yuv|410"), "Yuv420")
        .when(has("rgb|gbr|bgr"), "Rgb").otherwise("Unknown")
    )


def chroma_quality(subsampling: Column) -> Column:
    return F.when(subsampling == "Yuv422", 1.05).when(subsampling == "Yuv444", 1.15).when(subsampling == "Rgb", 1.20).otherwise(1.0)


def compression_level(bpp: Column, kind: Column) -> Column:
    adjusted = bpp / F.when(kind == "ModernEfficient", 0.6).when(kind == "Inefficient", 2.0).otherwise(1.0)
    by_bits = steps(adjusted, (1.0, "VisuallyLossless"), (0.3, "HighQuality"), (0.1, "Standard"), otherwise="LowQuality")
    return F.when(kind == "Lossless", "Lossless").when(kind == "Intermediate", "VisuallyLossless").otherwise(by_bits)


def content_type(bpp: Column, kind: Column, width: Column, height: Column, fps: Column) -> Column:
    size = lambda *pairs: _any_size(width, height, pairs)
    return (
        F.when(size((1920, 1080), (2560, 1440), (3840, 2160)) & (bpp < 0.1), "ScreenRecording")
        .when(bpp < 0.05, "Animation")
        .when((kind == "Intermediate") & (bpp > 0.5), "FilmGrain")
        .when((fps >= 50.0) & size((1920, 1080), (1280, 720)) & bpp.between(0.08, 0.5), "Gaming")
        .when(bpp.between(0.05, 0.6) & (kind != "Intermediate"), "LiveAction")
        .otherwise("Unknown")
    )


def _any_size(width: Column, height: Column, pairs) -> Column:
    return F.array_contains(F.array(*[F.lit(f"{w}x{h}") for w, h in pairs]), F.concat_ws("x", width.cast("string"), height.cast("string")))


_BASE = {"Lossless": 100, "VisuallyLossless": 95, "HighQuality": 80, "Standard": 60}


def _base_score(level: Column) -> Column:
    out = F.lit(40)
    for name, score in _BASE.items():
        out = F.when(level == name, score).otherwise(out)
    return out


def quality_score(bpp: Column, kind: Column, bit_depth: Column, level: Column) -> Column:
    """0 to 100 by compression, bit depth, codec and bits within the class."""
    within = lambda low, most: F.round(clamp(bpp - low, 0.0, 0.2) / 0.2 * float(most)).cast("int")
    tweak = F.when(level == "Standard", within(0.1, 5)).when(level == "HighQuality", within(0.3, 3)).otherwise(0)
    bonus = F.when(bit_depth >= 10, 5).otherwise(0) + F.when(kind == "ModernEfficient", 3).otherwise(0)
    return F.least(_base_score(level) + bonus + tweak, F.lit(100))


def estimated_crf(bpp: Column, kind: Column) -> Column:
    efficiency = F.when(kind == "ModernEfficient", 0.5).when(kind == "Intermediate", 0.7).when(kind == "Inefficient", 2.0).otherwise(1.0)
    by_bits = steps(bpp / efficiency, (5.0, 14), (1.0, 18), (0.5, 22), (0.3, 25), (0.15, 28), (0.08, 32), otherwise=35)
    return F.when(kind == "Lossless", 0).otherwise(by_bits)


def confidence(has_bitrate: Column, has_gop: Column, duration: Column, frames: Column) -> Column:
    parts = [(has_bitrate, 0.1), (has_gop, 0.05), (duration > 10.0, 0.05), (frames > 100, 0.05)]
    return clamp(sum((F.when(c, w).otherwise(0.0) for c, w in parts), F.lit(0.7)), 0.0, 1.0)


def crf_of_params(params: Column) -> Column:
    """The rate factor that encoder settings name, rounded; null where none is a number."""
    found = [
        F.nullif(F.regexp_extract(F.lower(params), f"^.*?{key}([0-9.]+)", 1), F.lit("")).try_cast("double")
        for key in ("crf=", "qp=", "cqp=", "crf ", "qp ")
    ]
    return F.least(F.round(F.coalesce(*found)), F.lit(255.0)).cast("int")


def original_crf(params: Column, strict: bool = True) -> Column:
    """As the detector reads it: after ``qp=`` it skips one character too many, unless ``strict`` is off."""
    text = F.lower(params)
    number = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")
    skip = "." if strict else ""
    return F.when(F.contains(text, F.lit("crf=")), number(r"^.*?crf=([0-9.]*)")).when(F.contains(text, F.lit("qp=")), number(rf"^.*?qp={skip}([0-9.]*)"))


def preset(params: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(params), r"^.*?preset=([a-z0-9]+)", 1), F.lit(""))


def compression_type(name: Column, bitrate: Column, width: Column, height: Column, fps: Column, crf: Column, encoder: Column, strict: bool = True) -> Column:
    """The detector's class. It takes the bit rate times eight, though it is in bits already, unless ``strict`` is off."""
    per_second = width.cast("double") * height * fps
    bits = F.when(per_second > 0, bitrate * (8.0 if strict else 1.0) / F.nullif(per_second, F.lit(0.0)))
    by_crf = steps(crf, (15.0, "VisuallyLossless"), (23.0, "HighQuality"), (30.0, "Standard"), otherwise="LowQuality", op="<=")
    return (
        F.when(codecs.detected_is(name, V.DETECTED_LOSSLESS) | F.coalesce(F.rlike(encoder, F.lit("lossless=1|qp=0")), F.lit(False)), "Lossless")
        .when(crf.isNotNull(), by_crf)
        .when(codecs.detected_is(name, V.DETECTED_PRODUCTION), "VisuallyLossless")
        .otherwise(steps(bits, (2.0, "VisuallyLossless"), (0.5, "HighQuality"), (0.1, "Standard"), otherwise="LowQuality"))
    )


def detected_score(level: Column, bit_depth: Column, width: Column, height: Column) -> Column:
    bonus = F.when(bit_depth >= 10, 5).otherwise(0) + F.when((width >= 3840) | (height >= 2160), 3).otherwise(0)
    return F.least(_base_score(level) + bonus, F.lit(100))


def fallback_gop(fps: Column) -> Column:
    return clamp(F.round(fps * 2.5), 12.0, 250.0).cast("int")


def fallback_color_space(height: Column) -> Column:
    return F.when(height <= 576, "bt601").otherwise("bt709")


def is_variable_rate(format_name: Column, real_rate: Column, mean_rate: Column, slow_motion_tag: Column) -> Column:
    """Slow motion in mov and mp4, else a difference of more than two percent."""
    known = (real_rate > 0) & (mean_rate > 0)
    quick = F.rlike(format_name, F.lit("mov|mp4")) & (mean_rate >= 60.0) & (slow_motion_tag | (real_rate > mean_rate * 2.0))
    return F.coalesce(known & (quick | (F.abs(real_rate - mean_rate) > real_rate * 0.02)), F.lit(False))


def is_hdr(dolby: Column, hdr10_plus: Column, mastering: Column, light_level: Column, transfer: Column) -> Column:
    return F.coalesce(dolby, F.lit(False)) | F.coalesce(hdr10_plus, F.lit(False)) | mastering.isNotNull() | light_level.isNotNull() | F.coalesce(transfer.isin("smpte2084", "arib-std-b67"), F.lit(False))


def is_high_fidelity(bit_depth: Column, level: Column) -> Column:
    return (bit_depth >= 10) & level.isin("Lossless", "VisuallyLossless")


def fps_class(fps: Column) -> Column:
    return (
        F.when((fps <= 0) | (fps > 10_000), "Invalid").when(fps < 240, "Normal").when(fps <= 2_000, "Extended").otherwise("Extreme")
    )


def sampling(duration: Column) -> Column:
    """How densely frames are compared: all, every third, every tenth, or none."""
    return steps(duration, (60.0, "Full"), (300.0, "OneThird"), (1800.0, "OneTenth"), otherwise="Skip", op="<=")


def sampled_frames(strategy: Column, frames: Column) -> Column:
    part = F.when(strategy == "Full", frames).when(strategy == "OneThird", F.floor(frames / 3)).when(strategy == "OneTenth", F.floor(frames / 10))
    return F.coalesce(part, F.lit(0)).cast("bigint")


def precheck(codec: Column, width: Column, height: Column, duration: Column, fps: Column, kbps: Column, bpp: Column) -> Column:
    """What to do with a video, by its lower-case codec name and figures."""
    holds = lambda words: F.rlike(codec, F.lit("|".join(words)))
    factor = codecs.efficiency(codecs.source_codec(codec))
    expected = 2500.0 * (width * height / (1920.0 * 1080.0)) * (fps / 30.0) * factor
    return (
        F.when((width < 16) | (height < 16) | (width > 16384) | (height > 16384) | (duration < 0.001) | (fps <= 0) | (fps > 10_000), "CannotProcess")
        .when(holds(V.LEGACY_CODECS), "StronglyRecommended")
        .when(holds(V.OPTIMAL_CODECS), "NotRecommended")
        .when((kbps > 0) & (kbps < expected * 0.5) & (bpp < 0.05 / factor), "Optional")
        .otherwise("Recommended")
    )


def even(length: Column, up: bool = False) -> Column:
    return length + length % 2 if up else length - length % 2


def strategy(name: Column, level: Column, apple_compat: bool = False) -> Column:
    """(target, crf, lossless) of a conversion, by the codec as shown and its compression."""
    skipped = codecs.skip_video(codecs.source_codec(codecs.detected_label(name)), apple_compat)
    target = F.when(skipped, "Skip").when(level == "Lossless", "HevcLosslessMkv").otherwise("HevcMp4")
    crf = F.when(skipped | (level == "Lossless"), 0.0).when(level == "VisuallyLossless", 18.0).otherwise(20.0)
    return F.struct(target.alias("target"), crf.alias("crf"), (~skipped & (level == "Lossless")).alias("lossless"))


def _of_target(target: Column, place: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for name, row in V.TARGETS.items() for x in (name, row[place])]), target)


def target_extension(target: Column) -> Column:
    """The extension of a conversion target's files, empty for none; null for an unknown target."""
    return _of_target(target, 0)


def target_label(target: Column) -> Column:
    """A conversion target as users read it; null for an unknown target."""
    return _of_target(target, 1)
