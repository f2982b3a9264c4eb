"""Bits per pixel, the factors that correct them, and the rate factors that follow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import values as V
from tessera.functions import codecs


def steps(value: Column, *bounds: tuple[float, float], otherwise: float | Column, op: str = ">") -> Column:
    """The result of the first bound that ``value`` exceeds (or is below, by ``op``)."""
    compare = {">": lambda b: value > b, ">=": lambda b: value >= b, "<": lambda b: value < b, "<=": lambda b: value <= b}[op]
    out = None
    for bound, result in bounds:
        result = result if isinstance(result, Column) else F.lit(result)
        out = F.when(compare(bound), result) if out is None else out.when(compare(bound), result)
    return out.otherwise(otherwise)


def clamp(value: Column, low: float, high: float) -> Column:
    """``value`` within bounds; null stays null."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def pixels(width: Column, height: Column) -> Column:
    return width.cast("bigint") * height.cast("bigint")


def raw_bpp(bpp: Column, bitrate: Column, fps: Column, file_size: Column, duration: Column, area: Column) -> Column:
    """Given bits per pixel, or from the bit rate, or from size and length; the last resort counts bytes, not bits. Null if nothing tells, or a length comes without a rate."""
    area = area.cast("double")
    frames = F.greatest((duration * fps).cast("bigint"), F.lit(1))
    by_size = F.when(duration > 0, F.when(fps.isNotNull(), file_size * 8.0 / frames / area)).otherwise(file_size / area)
    return (
        F.when(bpp > 0, bpp)
        .when((bitrate > 0) & (fps > 0), bitrate / fps / area)
        .when(file_size > 0, by_size)
    )


def gop_factor(gop_size: Column, b_frames: Column) -> Column:
    base = F.when(gop_size.isNull(), 1.0).otherwise(
        steps(gop_size, (1, 0.70), (10, 0.85), (50, 1.0), (150, 1.15), (300, 1.20), otherwise=1.25, op="<=")
    )
    base = F.when(gop_size <= 0, 1.25).otherwise(base)
    return base * steps(b_frames, (0, 1.0), (1, 1.05), (2, 1.08), otherwise=1.12, op="<=")


def chroma_factor(pix_fmt: Column) -> Column:
    has = lambda *words: F.rlike(F.lower(pix_fmt), F.lit("|".join(words)))
    return F.when(has("444"), 1.15).when(has("422"), 1.05).when(has("rgb", "gbr"), 1.20).otherwise(1.0)


def hdr_factor(is_hdr: Column, color_space: Column) -> Column:
    return F.when(is_hdr, 1.25).when(F.contains(color_space, F.lit("2020")), 1.15).otherwise(1.0)


def codec_factor(codec: Column, preset: Column) -> Column:
    """Efficiency and preset; ``ultrafast`` holds ``fast`` and so never gets a factor of its own."""
    word = F.lower(preset)
    has = lambda *words: F.rlike(word, F.lit("|".join(words)))
    number = F.when(F.rlike(preset, F.lit(r"^\+?0*[0-9]{1,3}$")), preset.try_cast("int"))
    by_number = F.when(number <= 255, steps(number, (2, 0.80), (4, 0.90), (6, 1.0), (8, 1.10), (10, 1.20), otherwise=1.30, op="<="))
    by_word = F.when(has("placebo", "veryslow"), 0.85).when(has("slow"), 0.90).when(has("fast"), 1.15)
    return codecs.efficiency(codec) * F.coalesce(by_word, by_number, F.lit(1.0))


def resolution_factor(area: Column) -> Column:
    mega = area / 1_000_000.0
    return (
        F.when(mega > 8, 0.80 + 0.05 * F.least(F.try_divide(F.lit(8.0), mega), F.lit(1.0)))
        .when(mega > 2, 0.85 + 0.05 * ((8.0 - mega) / 6.0))
        .when(mega > 0.5, 0.90 + 0.05 * ((2.0 - mega) / 1.5))
        .otherwise(0.95 + 0.05 * F.least((0.5 - mega) / 0.5, F.lit(1.0)))
    )


def depth_factor(bit_depth: Column, codec: Column) -> Column:
    return (
        F.when(bit_depth.between(1, 8), F.when(codec == "Gif", 1.3).otherwise(1.0))
        .when(bit_depth == 10, 1.25).when(bit_depth == 12, 1.5).when(bit_depth == 16, 2.0).otherwise(1.0)
    )


def aspect_factor(width: Column, height: Column) -> Column:
    ratio = width / F.greatest(height, F.lit(1)).cast("double")
    return F.when(ratio > 2.5, 1.08).when(ratio > 2.0, 1.04).when(ratio < 0.5, 1.08).otherwise(1.0)


def complexity_factor(spatial: Column, temporal: Column, bpp: Column, area: Column) -> Column:
    """From measured complexity; without it from the bits spent against those expected for the size."""
    measured = steps(spatial / 50.0, (1.3, 1.15), otherwise=F.when(spatial / 50.0 < 0.7, 0.90).otherwise(1.0)) * steps(
        temporal / 20.0, (1.5, 1.10), otherwise=F.when(temporal / 20.0 < 0.5, 0.95).otherwise(1.0)
    )
    ratio = bpp / steps(area, (8_000_000, 0.15), (2_000_000, 0.20), (500_000, 0.30), otherwise=0.50)
    guessed = F.when(ratio > 2, 1.15).when(ratio > 1, 1.0 + 0.15 * (ratio - 1.0)).when(ratio > 0.5, 1.0).otherwise(0.95)
    return F.when(spatial.isNotNull() & temporal.isNotNull(), measured).otherwise(guessed)


@dataclass(frozen=True)
class Source:
    """Columns that describe a source; all may hold null but width, height and the flags."""

    codec: Column  # as source_codec gives it
    bpp: Column
    width: Column
    height: Column
    has_b_frames: Column
    bit_depth: Column
    has_alpha: Column
    duration: Column
    fps: Column
    file_size: Column
    estimated_quality: Column
    bitrate: Column
    gop_size: Column
    b_frames: Column
    pix_fmt: Column
    color_space: Column
    is_hdr: Column
    content_type: Column
    spatial: Column
    temporal: Column
    film_grain: Column
    preset: Column

    @classmethod
    def named(cls) -> Source:
        """The columns by the names that the probe inputs have; source_codec is that of ``with_source_codec``."""
        c = F.col
        return cls(
            c("source_codec"), c("bpp"), c("width"), c("height"), c("has_b_frames"), c("bit_depth"), c("has_alpha"), c("duration"),
            c("fps"), c("file_size"), c("estimated_quality"), c("video_bitrate"), c("gop_size"), c("b_frame_count"), c("pix_fmt"), c("color_space"),
            c("is_hdr"), c("content_type"), c("spatial"), c("temporal"), c("film_grain"), c("preset"),
        )

    @property
    def area(self) -> Column:
        return pixels(self.width, self.height)

    @property
    def raw_bpp(self) -> Column:
        return F.when(self.area > 0, raw_bpp(self.bpp, self.bitrate, self.fps, self.file_size, self.duration, F.nullif(self.area, F.lit(0).cast("bigint"))))


def with_source_codec(probes: DataFrame) -> DataFrame:
    """``probes`` with source_codec as a column, so that the cascade over its name is evaluated once a row."""
    return probes.withColumn("source_codec", codecs.source_codec(F.col("codec")))


TARGET_FACTOR, MODE_FACTOR = {"av1": 0.5, "hevc": 0.7, "jxl": 0.8}, {"quality": 1.0, "size": 0.8, "speed": 0.9}


def factors(s: Source) -> dict[str, Column]:
    b_frames = F.coalesce(s.b_frames, F.when(s.has_b_frames, 2).otherwise(0))
    return {
        "raw_bpp": s.raw_bpp,
        "gop_factor": gop_factor(s.gop_size, b_frames),
        "chroma_factor": chroma_factor(s.pix_fmt),
        "hdr_factor": hdr_factor(s.is_hdr, F.lower(s.color_space)),
        "aspect_factor": aspect_factor(s.width, s.height),
        "complexity_factor": complexity_factor(s.spatial, s.temporal, s.raw_bpp, s.area),
        "grain_factor": F.when(s.film_grain, 1.20).otherwise(1.0),
        "resolution_factor": resolution_factor(s.area),
        "alpha_factor": F.when(s.has_alpha, 0.9).otherwise(1.0),
        "codec_factor": codec_factor(s.codec, s.preset),
        "depth_factor": depth_factor(s.bit_depth, s.codec),
    }


def effective_bpp(f: dict[str, Column], target: str, mode: str = "quality") -> Column:
    """Bits per pixel, corrected by all ``factors``; null where the size is unknown or nothing tells the bits."""
    top = f["raw_bpp"]
    for name in ("gop", "chroma", "hdr", "aspect", "complexity", "grain"):
        top = top * f[f"{name}_factor"]
    top = top * MODE_FACTOR[mode] * f["resolution_factor"] * f["alpha_factor"]
    return top / f["codec_factor"] / f["depth_factor"] / TARGET_FACTOR[target]


def content_adjustment(content_type: Column) -> Column:
    out = F.lit(0)
    for name, change in V.CONTENT_ADJUSTMENT.items():
        out = F.when(content_type == name, change).otherwise(out)
    return out


_CURVES = {"av1": (50.0, 6.0, 0.03, 35.0, 18.0), "hevc": (46.0, 5.0, 0.02, 35.0, 15.0)}
_BIAS = {"conservative": -2.0, "balanced": 0.0, "aggressive": 2.0}


def rate_factor(bpp: Column, content_type: Column, target: str, bias: str = "balanced") -> Column:
    """The encoder's rate factor in halves from 0 to 51 that matches the effective bits per pixel; null where they aren't above 0."""
    top, slope, low, at_most, at_least = _CURVES[target]
    safe = clamp(bpp, 1e-6, 50.0)
    curve = top - slope * F.log2(F.greatest(safe * 100.0, F.lit(0.001)))
    curve = F.when(safe < low, F.least(F.lit(at_most), curve)).when(safe > 2.0, F.greatest(F.lit(at_least), curve)).otherwise(curve)
    shifted = curve + content_adjustment(content_type) + _BIAS[bias]
    return F.when(bpp > 0, clamp(F.round(shifted * 2.0) / 2.0, 0.0, 51.0))


def jxl_distance(bpp: Column, estimated_quality: Column, content_type: Column, bias: str = "balanced") -> Column:
    """Butteraugli distance from 0 to 5: by the source's own quality, else by its bits per pixel."""
    shift = {"conservative": -0.2, "balanced": 0.0, "aggressive": 0.3}[bias]
    guessed = clamp(70.0 + 15.0 * F.log2(F.greatest(bpp * 5.0, F.lit(0.001))), 50.0, 100.0)
    by_bpp = F.when(bpp > 0, (100.0 - guessed) / 10.0 - content_adjustment(content_type) * 0.1)
    by_quality = (100.0 - estimated_quality) / 10.0
    return clamp(F.coalesce(by_quality, by_bpp) + shift, 0.0, 5.0).cast("double")


def presence_confidence(s: Source) -> Column:
    """The weight of what is known of a source, as a share of all weights."""
    known = [
        (25, (s.width > 0) & (s.height > 0)), (20, (s.file_size > 0) | s.bitrate.isNotNull()), (10, s.bpp > 0), (8, s.codec != "Unknown"),
        (5, s.bitrate.isNotNull()), (4, s.gop_size.isNotNull()), (3, s.b_frames.isNotNull()), (3, s.pix_fmt.isNotNull()),
        (3, s.is_hdr.isNotNull() | s.color_space.isNotNull()), (2, s.content_type.isNotNull()), (3, s.spatial.isNotNull() & s.temporal.isNotNull()),
        (4, s.duration.isNotNull()), (4, s.fps.isNotNull()), (3, s.estimated_quality.isNotNull()), (3, s.bit_depth > 0),
    ]
    plausible = [
        (s.fps > 0) & (s.duration > 0) & s.fps.between(1.0, 240.0),
        (s.area > 0) & (s.bitrate > 0) & F.try_divide(s.bitrate.cast("double"), s.area * s.fps).between(0.01, 5.0),
    ]
    score = sum((F.when(c, float(w)).otherwise(0.0) for w, c in known), F.lit(0.0))
    bonus = sum((F.when(c, 2.0).otherwise(0.0) for c in plausible), F.lit(0.0))
    return clamp((score + bonus) / (float(sum(w for w, _ in known)) + bonus), 0.0, 1.0)


def estimated_still_quality(file_size: Column, area: Column, frames: Column, image_format: Column, entropy: Column) -> Column:
    """Quality from 10 to 100 of a lossy still by size alone; null for empty files and sizes."""
    efficiency = F.when(image_format.isin("AVIF", "HEIC", "HEIF"), 3.0).when(image_format == "WebP", 1.5).otherwise(1.0)
    flatness = clamp(F.sqrt(7.5 / F.greatest(entropy, F.lit(1.0))), 0.7, 1.3)
    bpp = file_size * 8.0 / F.nullif(area, F.lit(0).cast("bigint")) / F.greatest(frames, F.lit(1)) * efficiency * flatness
    return F.when((file_size > 0) & (area > 0), clamp(70.0 + 15.0 * F.log2(F.greatest(bpp * 5.0, F.lit(0.001))), 10.0, 100.0).cast("int"))
