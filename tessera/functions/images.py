"""Recommendations for still images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import values as V
from tessera.functions.quality import clamp


def psnr_of_quality(q: Column) -> Column:
    return (
        F.when(q >= 95, 45.0 + (q - 95.0) * 0.5).when(q >= 85, 38.0 + (q - 85.0) * 0.7).when(q >= 75, 32.0 + (q - 75.0) * 0.6)
        .when(q >= 60, 28.0 + (q - 60.0) * 0.27).otherwise(20.0 + q * 0.13)
    )


def ssim_of_quality(q: Column) -> Column:
    return (
        F.when(q >= 95, 0.98 + (q - 95.0) * 0.004).when(q >= 85, 0.95 + (q - 85.0) * 0.003).when(q >= 75, 0.90 + (q - 75.0) * 0.005)
        .when(q >= 60, 0.80 + (q - 60.0) * 0.0067).otherwise(0.60 + q * 0.003)
    )


def compression_ratio(size: Column, width: Column, height: Column, channels: Column, bits: Column) -> Column:
    raw = width.cast("bigint") * height * channels * F.floor(bits / 8)
    return F.when(raw > 0, size / F.nullif(raw, F.lit(0).cast("bigint")).cast("double")).otherwise(1.0)


def complexity(edges: Column, colours: Column, texture: Column, noise: Column) -> Column:
    return clamp(edges * 0.35 + colours * 0.25 + texture * 0.25 + noise * 0.15, 0.0, 1.0)


def confidence(area: Column, size: Column, edges: Column, colours: Column) -> Column:
    between = lambda c, low, high: F.when((c > low) & (c < high), 0.05).otherwise(0.0)
    by_area = F.when(area > 1_000_000, 0.1).when(area < 100_000, -0.1).otherwise(0.0)
    return clamp(0.7 + by_area + between(size, 10_000, 100_000_000) + between(edges, 0.01, 0.9) + between(colours, 0.01, 0.99), 0.0, 1.0)


def should_become_jxl(image_format: Column, lossless: Column) -> Column:
    return image_format.isin("PNG", "GIF", "TIFF", "JPEG") | (image_format.isin("WebP", "AVIF") & lossless)


def recommendation(image_format: Column, lossless: Column) -> Column:
    """(recommended_format, expected_saving, preservation)."""
    worth = should_become_jxl(image_format, lossless)
    return F.struct(
        F.when(worth, "JXL").otherwise(image_format).alias("recommended_format"),
        F.when(~worth, 0.0).when(lossless, 45.0).otherwise(20.0).alias("expected_saving"),
        F.when(~worth, "N/A").when(lossless, "Mathematically Lossless").otherwise("Lossless JPEG Transcode").alias("preservation"),
    )


def strategy(image_format: Column, animated: Column, lossless: Column) -> Column:
    """(target, expected_reduction) of the library's own decision table."""
    target = (
        F.when(image_format.isin(V.MODERN_IMAGE_FORMATS), "NoConversion").when(~animated & ((image_format == "JPEG") | lossless), "JXL")
        .when(animated & lossless, "HEVCMP4").when(animated, "NoConversion").otherwise("AVIF")
    )
    reduction = (
        F.when(target == "NoConversion", 0.0).when((target == "JXL") & (image_format == "JPEG"), 15.0).when(target == "JXL", 45.0)
        .when(target == "HEVCMP4", 30.0).otherwise(25.0)
    )
    return F.struct(target.alias("target"), reduction.alias("reduction"))


def route(image_format: Column, animated: Column, lossless: Column) -> Column:
    """What a run does with a still or animated image: JPEG stays bit-exact, lossless becomes JXL at distance 0, other stills at 0.1."""
    skip = (image_format == "JXL") | (~lossless & image_format.isin("WebP", "AVIF", "HEIC", "HEIF"))
    return F.when(skip, "skip").when(animated, "animated").when(image_format == "JPEG", "jpeg_transcode").when(lossless, "jxl_d0").otherwise("jxl_d0.1")


# Groups of signs that a PNG was quantised, and their weights.
QUANTISATION = {
    0.50: ("indexed_with_alpha", "large_palette"), 0.15: ("tool_signature",), 0.25: ("dithering", "colour_anomaly", "banding", "frequency"),
    0.10: ("size_anomaly", "entropy_anomaly"),
}


def quantisation_score(signs: dict[str, Column]) -> Column:
    """The weighted mean of the groups' means."""
    return sum((weight * sum((signs[n] for n in names), F.lit(0.0)) / float(len(names)) for weight, names in QUANTISATION.items()), F.lit(0.0))


def quantisation_verdict(score: Column, by_tool: Column) -> Column:
    """(quantised, confidence): a tool's signature decides, else the score; between the bounds it counts as lossless."""
    trust = (
        F.when(by_tool, 0.99).when(score >= 0.70, 0.9 + (score - 0.70) * 0.33).when(score >= 0.58, 0.7 + (score - 0.58))
        .when(score >= 0.30, 0.5 + (0.58 - score)).otherwise(0.8 + (0.30 - score) * 0.67)
    )
    return F.struct((by_tool | (score >= 0.58)).alias("quantised"), trust.alias("confidence"))


def truecolour_verdict(*signals: Column) -> Column:
    """The same for images without palette: two strong signals of three tell."""
    strong = F.size(F.filter(F.array(*signals), lambda s: s >= 0.5))
    mean = sum(signals[1:], signals[0]) / float(len(signals))
    return F.struct((strong >= 2).alias("quantised"), F.when(strong >= 2, 0.70 + mean * 0.15).when(strong == 1, 0.65).otherwise(0.90).alias("confidence"))


def quick_jpeg_quality(first_quantiser: Column) -> Column:
    """By the first value of the first table; 85 if there is none."""
    by_value = (
        F.when(first_quantiser <= 2, 98).when(first_quantiser <= 5, 95).when(first_quantiser <= 10, 90).when(first_quantiser <= 20, 85)
        .when(first_quantiser <= 40, 75).when(first_quantiser <= 60, 65).otherwise(50)
    )
    return F.when(first_quantiser.isNull(), 85).otherwise(by_value)


def quick_webp_quality(index: Column) -> Column:
    """By the quantiser index, in wide integers: eight bits would overflow."""
    return F.least(F.floor((127 - (index % 128)) * 100 / 127), F.lit(100)).cast("int")


def png_raw_size(width: Column, height: Column, colour_type: Column, bit_depth: Column) -> Column:
    """Bytes of a PNG's pixels before compression."""
    samples = F.when(colour_type == 2, 3).when(colour_type == 4, 2).when(colour_type == 6, 4).otherwise(1)
    return F.ceil(width.cast("bigint") * height * samples * bit_depth / 8.0)


def png_signs(
    colour_type: Column, has_transparency: Column, area: Column, palette: Column, used: Column, entropy: Column, entropy_ratio: Column, size: Column, raw_size: Column
) -> dict[str, Column]:
    """Signs from a PNG's structure and colour counts that it was quantised, from 0 to 1; those of its pixels come beside them."""
    indexed, large, medium = colour_type == 3, area > 100_000, area > 10_000
    density = palette / F.sqrt(F.nullif(area, F.lit(0).cast("bigint")).cast("double"))
    by_size = (
        F.when(palette > 240, 0.95).when(palette > 200, 0.85).when(large & (palette > 64), 0.80).when(large & (palette > 32), 0.60).when(medium & (palette > 128), 0.50)
        .when((palette <= 16) & (density > 0.5), 0.0).when((palette <= 32) & (density > 0.3), 0.1).when(density < 0.5, 0.3).otherwise(0.15)
    )
    sparse = large & (palette * 1_000_000.0 < area * 50.0)
    share = used / F.nullif(palette, F.lit(0)).cast("double")
    colours = F.coalesce(palette, F.lit(256))
    return {
        "indexed_with_alpha": F.when(~indexed, 0.0).when(has_transparency, 0.98).when(large, 0.75).when(medium, 0.45).otherwise(0.15),
        "large_palette": F.when(palette.isNull(), 0.0).when(sparse, F.greatest(by_size, F.lit(0.70))).otherwise(by_size),
        "colour_anomaly": F.when(~indexed | palette.isNull(), 0.0).when(large, F.when(share > 0.8, 0.85).when(share > 0.5, 0.70).otherwise(0.50))
        .when((share > 0.9) & (palette > 200), 0.8).when((share > 0.7) & (palette > 128), 0.5).otherwise(0.0),
        "entropy_anomaly": F.when(~indexed, 0.0).when((colours >= 64) & (entropy_ratio < 0.6) & medium, clamp(0.5 + (0.6 - entropy_ratio) * 0.5, 0.0, 0.75))
        .when((colours >= 128) & (entropy < 5.0) & medium, clamp(0.5 + (5.0 - entropy) * 0.08, 0.0, 0.7)).when((colours >= 64) & (entropy_ratio < 0.5) & (area > 5_000), 0.35).otherwise(0.0),
        "size_anomaly": F.when(indexed & large & (size < raw_size * 0.15), 0.6).otherwise(0.0),
    }


def png_verdict(signs: dict[str, Column], colour_type: Column, bit_depth: Column, entropy_ratio: Column, area: Column) -> Column:
    """(quantised, confidence): 16 bits never are; a tool tells; truecolour by its own signals; else by the weighted score."""
    flat = F.when((entropy_ratio < 0.55) & (area > 10_000), 0.70).when((entropy_ratio < 0.65) & (area > 10_000), 0.40).otherwise(0.0)
    by_tool = signs["tool_signature"] >= 1.0
    deep = F.struct(F.lit(False).alias("quantised"), F.lit(1.0).alias("confidence"))
    truecolour = truecolour_verdict(signs["frequency"], flat, signs["banding"])
    return F.when(bit_depth == 16, deep).when(colour_type.isin(2, 6) & ~by_tool, truecolour).otherwise(quantisation_verdict(quantisation_score(signs), by_tool))


def is_modern_format(image_format: Column) -> Column:
    """Whether an image is in a format that is kept as it is; false for null."""
    return F.coalesce(image_format.isin(*V.MODERN_FORMATS), F.lit(False))
