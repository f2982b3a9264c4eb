"""Colour descriptions as codes and as encoder settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import rational

HDR_TRANSFERS = ("smpte2084", "arib-std-b67")


def cicp(primaries: Column, transfer: Column, matrix: Column) -> Column:
    """primaries-transfer-matrix as code points; null where nothing speaks for HDR or a known gamut."""
    hdr = F.coalesce(transfer.isin(*HDR_TRANSFERS), F.lit(False))
    p = F.when(primaries == "bt709", 1).when(primaries == "bt2020", 9).when(primaries.isin("smpte432", "display-p3"), 12).when(hdr, 9)
    t = F.when(transfer == "smpte2084", 16).when(transfer == "arib-std-b67", 18).when(transfer == "bt709", 1).when(transfer.isin("srgb", "iec61966-2-1"), 13).when(p == 9, 16)
    m = F.when(matrix.isin("bt2020nc", "bt2020-ncl"), 9).when(matrix == "bt709", 1).when(matrix.isin("rgb", "gbr"), 0).when(p.isin(9, 1), p).otherwise(0)
    return F.when(p.isNotNull() & t.isNotNull(), F.concat_ws("-", p.cast("string"), t.cast("string"), m.cast("string")))


def encoder_arguments(primaries: Column, transfer: Column, matrix: Column) -> Column:
    """Options for what is known, space-separated."""
    option = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + " "), value))
    return F.concat_ws(" ", option("-colorspace", matrix), option("-color_trc", transfer), option("-color_primaries", primaries))


def dolby_profile(profile: Column, compatibility: Column) -> Column:
    """The encoder's name of a Dolby Vision profile; 7 becomes 8.1."""
    return F.when(profile == 5, "5.0").when(profile == 7, "8.1").when(profile == 8, F.concat(F.lit("8."), F.coalesce(compatibility, F.lit(1)).cast("string")))


def _scaled(value: Column, scale: float) -> Column:
    return F.round(rational(value) * scale).cast("bigint").cast("string")


def mastering_display(side: Column) -> Column:
    """The encoder's spelling of a mastering display, from a map of rationals; null if a figure is missing."""
    xy = lambda name: F.concat(F.lit("("), _scaled(side[f"{name}_x"], 50_000.0), F.lit(","), _scaled(side[f"{name}_y"], 50_000.0), F.lit(")"))
    light = F.concat(F.lit("("), _scaled(side["max_luminance"], 10_000.0), F.lit(","), _scaled(side["min_luminance"], 10_000.0), F.lit(")"))
    return F.concat(F.lit("G"), xy("green"), F.lit("B"), xy("blue"), F.lit("R"), xy("red"), F.lit("WP"), xy("white_point"), F.lit("L"), light)


def light_level(side: Column) -> Column:
    """max_content,max_average of a map; null if one is missing."""
    return F.concat(F.coalesce(side["max_content"], side["MaxCLL"]), F.lit(","), F.coalesce(side["max_average"], side["MaxFALL"]))


def audio_arguments(codec: Column, container: Column) -> Column:
    """Copy where the container takes the codec, else AAC; none without audio."""
    copies = (F.lower(container) == "mkv") | ~F.rlike(F.lower(codec), F.lit("opus|vorbis"))
    return F.when(F.coalesce(codec, F.lit("")) == "", "-an").when(copies, "-c:a copy").otherwise("-c:a aac -b:a 256k")


def subtitle_arguments(codec: Column, container: Column, present: Column) -> Column:
    """Copy in mkv; elsewhere text becomes mov_text and pictures go."""
    written = F.lower(codec).isin("srt", "subrip", "ass", "ssa", "mov_text", "webvtt", "text")
    return F.when(~present, "").when(F.lower(container) == "mkv", "-c:s copy").when(F.coalesce(written, F.lit(False)), "-c:s mov_text").otherwise("-sn")
