"""Codec names to codecs, and what follows from the codec."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import values as V


def _names_match(text: Column, names: str) -> Column:
    """Whether ``text`` holds one of the names; & joins substrings that must both occur, = marks whole names."""
    found = F.lit(False)
    for part in names.split("|"):
        if part.startswith("="):
            here = text == part.strip("=")
        else:
            here = F.lit(True)
            for word in part.split("&"):
                here = here & F.contains(text, F.lit(word))
        found = found | here
    return found


def source_codec(name: Column) -> Column:
    """The codec whose name occurs first in the fixed order; Unknown for none, and for null."""
    text, out = F.lower(name), F.lit("Unknown")
    for line in reversed(V.SOURCE_CODECS.strip().splitlines()):
        codec, _, names = line.split(" ", 2)
        out = F.when(_names_match(text, names), codec).otherwise(out)
    return out


def efficiency(codec: Column) -> Column:
    """Bits against H.264 at the same quality."""
    lines = [line.split(" ", 2) for line in V.SOURCE_CODECS.strip().splitlines()]
    factors = F.create_map(*[x for name, factor, _ in lines for x in (F.lit(name), F.lit(float(factor)))])
    return F.coalesce(F.try_element_at(factors, codec), F.lit(1.0))


def is_lossless(codec: Column) -> Column:
    return codec.isin(V.LOSSLESS_CODECS)


def is_modern(codec: Column) -> Column:
    return codec.isin(V.MODERN_CODECS)


def is_cutting_edge(codec: Column) -> Column:
    return codec.isin(V.CUTTING_EDGE_CODECS)


def skip_video(codec: Column, apple_compat: bool = False) -> Column:
    """Whether a source codec is left alone; for Apple devices only H.265 is."""
    return codec.isin(["H265"] if apple_compat else V.SKIPPED_VIDEO_CODECS)


def apple_incompatible(codec: Column) -> Column:
    return codec.isin(V.APPLE_INCOMPATIBLE_CODECS)


def keep_fallback(codec: Column, smaller: Column, ratio: Column, tolerance: Column, apple_compat: Column, is_gif: Column) -> Column:
    """Whether a converted file is kept although it missed its goal."""
    return apple_compat & ~is_gif & apple_incompatible(codec) & (smaller | (tolerance & (ratio < 1.01)))


def skip_image(codec: Column, lossless: Column) -> Column:
    """Modern lossy stills, and JPEG XL always, are left alone."""
    return (codec == "JpegXl") | (~lossless & codec.isin("WebpStatic", "Avif", "Heic"))


def _lookup(name: Column, table: str, k: int, default: Column) -> Column:
    """Column ``k`` of the row whose first column lists the name."""
    pairs = [F.lit(x) for row in V.rows(table) for alias in row[0].split(",") for x in (alias, row[k])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.coalesce(name, F.lit("")))), default)


def detected(name: Column) -> Column:
    """The codec of an exact probe name, else Unknown."""
    return _lookup(name, V.DETECTED_CODECS, 1, F.lit("Unknown"))


def detected_label(name: Column) -> Column:
    return _lookup(name, V.DETECTED_CODECS, 2, name)


def detected_is(name: Column, which: list[str]) -> Column:
    return detected(name).isin(which)


def info(name: Column) -> Column:
    """name, long_name, category, is_lossless and typical_extension as a struct."""
    field = lambda k, default: _lookup(name, V.CODEC_INFO, k, default)
    return F.struct(
        field(1, F.lit("Unknown")).alias("name"), field(2, name).alias("long_name"), field(3, F.lit("Unknown")).alias("category"),
        (field(4, F.lit("false")) == "true").alias("is_lossless"), field(5, F.lit("mp4")).alias("typical_extension"),
    )
