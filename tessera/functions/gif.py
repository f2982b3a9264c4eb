"""Whether an animated image is kept as it is or becomes a video."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import values as V
from tessera.functions.quality import clamp, steps

# Bytes per pixel, areas and seconds between which scores fall.
BPP_LOW, BPP_HIGH = 0.03, 0.60
AREA_TINY, AREA_SMALL, AREA_HD = 96.0 * 96, 200.0 * 200, 1920.0 * 1080
KEEP, CONVERT = 0.60, 0.40
_CJK = r"[一-鿿぀-ゟ゠-ヿ가-힯]"


def normalised(value: Column, low: float, high: float) -> Column:
    return clamp((value - low) / (high - low), 0.0, 1.0)


def area(width: Column, height: Column) -> Column:
    return width.cast("bigint") * height.cast("bigint")


def bytes_per_pixel(size: Column, width: Column, height: Column, frames: Column) -> Column:
    return size / (F.greatest(area(width, height), F.lit(1)) * F.greatest(frames, F.lit(1))).cast("double")


def words_in(name: Column) -> Column:
    """Words of a file's name: runs of letters and digits; of Chinese, Japanese or Korean one for each four characters."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parts = F.filter(F.split(stem, r"[-_. ]"), lambda p: p != "")

    def count(part: Column) -> Column:
        wide = F.regexp_count(part, F.lit(_CJK))
        plain = F.regexp_count(F.regexp_replace(part, _CJK, " "), F.lit(r"[\p{L}\p{N}]+"))
        has_wide = F.rlike(part, F.lit(_CJK + r"$")) | F.rlike(part, F.lit(r"[一-鿿]"))
        return F.greatest(plain + F.when(has_wide, F.greatest(F.ceil(wide / 4.0), F.lit(1))).otherwise(0), F.lit(1))

    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, p: total + count(p))


def name_score(name: Column) -> Column:
    """(raw, kind) of a file's name: of human, machine or unclear origin."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    prefixed = F.rlike(stem, F.lit("^(" + "|".join(V.MACHINE_PREFIXES) + ")"))
    words = words_in(name)
    machine = F.when(F.rlike(stem, F.lit("^[0-9A-Fa-f]{32}$")) | prefixed, 0.60).when(F.rlike(stem, F.lit("^[0-9]{10,16}$")), 0.58)
    blank = F.coalesce(name, F.lit("")) == ""
    nothing = F.size(F.filter(F.split(stem, r"[-_. ]"), lambda p: p != "")) == 0
    raw = F.when(blank, 0.5).otherwise(F.coalesce(machine, F.when(nothing, 0.5).otherwise(steps(words, (1, 1.0), (2, 0.70), (3, 0.35), otherwise=0.20, op="<="))))
    kind = F.when(blank, "Ambiguous").when(machine.isNotNull(), "MachineGenerated").when(~nothing & (words <= 2), "HumanSemantic").otherwise("Ambiguous")
    return F.struct(raw.alias("raw"), kind.alias("kind"))


def palette_score(colours: Column) -> Column:
    """Small palettes, and powers of two, speak for drawn stickers; 0.5 if unknown."""
    base = steps(colours, (32, 1.0), (64, 0.80), (128, 0.55), otherwise=0.25, op="<=")
    power = F.bit_count(colours.cast("bigint")) == 1
    return F.when(colours.isNull() | (colours <= 0), 0.5).when(power, base).otherwise(F.greatest(base * 0.85, F.lit(0.10)))


def loop_score(duration: Column, frames: Column) -> Column:
    """Short loops and few frames speak for stickers."""
    by_loops = steps(F.try_divide(F.lit(60.0), duration), (20.0, 1.0), (10.0, 0.8), (5.0, 0.6), (2.0, 0.4), otherwise=0.2, op=">=")
    by_density = steps(F.try_divide(frames.cast("double"), duration), (5.0, 0.2), (10.0, 0.1), otherwise=0.0, op="<")
    return F.when((duration <= 0.01) | (frames == 0), 0.5).otherwise(F.least(by_loops + by_density, F.lit(1.0)))


def scores(name: Column, width: Column, height: Column, duration: Column, frames: Column, size: Column, palette: Column) -> dict[str, Column]:
    """Each score from 0 to 1, and their weighted total."""
    pixels = F.greatest(area(width, height), F.lit(1)).cast("double")
    bpp = bytes_per_pixel(size, width, height, frames)
    ratio = F.when(height > 0, width / F.nullif(height, F.lit(0)).cast("double")).otherwise(1.0)
    aspect = F.when(ratio.between(0.75, 1.35), 1.0).when(~ratio.between(0.5, 2.0), 0.1).otherwise(0.6)
    named = name_score(name)
    burden = normalised(pixels, AREA_SMALL, AREA_HD) * 0.6 + normalised(duration, 1.0, 15.0) * 0.4
    damping = F.when(named["kind"] == "HumanSemantic", 0.85).when(named["kind"] == "MachineGenerated", 0.95).otherwise(1.0)
    busy = normalised(bpp, BPP_LOW, BPP_HIGH)
    out = {
        "sharpness": 1.0 - busy,
        "resolution": 1.0 - normalised(pixels, AREA_SMALL, AREA_HD),
        "duration_score": 1.0 - normalised(duration, 1.0, 10.0),
        "aspect": aspect,
        "name_effective": named["raw"] * (1.0 - damping * burden),
        "loop": loop_score(duration, frames),
        "palette": palette_score(palette),
    }
    weights = {
        "sharpness": F.lit(0.38), "resolution": 0.18 + 0.10 * busy, "duration_score": 0.20 + 0.08 * busy, "aspect": 0.09 * (1.0 - 0.3 * busy),
        "name_effective": F.lit(0.08), "loop": F.lit(0.04), "palette": F.lit(0.05),
    }
    total = sum((out[k] * weights[k] for k in out), F.lit(0.0)) / sum(weights.values(), F.lit(0.0))
    return out | {"bytes_per_pixel": bpp, "total": total}


def veto(width: Column, height: Column, duration: Column, frames: Column, bpp: Column, vendors: Column) -> Column:
    """Keep, Convert, or null where the scores decide."""
    pixels = area(width, height).cast("double")
    sticker = F.exists(vendors, lambda v: F.rlike(v, F.lit("^(" + "|".join(V.STICKER_VENDORS) + ")")))
    return (
        F.when(F.coalesce(sticker, F.lit(False)), "Keep")
        .when((pixels >= AREA_HD) & ((bpp > BPP_HIGH) | (duration > 15.0)), "Convert")
        .when((bpp < BPP_LOW) & (pixels < AREA_SMALL), "Keep")
        .when((pixels <= AREA_TINY) & (duration <= 0.7) & (duration > 0.01) & (bpp <= 0.10), "Keep")
        .when((duration <= 1.0) & (duration > 0.01), "Keep")
        .when((frames > 0) & (frames <= 5) & (bpp <= 0.20), "Keep")
    )


def keeps(vetoed: Column, total: Column) -> Column:
    """Whether the image stays: by veto, else unless the score is sure of a video."""
    return F.when(vetoed.isNotNull(), vetoed == "Keep").otherwise((total >= KEEP) | (total > CONVERT))
