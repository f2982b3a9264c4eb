"""Quality gates, grades and comparisons with a tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.quality import steps

# Tolerances.
EPSILON, EPSILON_SINGLE, SSIM_EPSILON, CRF_EPSILON, PSNR_EPSILON = 1e-6, 1e-4, 1e-4, 0.01, 0.1
# Words of the grades.
_WORDS = [
    "Excellent (visually indistinguishable)", "Good (visually lossless)", "Acceptable (minor difference)", "Fair (visible difference)",
    "Poor (noticeable quality loss)",
]


def about(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    return F.abs(a - b) < epsilon


def meets_ssim(ssim: Column, least: Column | float) -> Column:
    return ssim >= (least if isinstance(least, Column) else F.lit(least)) - SSIM_EPSILON


def crf_within(crf: Column, low: float, high: float) -> Column:
    return (crf >= low - CRF_EPSILON) & (crf <= high + CRF_EPSILON)


def search_ssim_grade(ssim: Column) -> Column:
    return steps(ssim, (0.98, _WORDS[0]), (0.95, _WORDS[1]), (0.90, _WORDS[2]), (0.85, _WORDS[3]), otherwise=_WORDS[4], op=">=")


def search_psnr_grade(psnr: Column) -> Column:
    by_value = steps(psnr, (45.0, _WORDS[0]), (40.0, _WORDS[1]), (35.0, _WORDS[2]), (30.0, _WORDS[3]), otherwise=_WORDS[4], op=">=")
    return F.when(F.abs(psnr) == float("inf"), "Lossless (identical)").otherwise(by_value)


def ms_ssim_grade(value: Column) -> Column:
    return steps(
        value, (0.95, _WORDS[0]), (0.90, "Good (streaming quality)"), (0.85, "Acceptable (mobile quality)"), (0.80, _WORDS[3]),
        otherwise=_WORDS[4], op=">=",
    )


def image_ssim_grade(ssim: Column) -> Column:
    return steps(
        ssim, (0.999, "Identical"), (0.98, "Excellent - virtually lossless"), (0.95, "Very good - minimal visible difference"),
        (0.90, "Good - acceptable quality"), (0.85, "Fair - noticeable degradation"), otherwise="Poor - significant quality loss", op=">=",
    )


def image_psnr_grade(psnr: Column) -> Column:
    by_value = steps(
        psnr, (50.0, "Excellent - virtually lossless"), (40.0, "Very good - minimal visible difference"), (35.0, "Good - acceptable quality"),
        (30.0, "Fair - noticeable degradation"), otherwise="Poor - significant quality loss",
    )
    return F.when(F.abs(psnr) == float("inf"), "Identical (lossless)").otherwise(by_value)


def typed_ssim_grade(ssim: Column) -> Column:
    return steps(ssim, (0.99, "Excellent (visually lossless)"), (0.95, "Very Good"), (0.90, "Good"), (0.80, "Fair"), otherwise="Poor", op=">=")


def passes(ssim: Column, psnr: Column, ms_ssim: Column, least_ssim: float | None = None, least_psnr: float | None = None, least_ms_ssim: float | None = None) -> Column:
    """Whether all demanded metrics are there and good enough; SSIM with a tolerance, infinite PSNR always."""
    good = F.lit(True)
    if least_ssim is not None:
        good = good & (ssim + SSIM_EPSILON >= least_ssim)
    if least_psnr is not None:
        good = good & ((psnr >= least_psnr) | (F.abs(psnr) == float("inf")))
    if least_ms_ssim is not None:
        good = good & (ms_ssim >= least_ms_ssim)
    return F.coalesce(good, F.lit(False))


def passes_ultimate(vmaf: Column, cambi: Column, psnr_u: Column, psnr_v: Column) -> Column:
    return F.coalesce((vmaf >= 93.0) & (cambi <= 5.0) & (psnr_u >= 35.0) & (psnr_v >= 35.0), F.lit(False))


def fused(ms_ssim: Column, ssim: Column) -> Column:
    """The weighted mean of both, or the one that is there."""
    return F.coalesce(0.6 * ms_ssim + 0.4 * ssim, ms_ssim, ssim)


def passes_fused(ms_ssim: Column, ssim: Column, least: float, long_video: Column) -> Column:
    return F.coalesce(fused(ms_ssim, ssim) >= F.when(long_video, 0.92).otherwise(max(least, 0.90)), F.lit(False))


def luma_weighted(y: Column, u: Column, v: Column) -> Column:
    return (6.0 * y + u + v) / 8.0


def search_score(ssim: Column, output: Column, size: Column, cpu: bool) -> Column:
    """Quality and saving, weighted by the phase of the search."""
    weight, rest = (0.7, 0.3) if cpu else (0.4, 0.6)
    share = F.when(size == 0, 1.0).otherwise(output / F.nullif(size, F.lit(0).cast("bigint")).cast("double"))
    return weight * ssim + rest * F.greatest(1.0 - share, F.lit(0.0))


def is_better(new: Column, old: Column, new_ssim: Column, least_ssim: float) -> Column:
    return F.when(new_ssim < least_ssim, False).when(old <= 0, new > 0).otherwise((new - old) > old * 0.005)


def overall_confidence(sampling: Column, prediction: Column, margin: Column, ssim: Column) -> Column:
    return F.least(sampling * 0.3 + prediction * 0.3 + margin * 0.2 + ssim * 0.2, F.lit(1.0))


def psnr_to_ssim(psnr: Column) -> Column:
    """The rough curve that stands in for a missing calibration."""
    return F.least(1.0 - F.pow(F.lit(10.0), -psnr / 20.0), F.lit(0.9999))


def crf_key(crf: Column) -> Column:
    """Hundredths of a rate factor; 0 for anything invalid."""
    return F.when(crf.isNull() | F.isnan(crf) | (crf < 0) | (crf == float("inf")), 0).otherwise(F.round(F.least(crf, F.lit(63.99)) * 100.0)).cast("int")


def zero_gains(duration: Column, crf_range: Column, ultimate: bool) -> Column:
    """How many searches without gain end one."""
    base = F.when(duration >= 300.0, 3.0).otherwise(50.0 if ultimate else 4.0)
    factor = F.when(crf_range < 20.0, F.greatest(F.least(crf_range / 20.0, F.lit(1.0)), F.lit(0.5))).otherwise(1.0)
    return F.greatest(F.round(base * factor), F.lit(15.0 if ultimate else 3.0)).cast("int")


def most_walls(crf_range: Column) -> Column:
    odd = F.isnan(crf_range) | (F.abs(crf_range) == float("inf")) | (crf_range <= 1.0)
    return F.when(odd, 15).otherwise(F.greatest(F.least(F.ceil(F.log2(F.greatest(crf_range, F.lit(1.0)))) + 8, F.lit(50)), F.lit(15))).cast("int")


def cpu_centre(gpu_crf: Column, gpu: Column, potential: Column) -> Column:
    """Where the fine search begins, from where the coarse one ended."""
    offset = F.when(gpu.isin("Apple", "AmdAmf"), 5.0).when(gpu.isin("Nvidia", "Vaapi"), 4.0).when(gpu == "IntelQsv", 3.5).otherwise(0.0)
    return gpu_crf + offset + F.when(potential < 0.3, 0.3).when(potential > 0.7, -0.2).otherwise(0.0)


def most_iterations(duration: Column, ultimate: int | None = None) -> Column:
    """How often a search may encode: less for long videos, as each try costs more; ``ultimate`` is the cap of that mode."""
    return F.when(duration >= 600.0, 100).when(duration >= 300.0, 150).otherwise(100 if ultimate is None else ultimate)


# Encoder -> scale of its rate factor, and the highest that a search takes.
SCALES = {"hevc": (51.0, 40.0), "av1": (63.0, 50.0), "h264": (51.0, 35.0)}


def search_limits(crf: Column, encoder: str) -> Column:
    """(max_crf, min_ssim) of a search that begins at ``crf``."""
    scale, cap = SCALES[encoder]
    level = F.least(crf / scale * (crf / scale), F.lit(1.0))
    falling = F.when(crf < 20.0, 0.95).when(crf < 30.0, 0.95 - (crf - 20.0) / 10.0 * 0.03).otherwise(0.92 - F.least((crf - 30.0) / 20.0, F.lit(1.0)) * 0.04)
    return F.struct(F.least(crf + 8.0 + level * 7.0, F.lit(cap)).alias("max_crf"), F.greatest(F.least(falling, F.lit(0.98)), F.lit(0.85)).alias("min_ssim"))


def anchor_offset(ratio: Column) -> Column:
    """What to add to a coarse rate factor, by the ratio of the fine size to the coarse one."""
    return F.when(ratio >= 1.0, 0.0).when(ratio < 0.70, 4.0).when(ratio < 0.80, 3.5).when(ratio < 0.90, 3.0).otherwise(2.5)


def calibrated(gpu_crf: Column, gpu_size: Column, size: Column, offset: float) -> Column:
    """(crf, confidence) of the fine search, from what the coarse one reached."""
    ratio = gpu_size / F.nullif(size, F.lit(0).cast("bigint")).cast("double")
    shift = F.when(ratio < 0.95, 1.0).when(ratio < 1.0, 0.5).when(ratio < 1.05, -0.5).otherwise(-1.0)
    trust = F.when(ratio < 0.95, 0.85).when(ratio < 1.0, 0.90).when(ratio < 1.05, 0.80).otherwise(0.70)
    return F.struct(F.greatest(F.least(gpu_crf + offset + shift, F.lit(51.0)), F.lit(10.0)).alias("crf"), trust.alias("confidence"))


def warm_start(last_best: Column, last_effort: Column, global_last: Column, predicted: Column) -> Column:
    return F.coalesce(last_best, last_effort, global_last, predicted)


def same_duration(a: Column, b: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(a - b) <= max(tolerance, 0.0), F.lit(False))
