"""Which measured point each search strategy would take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = ["crf", "size", "ssim"]


def _chosen(trace: DataFrame, run: str, candidate: Column, order: Column, passed: Column) -> DataFrame:
    """run, crf, size, ssim, passed: the candidate with the highest order."""
    row = F.struct(*POINT, F.coalesce(passed, F.lit(False)).alias("passed"))
    best = F.max_by(F.when(candidate, row), F.when(candidate, order))
    return trace.groupBy(run).agg(best.alias("_b")).select(run, "_b.*")


def best_points(trace: DataFrame, strategy: str, run: str = "run_id", least_ssim: float = 0.95) -> DataFrame:
    """One row per run, ties by size, then by quality, of ``trace`` (crf, size, ssim, input_size, initial_crf): the strategy's choice, null where none fits.

    size_only takes the highest rate factor; quality_match the initial one;
    precise the highest that is good enough; precise_compressed the best quality
    that is smaller than the input; compress_only the initial one if it is smaller,
    else the lowest above it that is; compress_quality the same, and asks for quality as well.
    """
    crf, small, good = F.col("crf"), F.col("size") < F.col("input_size"), F.col("ssim") >= least_ssim
    high, low = F.struct(crf, -F.col("size"), "ssim"), F.struct(-crf, -F.col("size"), "ssim")
    rules = {
        "size_only": (F.lit(True), high, small),
        "quality_match": (crf == F.col("initial_crf"), high, good),
        "precise": (good, high, good),
        "precise_compressed": (small, F.struct("ssim", crf, -F.col("size")), good),
        "compress_only": (small & (crf >= F.col("initial_crf")), low, small),
        "compress_quality": (small & (crf >= F.col("initial_crf")), low, small & good),
    }
    return _chosen(trace, run, *rules[strategy])


STRATEGIES = ("size_only", "quality_match", "precise", "precise_compressed", "compress_only", "compress_quality")
