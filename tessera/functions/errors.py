"""What messages of a run mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import values as V


def _says(message: Column, pattern: str) -> Column:
    return F.rlike(F.lower(message), F.lit(pattern))


def severity(message: Column) -> Column:
    return (
        F.when(_says(message, "data loss|corrupt|truncat"), "Critical")
        .when(_says(message, "metadata") & _says(message, "lost|missing|strip"), "MetadataLoss")
        .when(_says(message, "broken pipe|unexpected eof|connection reset"), "PipelineBroken")
        .when(_says(message, "assertion failed|segmentation fault|bus error|could find no file|pattern_type"), "Rare")
        .when(_says(message, "cjxl|magick|ffmpeg|ffprobe") & _says(message, "exit code|failed|error"), "UpstreamError")
        .otherwise("Standard")
    )


def is_disk_full(message: Column) -> Column:
    return F.coalesce(_says(message, "|".join(V.DISK_FULL)), F.lit(False))


def image_outcome(ok: Column, skipped: Column, message: Column) -> Column:
    """succeeded, skipped, paused or failed, as the image tools count."""
    return (
        F.when(ok & skipped, "skipped").when(ok, "succeeded").when(F.rlike(message, F.lit("Skipped|skip")), "skipped")
        .when(is_disk_full(message), "paused").otherwise("failed")
    )


def video_outcome(ok: Column, skipped: Column, message: Column) -> Column:
    """As the video tools count: only an output that exists is a skip."""
    return (
        F.when(ok & skipped, "skipped").when(ok, "succeeded").when(F.contains(message, F.lit("Output exists:")), "skipped")
        .when(is_disk_full(message), "paused").otherwise("failed")
    )


# Kind of an error -> category.
CATEGORIES = {
    "Fatal": "FileNotFound DirectoryNotFound FileReadError FileWriteError Io FfmpegError FfprobeError ToolNotFound Other",
    "Recoverable": "InvalidCrf InvalidSsim CompressionFailed QualityValidationFailed IterationLimitExceeded",
    "Optional": "OutputExists",
}


def category(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kinds in CATEGORIES.items():
        out = F.when(kind.isin(kinds.split()), name).otherwise(out)
    return out


def is_skip(kind: Column) -> Column:
    return kind == "OutputExists"
