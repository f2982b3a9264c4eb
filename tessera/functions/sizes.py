"""Sizes before and after, and the gates that compare them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import values as V
from tessera.functions.paths import extension
from tessera.functions.quality import clamp


def saturating_minus(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("bigint"))


def margin(size: Column) -> Column:
    """Room for metadata: half a percent between fixed bounds."""
    return clamp((size * V.MARGIN_SHARE).cast("bigint"), V.MARGIN_MIN, V.MARGIN_MAX)


def target_size(size: Column) -> Column:
    return saturating_minus(size, margin(size))


def fits_with_metadata(output: Column, size: Column) -> Column:
    return output < target_size(size)


def compared_size(output: Column, size: Column, metadata: Column) -> Column:
    """What is compared with the input: for small inputs the output without its metadata."""
    return F.when(size < V.SMALL_FILE, saturating_minus(output, metadata)).otherwise(output)


def is_smaller(output: Column, size: Column, tolerance: Column) -> Column:
    return output < size + F.when(tolerance, V.TOLERANCE).otherwise(0)


def is_discarded(output: Column, size: Column, tolerance: Column) -> Column:
    """Whether an output has grown beyond what is allowed."""
    return output > size + F.when(tolerance, V.TOLERANCE - 1).otherwise(0)


def ratio(output: Column, size: Column, empty: float | None = 1.0) -> Column:
    """output / size; ``empty`` where size is 0."""
    return F.when(size > 0, output / F.nullif(size, F.lit(0).cast("bigint")).cast("double")).otherwise(F.lit(empty))


def reduction_percent(output: Column, size: Column) -> Column:
    return F.when(size > 0, (1.0 - ratio(output, size)) * 100.0).otherwise(0.0)


def change_percent(output: Column, size: Column) -> Column:
    return F.when(size > 0, (output - size) / F.nullif(size, F.lit(0).cast("bigint")).cast("double") * 100.0)


def overhead_share(path: Column) -> Column:
    ext, out = extension(path), F.lit(V.OTHER_OVERHEAD)
    for name, share in V.CONTAINER_OVERHEAD.items():
        out = F.when(ext == name, share).otherwise(out)
    return out


def estimated_overhead(path: Column, size: Column) -> Column:
    return (size * overhead_share(path)).cast("bigint")


def overhead_percent(overhead: Column, size: Column) -> Column:
    return F.when(size > 0, overhead / F.nullif(size, F.lit(0).cast("bigint")).cast("double") * 100.0).otherwise(0.0)


def rate_bytes(bits_per_second: Column, duration: Column) -> Column:
    return (bits_per_second * duration / 8.0).cast("bigint")
