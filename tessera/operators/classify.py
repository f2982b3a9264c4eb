"""Rule tables: content classes, and the quality that a quantisation table stands for."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import values as V
from tessera.functions.quality import clamp

RANGES = ("complexity", "edge_density", "color_diversity", "texture_variance", "noise_level", "sharpness", "contrast", "aspect_ratio", "width", "height")


def parsed_rules() -> list[tuple]:
    """The fixed rules: position, name, priority, flags by name, bounds by (range, sign)."""
    found = []
    for position, (name, priority, conditions) in enumerate(V.rows(V.CLASSIFIER)):
        flags, bounds = {}, {}
        for field, sign, value in re.findall(r"(\w+)(<=|>=|=)(\S+)", conditions):
            if sign == "=":
                flags[field] = value == "true"
            else:
                bounds[field, sign] = float(value)
        found.append((position, name, int(priority), flags, bounds))
    return found


def classifier_rules(spark: SparkSession) -> DataFrame:
    """The fixed rules as a table: position, name, priority, flags, and a (low, high) for each range, null where open."""
    schema = "position int, name string, priority int, is_animated boolean, has_alpha boolean, " + ", ".join(f"{r}_low double, {r}_high double" for r in RANGES)
    rows = [(p, n, k, flags.get("is_animated"), flags.get("has_alpha"), *[bounds.get((r, s)) for r in RANGES for s in (">=", "<=")]) for p, n, k, flags, bounds in parsed_rules()]
    return spark.createDataFrame(rows, schema)


def content_class() -> Column:
    """The name of the matching rule with the highest priority, the first of equals; UNKNOWN for none. One expression over an image's own columns."""
    ratio = F.col("width") / F.greatest("height", F.lit(1)).cast("double")
    value = lambda field: ratio if field == "aspect_ratio" else F.col(field)
    out = None
    for _, name, _, flags, bounds in sorted(parsed_rules(), key=lambda r: (-r[2], r[0])):
        match = F.lit(True)
        for flag, wanted in flags.items():
            match = match & (F.col(flag) == wanted)
        for (field, sign), bound in bounds.items():
            match = match & (value(field) >= bound if sign == ">=" else value(field) <= bound)
        out = F.when(match, name) if out is None else out.when(match, name)
    return out.otherwise("UNKNOWN")


def classify(images: DataFrame, key: str) -> DataFrame:
    """``key``, content_type of each image; nothing is joined or shuffled."""
    return images.select(key, content_class().alias("content_type"))


def scaled_table(quality: Column, base: list[int]) -> Column:
    """The standard's quantisation table for a quality from 1 to 100."""
    scale = F.when(quality < 50, 5000.0 / quality).otherwise(200.0 - 2.0 * quality)
    return F.array(*[clamp(F.floor((scale * float(v) + 50.0) / 100.0), 1, 255).cast("int") for v in base])


def squared_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow((x - y).cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def weighted_error(a: Column, b: Column) -> Column:
    """The mean squared difference by the weights of the places."""
    weights = F.array(*[F.lit(w) for w in V.JPEG_WEIGHTS])
    squares = F.zip_with(F.zip_with(a, b, lambda x, y: F.pow((x - y).cast("double"), F.lit(2.0))), weights, lambda d, w: d * w)
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / sum(V.JPEG_WEIGHTS)


def _scaled(quality: int, base: list[int]) -> list[int]:
    """``scaled_table`` in plain numbers."""
    scale = 5000.0 / quality if quality < 50 else 200.0 - 2.0 * quality
    return [min(max(int((scale * v + 50.0) // 100.0), 1), 255) for v in base]


def jpeg_quality(tables: DataFrame, key: str, column: str = "table", base: list[int] = V.JPEG_LUMINANCE) -> DataFrame:
    """``key``, quality, sse, is_exact, interpolated: the quality whose standard table is nearest, the lowest of equals.

    The 100 standard tables are a constant that each row is held against by itself, as products of matrices inside tasks: whole numbers, so doubles are
    exact. Interpolation leans towards the second best. A table that is null, holds a null or has another length has no errors: quality 1, the rest as nulls give it.
    """
    standard = np.array([_scaled(q, base) for q in range(1, 101)], float)
    squares = (standard * standard).sum(axis=1)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [None if t is None or len(t) != len(base) else np.asarray(t, float) for t in batch["table"]]
            whole = np.array([t is not None and not np.isnan(t).any() for t in held], bool)
            n = len(batch)
            one, two = np.zeros(n, int), np.ones(n, int)
            first, second = np.full(n, np.nan), np.full(n, np.nan)
            if whole.any():
                x = np.stack([t for t, w in zip(held, whole) if w])
                errors = (x * x).sum(axis=1)[:, None] - 2 * (x @ standard.T) + squares
                rows = np.arange(len(x))
                one[whole] = best = errors.argmin(axis=1)  # the first of equals
                first[whole] = errors[rows, best]
                errors[rows, best] = np.inf
                two[whole] = other = errors.argmin(axis=1)
                second[whole] = errors[rows, other]
            yield pd.DataFrame({key: batch[key], "q1": one + 1, "e1": first, "q2": two + 1, "e2": second})

    asked = tables.select(key, F.col(column).cast("array<double>").alias("table"))
    found = asked.mapInPandas(nearest, f"`{key}` {tables.schema[key].dataType.simpleString()}, q1 int, e1 double, q2 int, e2 double")
    first, second = (F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("e1", "e2"))
    step = F.when(F.col("q2") > F.col("q1"), 1.0).otherwise(-1.0) * (first / (first + second)) * 0.5
    lean = F.when((first > 0) & (second > first), step).otherwise(0.0)
    return found.select(key, F.col("q1").alias("quality"), first.alias("sse"), (first == 0).alias("is_exact"), (F.col("q1") + lean).alias("interpolated"))
