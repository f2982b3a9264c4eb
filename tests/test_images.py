"""Scales of the structural similarity and bands in gradients, against loops over pixels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import pixels, runs
from tessera.sources import variants


def lanczos(x):
    if x == 0:
        return 1.0
    return math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3) if abs(x) < 3 else 0.0


def plain_line(values, target):
    ratio, out = len(values) / target, []
    for k in range(target):
        centre = (k + 0.5) * ratio
        left = min(max(math.floor(centre - 3 * max(ratio, 1)), 0), len(values) - 1)
        right = min(max(math.ceil(centre + 3 * max(ratio, 1)), left + 1), len(values))
        weights = [lanczos((i - (centre - 0.5)) / max(ratio, 1)) for i in range(left, right)]
        out.append(sum(w * values[i] for w, i in zip(weights, range(left, right))) / sum(weights))
    return out


@pytest.mark.parametrize("shape", [(12, 12), (13, 31), (40, 11)])
def test_halving_matches_a_loop(shape):
    image = np.random.default_rng(3).integers(0, 256, shape)
    image[: shape[0] // 2, : shape[1] // 2], image[: shape[0] // 2, shape[1] // 2 :] = 0, 255  # a step that overshoots and is clamped
    columns = np.array([plain_line(list(c), shape[0] // 2) for c in image.T]).T
    rows = np.array([plain_line(list(r), shape[1] // 2) for r in columns])
    expected = np.clip(np.floor(rows + 0.5), 0, 255)
    assert (np.abs(pixels.halved(image) - expected) <= (np.abs(rows + 0.5 - np.round(rows + 0.5)) < 1e-9)).all()
    assert expected.min() == 0 and expected.max() == 255


def test_five_scales():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (176, 190)).astype(float)
    b = np.clip(a + rng.normal(0, 12, a.shape), 0, 255).round()
    product, x, y = 1.0, a, b
    for weight in pixels.SCALES:
        assert min(x.shape) >= pixels.WINDOW  # so all five are used
        product *= pixels.window_ssim(x, y) ** weight
        x, y = pixels.halved(x), pixels.halved(y)
    assert abs(pixels.multi_scale_ssim(a, b) - product ** (1 / sum(pixels.SCALES))) < 1e-12 and 0.5 < product < 1
    assert pixels.multi_scale_ssim(a[:175], b[:175]) != pixels.multi_scale_ssim(a, b)


def plain_banding(rgb):
    """Pixel by pixel."""
    height, width = rgb.shape[:2]
    if min(height, width) < 16:
        return 0.0

    def mean(shares):
        return min(sum(shares) / len(shares), 1.0) if shares else 0.0

    total = 0.0
    for k, weight in enumerate((0.30, 0.59, 0.11)):
        shares = []
        for y in range(0, height, 4):
            run = bands = last = 0
            for x in range(1, width):
                step = abs(int(rgb[y, x, k]) - int(rgb[y, x - 1, k]))
                if 0 < step < 20:
                    run += 1
                    if step > 3 and x - last > 3:
                        bands, last = bands + 1, x
                elif run > 20:
                    if bands and 0.08 < bands / run < 0.5:
                        shares.append(bands / run)
                    run, bands, last = 0, 0, x
        total += mean(shares) * weight
    grey = (rgb.astype(int) @ np.array([299, 587, 114])) // 1000
    shares = []
    for start in range(0, width, 8):
        for turn in (1, -1) if start else (1,):
            line = [int(grey[i, start + turn * i]) for i in range(height) if 0 <= start + turn * i < width]
            run = bands = 0
            for before, after in zip(line, line[1:]):
                step = abs(after - before)
                if 0 < step < 20:
                    run, bands = run + 1, bands + (step > 3)
                else:
                    if run > 20 and bands and 0.08 < bands / run < 0.5:
                        shares.append(bands / run)
                    run = bands = 0
    return min(total * 0.70 + mean(shares) * 0.30, 1.0)


def test_banding_matches_a_loop():
    rng, several = np.random.default_rng(5), 0
    for k in range(40):
        height, width = rng.integers(10, 70, 2)
        walk = np.cumsum(rng.choice([0, 1, 1, 2, 2, 3, 5, 12, -60], size=(height, width), p=[0.03, 0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.02]), axis=1 if k % 2 else 0)
        rgb = np.stack([walk % 256, (walk + walk.T[0, 0]) % 256, (walk * 2) % 256], axis=2)
        expected = plain_banding(rgb)
        assert abs(pixels.banding(rgb) - expected) < 1e-12
        several += expected > 0
    assert several > 20 and pixels.banding(np.zeros((15, 99, 3))) == 0.0


def test_figures_are_counted_by_the_pass_that_writes(spark, tmp_path):
    rows = [(["succeeded", "failed", "skipped", "paused", None][k % 5], k, None if k % 3 == 0 else k // 2) for k in range(100)]
    results = spark.createDataFrame(rows, "outcome string, input_size long, output_size long").repartition(7)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("report", "")
    report = runs.write_report(results, str(tmp_path / "out"))
    spark.sparkContext.setJobGroup("other", "")
    stages = [s for j in tracker.getJobIdsForGroup("report") for s in tracker.getJobInfo(j).stageIds]
    assert len(tracker.getJobIdsForGroup("report")) <= 2 and len(stages) <= 3  # the write and its shuffle: no scan for the report
    expected = runs.figures(spark.read.parquet(str(tmp_path / "out"))).first().asDict()
    assert {k: report[k] for k in expected} == expected and expected["succeeded"] == 20 and expected["total"] == 60
    empty = runs.write_report(results.limit(0), str(tmp_path / "none"))
    assert empty["total"] == 0 and empty["reduction"] == 0.0


def test_variants_keep_what_a_fixed_form_loses(spark):
    docs = spark.createDataFrame([(1, '{"a": {"x": 1, "tags": {"T": "v"}}, "l": [1, "s", null, [true]]}'), (2, '{"a": {"x": "1"}}'), (3, "{bad"), (4, None), (5, "[]"), (6, '{"a": {"x": 2}}')], "id long, json string")
    found = {(r["path"], r["kind"]): r["n"] for r in variants.paths_and_kinds(variants.as_variant(docs)).collect()}
    assert found == {
        ("$", "object"): 3, ("$", "array"): 1, ("$.a", "object"): 3, ("$.a.x", "number"): 2, ("$.a.x", "string"): 1, ("$.a.tags", "object"): 1, ("$.a.tags.T", "string"): 1, ("$.l", "array"): 1,
        ("$.l[]", "number"): 1, ("$.l[]", "string"): 1, ("$.l[]", "null"): 1, ("$.l[]", "array"): 1, ("$.l[][]", "boolean"): 1,
    }
    documents = variants.as_variant(docs)
    assert [r[0] for r in documents.orderBy("id").select(variants.tag("document", "$.a.tags.T")).collect()] == ["v", None, None, None, None, None]
    assert "tags" in variants.merged_schema(documents.filter(F.col("id") != 5)).first()["schema"]
    assert variants.paths_and_kinds(documents.limit(0)).count() == 0


def test_images_of_one_shape_are_banded_together(spark):
    """Grey images of several shapes, one of them null, in one batch."""
    rng, rows = np.random.default_rng(8), []
    for k in range(24):
        height, width = [(32, 64), (20, 40), (8, 64)][k % 3]
        walk = np.cumsum(rng.choice([0, 1, 2, 3, 5, -60], size=(height, width), p=[0.03, 0.45, 0.25, 0.15, 0.1, 0.02]), axis=1) % 256
        rows.append((k, walk.ravel().tolist(), width))
    images = spark.createDataFrame([*rows, (99, None, 8)], "id long, px array<int>, width int").coalesce(1)
    got = {r["id"]: r["banding"] for r in pixels.banded(images, "id", "px", "width").collect()}
    single = {k: plain_banding(np.repeat(np.array(px).reshape(-1, width, 1), 3, axis=2)) for k, px, width in rows}
    assert got.pop(99) is None and set(got) == set(single) and all(abs(got[k] - single[k]) < 1e-12 for k in got) and sum(v > 0 for v in got.values()) > 8
