"""Statistics of pixels: arrays of values of one image, or two images of the same size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Constants of the structural similarity, its window and the weights of its scales.
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
WINDOW, SIGMA, SCALES = 11, 1.5, (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


# Fixed values: (pixels, step) of the images whose pixels are sampled, and the samples wanted of a grid.
SAMPLED, GRID_SAMPLES, LEAST_GRID = ((1_000_000, 20), (100_000, 10), (-1, 1)), 50_000, 100


def per_image(images: DataFrame, key: str, columns: list[str], measure: Callable[..., tuple], fields: str) -> DataFrame:
    """``key`` and the ``fields`` that ``measure`` gives for each image's columns, inside its task; nulls where a column is null."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in fields.split(", ")]
        for batch in batches:
            rows = [(None,) * len(names) if any(v is None for v in row) else measure(*row) for row in zip(*(batch[c] for c in columns))]
            yield pd.concat([batch[[key]].reset_index(drop=True), pd.DataFrame(rows, columns=names, dtype=object)], axis=1)

    return images.select(key, *columns).mapInPandas(measured, f"{key} {images.schema[key].dataType.simpleString()}, {fields}")


def _sampled(values: np.ndarray) -> np.ndarray:
    return np.asarray(values)[:: _stride(len(values), *SAMPLED)]


def entropy(images: DataFrame, key: str, column: str, palette: int | None = None) -> DataFrame:
    """Shannon entropy in bits of each image's values, 0 for none; with ``palette`` also as a share of the most it could have."""

    def bits(values: np.ndarray) -> tuple:
        share = np.unique(values, return_counts=True)[1] / max(len(values), 1)
        return (float(-(share * np.log2(share)).sum()),)

    out = per_image(images, key, [column], bits, "entropy double")
    if palette:
        most = F.log2(F.lit(float(palette)))
        out = out.withColumns({"most": most, "ratio": F.when(most > 0, F.col("entropy") / F.nullif(most, F.lit(0.0))).otherwise(0.0)})
    return out


def distinct_colours(images: DataFrame, key: str, column: str, step: int = 4) -> DataFrame:
    """Different values after division by ``step`` among the sampled pixels, and their share of those (of 10000 at most).

    Of images above 100,000 and 1,000,000 pixels every tenth and twentieth is sampled.
    """

    def different(values: np.ndarray) -> tuple:
        taken = _sampled(values)
        n = len(np.unique(taken // step))
        return n, min(n / min(len(taken), 10_000), 1.0) if len(taken) else 0.0

    return per_image(images, key, [column], different, "colours long, diversity double")


def grid_sample(values: np.ndarray, width: int) -> np.ndarray:
    """One pixel near the middle of each block of a grid that aims at 50,000 samples."""
    height = len(values) // width if width > 0 else 0
    block = max(len(values) // min(GRID_SAMPLES, max(len(values), 1)), 1)
    middle = lambda length: np.minimum(np.arange(0, length, block) + block // 2, length - 1)
    return np.asarray(values)[: height * width].reshape(height, width)[np.ix_(middle(height), middle(width))].ravel() if height else np.empty(0)


def coverage(images: DataFrame, key: str, column: str, width: str, share: float = 0.85) -> DataFrame:
    """key, colours, needed, score: how few of the colours of a grid's samples cover ``share`` of them, and how quantised that looks.

    Images below 100 pixels score 0.
    """

    def covering(values: np.ndarray, width: int) -> tuple:
        counts = np.sort(np.unique(grid_sample(values, int(width)), return_counts=True)[1])[::-1]
        if not len(counts):
            return 0, None, len(values)
        return len(counts), int(np.searchsorted(np.cumsum(counts), int(counts.sum() * share))) + 1, len(values)

    out = per_image(images, key, [column, width], covering, "colours long, needed int, _pixels long")
    ratio = F.col("needed") / F.col("colours").cast("double")
    odd = (F.col("colours") < 2) | (F.col("_pixels") < LEAST_GRID)
    score = F.when(odd, 0.0).when(ratio < 0.05, 0.85).when(ratio < 0.10, 0.70).when(ratio < 0.20, 0.50).when(ratio < 0.35, 0.25).otherwise(0.0)
    return out.withColumn("score", score).drop("_pixels")


def contrast(images: DataFrame, key: str, column: str) -> DataFrame:
    """The standard deviation of the sampled grey over 80, at most 1; sampled as in ``distinct_colours``."""
    return per_image(images, key, [column], lambda v: (min(float(_sampled(v).std()) / 80.0, 1.0) if len(v) else 0.0,), "contrast double")


def compared(pairs: DataFrame, a: str, b: str, key: list[str]) -> DataFrame:
    """key, psnr, ssim over two arrays of one length, else null: plain statistics over whole images.

    PSNR is infinite for equal images. SSIM uses sample variances and is null below two pixels.
    Everything stays inside the row, so nothing is shuffled.
    """
    same = F.size(a) == F.size(b)
    n = F.size(a).cast("double")
    total = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x.cast("double"))
    mx, my = total(lambda x, y: x) / n, total(lambda x, y: y) / n
    mse = total(lambda x, y: (x - y) * (x - y)) / n
    vx, vy = (total(lambda x, y: x * x) - n * mx * mx) / (n - 1), (total(lambda x, y: y * y) - n * my * my) / (n - 1)
    cov = (total(lambda x, y: x * y) - n * mx * my) / (n - 1)
    denominator = (mx * mx + my * my + C1) * (vx + vy + C2)
    ssim = F.when(denominator < 1e-10, 1.0).otherwise((2 * mx * my + C1) * (2 * cov + C2) / denominator)
    psnr = F.when(mse < 1e-10, float("inf")).otherwise(10.0 * F.log10(F.lit(255.0**2) / F.greatest(mse, F.lit(1e-10))))
    return pairs.select(*key, F.when(same & (n > 0), psnr).alias("psnr"), F.when(same & (n > 1), ssim).alias("ssim"))


# --- what needs a neighbourhood: arrays inside tasks ------------------------------------------


def gaussian(size: int = WINDOW, sigma: float = SIGMA) -> np.ndarray:
    line = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    window = np.outer(line, line)
    return window / window.sum()


def window_ssim(a: np.ndarray, b: np.ndarray) -> float | None:
    """Mean structural similarity over all Gaussian windows; plain statistics for images smaller than one."""
    if a.shape != b.shape or a.size < 2:
        return None
    a, b = a.astype(float), b.astype(float)
    if min(a.shape) < WINDOW:
        mx, my, (vx, cov, _, vy) = a.mean(), b.mean(), np.cov(a.ravel(), b.ravel()).ravel()
        return float((2 * mx * my + C1) * (2 * cov + C2) / ((mx**2 + my**2 + C1) * (vx + vy + C2)))
    w = gaussian()
    mean = lambda x: np.einsum("ijkl,kl->ij", np.lib.stride_tricks.sliding_window_view(x, w.shape), w)
    mx, my = mean(a), mean(b)
    vx, vy, cov = mean(a * a) - mx**2, mean(b * b) - my**2, mean(a * b) - mx * my
    return float(((2 * mx * my + C1) * (2 * cov + C2) / ((mx**2 + my**2 + C1) * (vx + vy + C2))).mean())


def lanczos_weights(length: int, target: int, lobes: float = 3.0) -> np.ndarray:
    """(target, length): what each of ``length`` pixels gives to each of ``target`` ones by a Lanczos filter of so many lobes; rows sum to 1.

    Where the image shrinks the filter is as much wider; at the edges it is cut off.
    """
    ratio = length / target
    scale = max(ratio, 1.0)
    centre = (np.arange(target) + 0.5) * ratio
    left = np.clip(np.floor(centre - lobes * scale), 0, length - 1)
    right = np.clip(np.ceil(centre + lobes * scale), left + 1, length)
    at = np.arange(length)
    away = (at - (centre - 0.5)[:, None]) / scale
    weights = np.where(np.abs(away) < lobes, np.sinc(away) * np.sinc(away / lobes), 0.0)
    weights *= (at >= left[:, None]) & (at < right[:, None])
    return weights / weights.sum(axis=1, keepdims=True)


def halved(a: np.ndarray) -> np.ndarray:
    """Half the size by a Lanczos filter of three lobes, columns first, then rows; the result is rounded and clamped to bytes."""
    height, width = (n // 2 for n in a.shape)
    return np.clip(np.floor(lanczos_weights(a.shape[0], height) @ a @ lanczos_weights(a.shape[1], width).T + 0.5), 0, 255)


def multi_scale_ssim(a: np.ndarray, b: np.ndarray) -> float | None:
    """The weighted product over up to five scales, by the weights of the scales that are large enough."""
    product, used = 1.0, 0.0
    for weight in SCALES:
        if min(a.shape) < WINDOW or a.shape != b.shape:
            break
        product *= max(window_ssim(a, b), 0.0) ** weight
        used += weight
        a, b = halved(a), halved(b)
    return product ** (1 / used) if used else None


def _stride(pixels: int, *steps: tuple[int, int]) -> int:
    """The sampling step of an image of so many pixels: that of the first bound it exceeds."""
    return next((step for bound, step in steps if pixels > bound), steps[-1][1])


def neighbourhood(rgb: np.ndarray) -> dict[str, float]:
    """Edges, texture, sharpness and noise of an image (height, width, 3) from each sampled pixel's neighbours, from 0 to 1."""
    rgb = rgb.astype(np.int64)
    g, mean, n = rgb @ np.array([299, 587, 114]) // 1000, rgb.sum(axis=2) // 3, rgb.shape[0] * rgb.shape[1]
    out = dict.fromkeys(("edge_density", "texture_variance", "sharpness", "noise_level"), 0.0)
    if min(g.shape) >= 2:
        k = _stride(n, (1_000_000, 10), (100_000, 5), (-1, 1))
        here = mean[:-1, :-1]
        steps = (np.abs(here - mean[:-1, 1:]) + np.abs(here - mean[1:, :-1]))[::k, ::k]
        out["noise_level"] = min(1.0, float(steps.sum()) / (2 * steps.size) / 30.0)
    if min(g.shape) >= 3:
        k = _stride(n, (4_000_000, 4), (1_000_000, 2), (-1, 1))
        gradient = np.sqrt((g[1:-1, 2:] - g[1:-1, :-2]) ** 2 + (g[2:, 1:-1] - g[:-2, 1:-1]) ** 2)[::k, ::k]
        out["edge_density"] = min(1.0, 3.0 * float((gradient > 25.0).mean()))
        k = _stride(n, (1_000_000, 10), (100_000, 5), (-1, 2))
        blocks = np.lib.stride_tricks.sliding_window_view(g, (3, 3))[::k, ::k]
        out["texture_variance"] = min(1.0, float(blocks.std(axis=(2, 3)).mean()) / 80.0)
        k = _stride(n, (1_000_000, 10), (100_000, 5), (-1, 1))
        laplacian = np.abs(4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:])[::k, ::k]
        out["sharpness"] = min(1.0, float(laplacian.mean()) / 100.0)
    return out


def image_features(images: DataFrame, key: str, column: str, width: str) -> DataFrame:
    """key, edge_density, texture_variance, sharpness, noise_level of grey images given as flat rows of ``width``."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [neighbourhood(np.repeat(np.asarray(v, np.int64).reshape(-1, int(w), 1), 3, axis=2)) for v, w in zip(batch[column], batch[width])]
            yield pd.concat([batch[[key]].reset_index(drop=True), pd.DataFrame(found)], axis=1)

    kind = images.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, edge_density double, texture_variance double, sharpness double, noise_level double"
    return images.select(key, column, width).mapInPandas(measured, schema)


def window_similarity(pairs: DataFrame, key: list[str], a: str, b: str, width: str) -> DataFrame:
    """key, ssim, ms_ssim of two grey images of the same width, by Gaussian windows."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, y, w in zip(batch[a], batch[b], batch[width]):
                x, y = (np.asarray(v, float).reshape(-1, int(w)) for v in (x, y))
                out.append((window_ssim(x, y), multi_scale_ssim(x, y)))
            yield pd.concat([batch[key].reset_index(drop=True), pd.DataFrame(out, columns=["ssim", "ms_ssim"], dtype=float)], axis=1)

    fields = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in key)
    return pairs.select(*key, a, b, width).mapInPandas(measured, f"{fields}, ssim double, ms_ssim double")


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r * 299 + g * 587 + b * 114) / 1000).cast("int")


def has_alpha(pixels: DataFrame, key: str, every: int = 100) -> DataFrame:
    """key, has_alpha: whether any of every hundredth pixel (place, a) isn't opaque."""
    return pixels.filter(F.col("place") % every == 0).groupBy(key).agg(F.bool_or(F.col("a") < 255).alias("has_alpha"))


def perceived_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of colours, weighted by how the eye sees red, green and blue."""
    mean = (a[..., 0] + b[..., 0]) / 2
    red, green, blue = ((a[..., k] - b[..., k]) ** 2 for k in range(3))
    return np.sqrt((2 + mean / 256) * red + 4 * green + (2 + (255 - mean) / 256) * blue)


def dithering(rgb: np.ndarray) -> float:
    """From 0 to 1: pixels that differ moderately from three or more neighbours, or checkerboards of two by two, among the sampled ones."""
    rgb = rgb.astype(float)
    height, width = rgb.shape[:2]
    if min(height, width) < 8:
        return 0.0
    step = int(max(width * height / 10_000, 1))
    ys, xs = np.mgrid[1 : height - 1, 1 : width - 1]
    taken = (xs + ys * width) % step == 0
    centre, near = rgb[1:-1, 1:-1], np.zeros(taken.shape, int)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                away = perceived_difference(centre, rgb[1 + dy : height - 1 + dy, 1 + dx : width - 1 + dx])
                near += (away > 30) & (away < 100)
    diffused = min(1.0, 5.0 * float((near >= 3)[taken].mean())) if taken.any() else 0.0
    grid = taken & (ys % 2 == 1) & (xs % 2 == 1)
    right, below, across = rgb[1:-1, 2:], rgb[2:, 1:-1], rgb[2:, 2:]
    diagonal = perceived_difference(centre, across) + perceived_difference(right, below)
    straight = perceived_difference(centre, right) + perceived_difference(centre, below)
    ordered = min(1.0, 4.0 * float(((straight > 40) & (diagonal < straight * 0.5))[grid].mean())) if grid.any() else 0.0
    return max(diffused, ordered)


# Weights of red, green and blue, of rows and diagonals; lines taken; bounds of a gradient's steps and length, and of the share of bands in it.
CHANNELS, ROWS_SHARE, ROW_STEP, DIAGONAL_STEP, LEAST_SIDE = (0.30, 0.59, 0.11), 0.70, 4, 8, 16
GENTLE, BAND, BAND_GAP, LEAST_GRADIENT, BANDED = 20, 3, 3, 20, (0.08, 0.5)


def gradient_bands(lines: np.ndarray, length: np.ndarray, rows: bool, image: np.ndarray | None = None, images: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``images``: sum and number of the shares of bands in the gradients of its ``lines`` (line, place), of which ``length`` places are there; ``image`` is the one that a line is of.

    A gradient is a run of gentle steps (above 0, below GENTLE); those above BAND are bands. It counts where a
    step that isn't gentle ends it after more than LEAST_GRADIENT. Along ``rows`` a shorter run is carried on behind such a step, and bands are
    more than BAND_GAP places apart; on diagonals it starts again.
    """
    n = len(lines)
    image = np.zeros(n, int) if image is None else image
    total, regions = np.zeros(images), np.zeros(images, int)
    long, bands, last = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
    for at in range(1, lines.shape[1]):
        step = np.abs(lines[:, at] - lines[:, at - 1])
        there = at < length
        gentle = there & (step > 0) & (step < GENTLE)
        long += gentle
        band = gentle & (step > BAND) & ((at - last > BAND_GAP) if rows else True)
        bands += band
        last[band] = at
        over = np.flatnonzero(there & ~gentle & (long > LEAST_GRADIENT))
        if len(over):
            share = bands[over] / long[over]
            good = (share > BANDED[0]) & (share < BANDED[1])
            total += np.bincount(image[over[good]], share[good], images)
            regions += np.bincount(image[over[good]], minlength=images)
        ended = over if rows else there & ~gentle
        long[ended] = bands[ended] = 0
        last[over] = at
    return total, regions


def diagonals(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The diagonals that start at every DIAGONAL_STEP of the upper edge of each image (image, y, x), downwards to the right and to the left, padded, and their lengths."""
    height, width = grey.shape[1:]
    starts = np.arange(0, width, DIAGONAL_STEP)
    first = np.concatenate([starts, starts[1:]])
    turn = np.concatenate([np.ones(len(starts), int), -np.ones(len(starts) - 1, int)])
    length = np.minimum(np.where(turn > 0, width - first, first + 1), height)
    x = first[:, None] + turn[:, None] * np.arange(height)
    return grey[:, np.arange(height)[None, :], np.clip(x, 0, width - 1)], length


def _mean_shares(lines: np.ndarray, length: np.ndarray, rows: bool) -> np.ndarray:
    """The mean share of bands, 1 at most and 0 for none, of each image's lines (image, line, place)."""
    n, k, places = lines.shape
    total, regions = gradient_bands(lines.reshape(n * k, places), np.tile(length, n), rows, np.repeat(np.arange(n), k), n)
    return np.minimum(total / np.maximum(regions, 1), 1.0)


def bandings(images: np.ndarray) -> np.ndarray:
    """``banding`` of several images of one shape (image, height, width, 3); one channel (image, height, width, 1) stands for three equal ones."""
    n, height, width = images.shape[:3]
    if min(height, width) < LEAST_SIDE:
        return np.zeros(n)
    images = images.astype(int)
    rows, grey = images[:, ::ROW_STEP], images.shape[3] == 1
    along = [_mean_shares(rows[..., k], np.full(rows.shape[1], width), True) for k in range(images.shape[3])]
    along = sum(weight * along[0 if grey else k] for k, weight in enumerate(CHANNELS))
    across = _mean_shares(*diagonals(images[..., 0] if grey else images @ np.array([299, 587, 114]) // 1000), False)
    return np.minimum(along * ROWS_SHARE + across * (1 - ROWS_SHARE), 1.0)


def banding(rgb: np.ndarray) -> float:
    """From 0 to 1: how much of the gradients of an image (height, width, 3) goes in bands, along every fourth row of each channel and on diagonals of the grey image."""
    return float(bandings(rgb[None])[0])


#: Pixels of images of one shape whose bands are measured at once.
BANDED_AT_ONCE = 1 << 20


def banded(images: DataFrame, key: str, column: str, width: str) -> DataFrame:
    """key, banding of grey images given as flat rows of ``width``, as ``artefacts`` gives it; images of one shape are measured together. Null where a column is null."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, widths = batch[column].to_numpy(), batch[width].to_numpy()
            shapes: dict[tuple, list[int]] = {}
            for k, (v, w) in enumerate(zip(values, widths)):
                if v is not None and not pd.isna(w):
                    shapes.setdefault((len(v), int(w)), []).append(k)
            out = np.full(len(batch), None, object)
            for (size, w), places in shapes.items():
                several = max(1, BANDED_AT_ONCE // max(size, 1))
                for at in range(0, len(places), several):
                    some = places[at : at + several]
                    out[some] = bandings(np.stack([np.asarray(values[k], np.int64) for k in some]).reshape(len(some), -1, w, 1)).tolist()
            yield pd.DataFrame({key: batch[key], "banding": out})

    return images.select(key, column, width).mapInPandas(measured, f"{key} {images.schema[key].dataType.simpleString()}, banding double")


def artefacts(images: DataFrame, key: str, column: str, width: str) -> DataFrame:
    """key, banding, dithering of grey images given as flat rows of ``width``."""

    def found(values: np.ndarray, width: int) -> tuple:
        rgb = np.repeat(np.asarray(values, np.int64).reshape(-1, int(width), 1), 3, axis=2)
        return banding(rgb), dithering(rgb)

    return per_image(images, key, [column, width], found, "banding double, dithering double")
