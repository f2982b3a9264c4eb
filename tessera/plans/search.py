"""Traces of searches, and statistics of pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import interpolate, pixels, strategies, traces
from tessera.plans.inputs import ctes, load

C = F.col


def trailing_variance(spark, d):
    return traces.trailing(load(spark, d, "trace")).select("run_id", "iteration", "variance", F.when(C("change") < float("inf"), C("change")).alias("change"))


def early_exit(spark, d):
    return traces.early_exit(load(spark, d, "trace"))


def plateau(spark, d):
    return traces.plateau(load(spark, d, "trace"), "score")


def quality_ceiling(spark, d):
    return traces.ceiling(load(spark, d, "trace"), "ssim")


def zero_gain(spark, d):
    return traces.zero_gain(load(spark, d, "trace"), "score", threshold=0.3)


def credible_failure(spark, d):
    return traces.failures_in_a_row(load(spark, d, "trace"), "score", C("psnr") >= 34.0)


def small_improvements(spark, d):
    return traces.small_improvements(load(spark, d, "trace"), "score")


def moving_eta(spark, d):
    return traces.eta(load(spark, d, "trace"), 60).select("run_id", "iteration", "eta_secs")


def _best(name):
    def query(spark, d):
        return strategies.best_points(load(spark, d, "trace"), name)

    return query


def psnr_to_ssim(spark, d):
    """What every row's run would give at a little more PSNR, by all rows of the run."""
    trace = load(spark, d, "trace")
    return interpolate.predict(trace.withColumn("psnr", C("psnr") + 0.25), trace, ["event_id"])


def mapping_quality(spark, d):
    return interpolate.mapping_quality(load(spark, d, "trace"))


def pixel_entropy(spark, d):
    return pixels.entropy(load(spark, d, "pixels"), "vec_id", "px", 256)


def colour_diversity(spark, d):
    return pixels.distinct_colours(load(spark, d, "pixels"), "vec_id", "px")


def colour_coverage(spark, d):
    doubled = load(spark, d, "pixels").select("vec_id", F.concat("px", "px").alias("px"), F.lit(8).alias("width"))
    return pixels.coverage(doubled, "vec_id", "px", "width")


def pixel_contrast(spark, d):
    return pixels.contrast(load(spark, d, "pixels"), "vec_id", "px")


def _neighbours(spark, d):
    px = load(spark, d, "pixels")
    return px.join(px.select((C("vec_id") - 1).alias("vec_id"), C("px").alias("other")), "vec_id")


def image_similarity(spark, d):
    return pixels.compared(_neighbours(spark, d), "px", "other", ["vec_id"])


def window_similarity(spark, d):
    tiled = _neighbours(spark, d).withColumn("width", F.lit(16)).withColumns({c: F.flatten(F.array_repeat(c, 4)) for c in ("px", "other")})
    return pixels.window_similarity(tiled, ["vec_id"], "px", "other", "width")


def image_features(spark, d):
    return pixels.image_features(load(spark, d, "pixels").withColumn("width", F.lit(8)), "vec_id", "px", "width")


QUERIES = {
    f.__name__: f for f in (
        trailing_variance, early_exit, plateau, quality_ceiling, zero_gain, credible_failure, small_improvements, moving_eta, psnr_to_ssim, mapping_quality,
        pixel_entropy, colour_diversity, colour_coverage, pixel_contrast, image_similarity, window_similarity, image_features,
    )
} | {f"best_{name}": _best(name) for name in strategies.STRATEGIES}

_T = f"WITH {ctes('trace')}"
_W = "PARTITION BY run_id ORDER BY iteration"


def _streak(condition: str, needed: int, column: str, source: str = "trace") -> str:
    """The first row that ends so many hits in a row."""
    return f"""h AS (SELECT *, coalesce({condition}, FALSE) AS hit FROM {source}), g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER ({_W}) AS island FROM h),
      s AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, island ORDER BY iteration) AS streak FROM g)
      SELECT run_id, min(iteration) FILTER (streak >= {needed}) AS {column} FROM s GROUP BY run_id"""


_D = f"d AS (SELECT *, score - lag(score) OVER ({_W}) AS delta FROM trace)"
_TRAIL = f"""v AS (SELECT *, CASE WHEN count(*) OVER ({_W} ROWS 2 PRECEDING) = 3 THEN var_pop(size / input_size) OVER ({_W} ROWS 2 PRECEDING) END AS variance,
  abs(size - lag(size) OVER ({_W})) / nullif(lag(size) OVER ({_W}), 0) AS change FROM trace)"""


def _choose(candidate: str, order: str, passed: str) -> str:
    return f"""{_T}, c AS (SELECT *, {passed} AS passed, row_number() OVER (PARTITION BY run_id ORDER BY {order}) AS n FROM trace WHERE {candidate})
      SELECT r.run_id, crf, size, round(ssim, 6) AS ssim, passed FROM (SELECT DISTINCT run_id FROM trace) r LEFT JOIN (SELECT * FROM c WHERE n = 1) c ON c.run_id = r.run_id"""


_SMALL, _GOOD = "size < input_size", "ssim >= 0.95e0"
_PX = f"WITH {ctes('pixels')}, x AS (SELECT vec_id, unnest(px) AS v FROM pixels), n AS (SELECT vec_id, v, count(*) AS n FROM x GROUP BY 1, 2)"

SQL = {
    "trailing_variance": f"{_T}, {_TRAIL} SELECT run_id, iteration, round(variance, 6) AS variance, round(change, 6) AS change FROM v",
    "early_exit": f"{_T}, {_TRAIL} SELECT run_id, min(iteration) FILTER (iteration >= 6 AND (variance < 1e-6 OR change < 0.005e0)) AS exit_iteration FROM v GROUP BY run_id",
    "plateau": f"{_T}, {_D}, {_streak('abs(delta) < 0.1e0', 3, 'plateau_at', 'd')}",
    "quality_ceiling": f"""{_T}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ssim DESC, iteration DESC) AS n, count(*) OVER (PARTITION BY run_id) AS m FROM trace)
      SELECT run_id, CASE WHEN m >= 3 THEN crf END AS crf, CASE WHEN m >= 3 THEN round(ssim, 6) END AS best FROM r WHERE n = 1""",
    "zero_gain": f"""{_T}, {_D}, h AS (SELECT *, coalesce(abs(delta) < 0.3e0, FALSE) AS hit FROM d), g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER ({_W}) AS island FROM h)
      SELECT run_id, max(c)::BIGINT AS longest FROM (SELECT run_id, island, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS c FROM g GROUP BY run_id, island) GROUP BY run_id""",
    "credible_failure": f"""{_T}, b AS (SELECT *, max(floor(score)) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM trace), {_streak('psnr < 34 AND floor(score) <= best', 3, 'credible_at', 'b')}""",
    "small_improvements": f"{_T}, b AS (SELECT *, lag(score) OVER ({_W}) AS before FROM trace), {_streak('(score - before) / nullif(before, 0) < 0.005e0', 2, 'stop_at', 'b')}",
    "moving_eta": f"""{_T} SELECT run_id, iteration, round(CASE WHEN iteration < 60 THEN avg(secs) OVER ({_W} ROWS 9 PRECEDING) * (60 - iteration) END, 6) AS eta_secs FROM trace""",
    "psnr_to_ssim": f"""{_T}, p AS (SELECT run_id, psnr, max(ssim) AS ssim FROM trace GROUP BY 1, 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY psnr) AS i, count(*) OVER (PARTITION BY run_id) AS m FROM p),
      u AS (SELECT event_id, run_id, psnr + 0.25e0 AS psnr FROM trace),
      q AS (SELECT t.event_id, t.run_id, t.psnr, greatest(least((SELECT count(*) FROM k WHERE k.run_id = t.run_id AND k.psnr < t.psnr), (SELECT max(m) FROM k WHERE k.run_id = t.run_id) - 1), 1) AS i FROM u t)
      SELECT q.event_id, round(a.ssim + (q.psnr - a.psnr) / (b.psnr - a.psnr) * (b.ssim - a.ssim), 6) AS predicted FROM q LEFT JOIN k a ON a.run_id = q.run_id AND a.i = q.i LEFT JOIN k b ON b.run_id = q.run_id AND b.i = q.i + 1""",
    "mapping_quality": f"{_T} SELECT run_id, round(CASE WHEN count(*) < 3 THEN 0.5e0 ELSE least(0.6e0 + least(count(*) / 20, 0.35e0), 0.95e0) END, 6) AS quality FROM trace GROUP BY 1",
    "pixel_entropy": f"{_PX}, p AS (SELECT vec_id, n / sum(n) OVER (PARTITION BY vec_id) AS p FROM n) SELECT vec_id, round(-sum(p * log2(p)), 6) AS entropy, 8e0 AS most, round(-sum(p * log2(p)) / 8, 6) AS ratio FROM p GROUP BY 1",
    "colour_diversity": f"{_PX} SELECT vec_id, count(DISTINCT v // 4) AS colours, round(least(count(DISTINCT v // 4) / least(count(*), 10000), 1), 6)::DOUBLE AS diversity FROM x GROUP BY 1",
    "colour_coverage": f"""{_PX}, r AS (SELECT *, row_number() OVER w AS k, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY vec_id) AS total FROM n WINDOW w AS (PARTITION BY vec_id ORDER BY n DESC, v)),
      c AS (SELECT vec_id, count(*) AS colours, min(k) FILTER (2 * run >= floor(2 * total * 0.85e0))::INT AS needed FROM r GROUP BY 1)
      SELECT *, CASE WHEN colours < 2 THEN 0e0 WHEN needed / colours < 0.05e0 THEN 0.85e0 WHEN needed / colours < 0.10e0 THEN 0.70e0 WHEN needed / colours < 0.20e0 THEN 0.50e0 WHEN needed / colours < 0.35e0 THEN 0.25e0 ELSE 0e0 END AS score FROM c""",
    "pixel_contrast": f"{_PX} SELECT vec_id, round(least(stddev_pop(v) / 80, 1), 6) AS contrast FROM x GROUP BY 1",
    "image_similarity": f"""WITH {ctes('pixels')}, j AS (SELECT a.vec_id, unnest(a.px) AS x, unnest(b.px) AS y FROM pixels a JOIN pixels b ON b.vec_id = a.vec_id + 1),
      s AS (SELECT vec_id, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS cov, avg((x - y) * (x - y)) AS mse FROM j GROUP BY 1)
      SELECT vec_id, round(10 * log10(65025 / mse), 6) AS psnr, round((2 * mx * my + 6.5025e0) * (2 * cov + 58.5225e0) / ((mx * mx + my * my + 6.5025e0) * (vx + vy + 58.5225e0)), 6) AS ssim FROM s""",
    "image_features": f"""WITH {ctes('pixels')}, p AS (SELECT vec_id, unnest(px)::BIGINT AS v, unnest(range(64)) AS k FROM pixels), g AS (SELECT vec_id, k // 8 AS y, k % 8 AS x, v FROM p),
      n AS (SELECT a.vec_id, a.y, a.x, a.v, max(b.v) FILTER (b.y = a.y AND b.x = a.x + 1) AS r, max(b.v) FILTER (b.y = a.y AND b.x = a.x - 1) AS l, max(b.v) FILTER (b.y = a.y + 1 AND b.x = a.x) AS d, max(b.v) FILTER (b.y = a.y - 1 AND b.x = a.x) AS u,
        stddev_pop(b.v) AS s, count(*) AS c FROM g a JOIN g b ON b.vec_id = a.vec_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY ALL)
      SELECT vec_id, round(least(3 * avg(CASE WHEN sqrt((r - l) * (r - l) + (d - u) * (d - u)) > 25 THEN 1e0 ELSE 0e0 END) FILTER (c = 9), 1), 6) AS edge_density, round(least(avg(s) FILTER (c = 9 AND y % 2 = 1 AND x % 2 = 1) / 80, 1), 6) AS texture_variance,
        round(least(avg(abs(4 * v - r - l - d - u)) FILTER (c = 9) / 100, 1), 6) AS sharpness, round(least(sum(abs(v - r) + abs(v - d)) FILTER (x < 7 AND y < 7) / (2 * count(*) FILTER (x < 7 AND y < 7)) / 30, 1), 6) AS noise_level FROM n GROUP BY vec_id""",
    "window_similarity": f"""WITH {ctes('pixels')}, j AS (SELECT a.vec_id, a.px || a.px || a.px || a.px AS x, b.px || b.px || b.px || b.px AS y FROM pixels a JOIN pixels b ON b.vec_id = a.vec_id + 1),
      g AS (SELECT i, k, exp(-((i - 5) * (i - 5) + (k - 5) * (k - 5)) / 4.5e0) AS e FROM (SELECT unnest(range(11)) AS i), (SELECT unnest(range(11)) AS k)), w AS (SELECT i, k, e / (SELECT sum(e) FROM g) AS w FROM g),
      o AS (SELECT r, c, (r + i) * 16 + c + k + 1 AS place, w FROM w, (SELECT unnest(range(6)) AS r), (SELECT unnest(range(6)) AS c)),
      m AS (SELECT vec_id, r, c, sum(w * x[place]) AS mx, sum(w * y[place]) AS my, sum(w * x[place] * x[place]) AS xx, sum(w * y[place] * y[place]) AS yy, sum(w * x[place] * y[place]) AS xy FROM j, o GROUP BY 1, 2, 3),
      s AS (SELECT vec_id, avg((2 * mx * my + 6.5025e0) * (2 * (xy - mx * my) + 58.5225e0) / ((mx * mx + my * my + 6.5025e0) * (xx - mx * mx + yy - my * my + 58.5225e0))) AS ssim FROM m GROUP BY 1)
      SELECT vec_id, round(ssim, 6) AS ssim, round(greatest(ssim, 0), 6) AS ms_ssim FROM s""",
    "best_size_only": _choose("TRUE", "crf DESC, size, ssim DESC", _SMALL),
    "best_quality_match": _choose("crf = initial_crf", "crf DESC, size, ssim DESC", _GOOD),
    "best_precise": _choose(_GOOD, "crf DESC, size, ssim DESC", _GOOD),
    "best_precise_compressed": _choose(_SMALL, "ssim DESC, crf DESC, size", _GOOD),
    "best_compress_only": _choose(f"{_SMALL} AND crf >= initial_crf", "crf, size, ssim DESC", _SMALL),
    "best_compress_quality": _choose(f"{_SMALL} AND crf >= initial_crf", "crf, size, ssim DESC", f"{_SMALL} AND {_GOOD}"),
}
