import random

from pyspark.sql import functions as F

from tessera import values as V
from tessera.operators import catalog, checkpoint, classify, interpolate, matching, runs, store
from tessera.plans import registry
from tessera.sources import variants

RECORD = "content_hash string, created_at long, algorithm_version int"


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], RECORD)
    new = spark.createDataFrame([("a", 5, 2), ("a", 4, 9), ("c", 1, 3)], RECORD)
    got = store.upsert(old, new, ["content_hash"], ["created_at"]).collect()
    assert sorted(map(tuple, got)) == [("a", 5, 2), ("b", 1, 1), ("c", 1, 3)]
    assert store.upsert(old.limit(0), new.limit(0), ["content_hash"], ["created_at"]).count() == 0


def test_evict_below_limit_and_of_few(spark):
    tables = {k: spark.createDataFrame([(k + str(i), i, 1) for i in range(3)], RECORD) for k in store.TABLES}
    index = spark.createDataFrame([("/p", "analysis0"), ("/q", "video2")], "file_path string, content_hash string")
    assert store.evict(tables, index, 5, 10)[1] is index
    kept, paths = store.evict(tables, index, 10, 10)
    assert [kept[k].count() for k in store.TABLES] == [2, 2, 2] and [r["file_path"] for r in paths.collect()] == ["/q"]


def test_queue_orders(spark):
    rows = [("/r/root.png", 32 * 32, 10), ("/r/nested/nested.jpg", 48 * 48, 10), ("/r/nested/deeper/deeper.png", 24 * 24, 10), ("/r/nested/deeper/deeper.jpg", 12 * 12, 10)]
    got = catalog.image_queue(spark.createDataFrame(rows, "path string, pixel_count long, size long"), "/r").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in got] == ["deeper.jpg", "deeper.png", "nested.jpg", "root.png"]
    files = spark.createDataFrame([("large.txt", 1000), ("small.txt", 100), ("medium.txt", 500), ("gone.txt", None)], "path string, size long")
    assert [r["path"][0] for r in catalog.sort_files(files, "size_asc").collect()] == ["s", "m", "l"]
    assert [r["path"][0] for r in catalog.sort_files(files, "size_desc").collect()] == ["l", "m", "s"]
    assert [r["path"][0] for r in catalog.sort_files(files, "name").collect()] == ["g", "l", "m", "s"]


def test_ranks_over_many_partitions(spark):
    from pyspark.sql import functions as F

    files = spark.range(5000).select(F.format_string("/f%05d", (F.col("id") * 7919) % 5000).alias("path"), (F.col("id") % 13).alias("size"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = catalog.with_rank(files, [F.asc("size"), F.asc("path")]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = sorted((r["size"], r["path"]) for r in got)
    assert [(r["size"], r["path"]) for r in sorted(got, key=lambda r: r["rank"])] == expected
    assert sorted(r["rank"] for r in got) == list(range(1, 5001))


def test_empty_runs(spark):
    none = spark.createDataFrame([], "outcome string, input_size long, output_size long, status string")
    assert runs.batch_summary(none).first()["success_rate"] == 100.0
    assert runs.health(none).first()["rate"] == 100.0
    assert runs.bytes_summary(none, "video").first()["reduction"] == 0.0 and runs.bytes_summary(none, "image").first()["ratio"] == 1.0


def test_resume(spark):
    schema = "kind string, path string, size long, mtime long, ctime long, btime long, format_version int, target_dir string, output_root string, cache_algorithm_version int, cache_schema_version int, created_at long, seq long"
    header = ("header", None, None, None, None, None, 1, "/t", None, 1087, 3, 1, 0)
    entry = lambda path, size, seq: ("entry", path, size, 1, 1, 1, None, None, None, None, None, None, seq)
    log = spark.createDataFrame([header, entry("/a", 1, 1), entry("/b", 1, 2), entry("/b", 2, 3), entry("/c", 1, 4)], schema)
    files = spark.createDataFrame([("/a", 1, 1, 1, 1), ("/b", 1, 1, 1, 1), ("/d", 1, 1, 1, 1)], "path string, size long, mtime long, ctime long, btime long")
    expected = {"format_version": 1, "target_dir": "/t", "output_root": None, "cache_algorithm_version": 1087, "cache_schema_version": 3}
    assert sorted(r["path"] for r in checkpoint.resume(files, log, expected).collect()) == ["/b", "/d"]
    assert checkpoint.resume(files, log, expected | {"output_root": "/o"}).count() == 3
    assert checkpoint.compacted(log).count() == 4
    status = {r["path"]: r["status"] for r in checkpoint.validity(checkpoint.latest(log), files).collect()}
    assert status == {"/a": "valid", "/b": "changed", "/c": "missing"}


def test_interpolation(spark):
    points = spark.createDataFrame([(1, 30.0, 0.90), (1, 40.0, 0.95), (1, 50.0, 0.99), (2, 30.0, 0.9)], "run_id int, psnr double, ssim double")
    queries = spark.createDataFrame([(1, 40.0), (1, 35.0), (1, 60.0), (1, 20.0), (2, 30.0), (3, 1.0)], "run_id int, psnr double")
    got = {(r["run_id"], r["psnr"]): r["predicted"] for r in interpolate.predict(queries, points, ["run_id", "psnr"]).collect()}
    assert [round(got[1, x], 6) for x in (40.0, 35.0, 60.0, 20.0)] == [0.95, 0.925, 1.03, 0.85]
    assert got[2, 30.0] is None and got[3, 1.0] is None


def test_sidecars_of_special_names(spark):
    side = [("/d/photo.jpg.xmp",), ("/d/PHOTO2.XMP",), ("/d/ü ñ.xmp",), ("/d/none.xmp",), ("/d/IMG_1234ab.xmp",), ("/d/.xmp",)]
    media = [("/d/photo.jpg",), ("/d/photo2.jpg",), ("/d/ü ñ.raw",), ("/d/notes.txt",), ("/d/IMG_1234abc.dng",)]
    null = "cast(null as string)"
    s = spark.createDataFrame(side, "xmp_path string").selectExpr("xmp_path", f"{null} document_id", f"{null} derived_from", f"{null} source")
    m = spark.createDataFrame(media, "path string").selectExpr("path", f"{null} document_id", f"{null} xmp_ref")
    got = {r["xmp_path"]: (r["media_path"], r["strategy"]) for r in matching.sidecar_cascade(s, m).collect()}
    assert got["/d/photo.jpg.xmp"] == ("/d/photo.jpg", "direct_match") and got["/d/PHOTO2.XMP"] == ("/d/photo2.jpg", "same_name")
    assert got["/d/ü ñ.xmp"] == ("/d/ü ñ.raw", "same_name") and got["/d/none.xmp"] == (None, "no_match")
    assert got["/d/IMG_1234ab.xmp"] == ("/d/IMG_1234abc.dng", "partial_match")
    live = [("/d/a.HEIC",), ("/d/a.mov",), ("/d/b.heic",), ("/d/c.MOV",), ("/d/c.Heif",)]
    assert sorted(r["path"] for r in matching.live_photos(spark.createDataFrame(live, "path string")).collect()) == ["/d/a.HEIC", "/d/a.mov", "/d/c.Heif"]


def test_a_long_run_is_interpolated_in_parts(spark):
    """Runs of many, two, one and no points over several parts, against a search in plain Python."""
    import bisect
    import random

    rng = random.Random(2)
    points = [("long", rng.randrange(4000) / 4.0, rng.random()) for _ in range(600)] + [("two", 5.0, 0.5), ("two", 1.0, 0.1), ("two", 1.0, 0.3), ("one", 2.0, 0.9), (None, 1.0, 1.0), ("long", None, 0.4)]
    queries = [(k, run, x) for k, (run, x) in enumerate(
        [("long", rng.randrange(-200, 4800) / 4.0) for _ in range(800)] + [("two", x) for x in (0.0, 1.0, 3.0, 9.0)] + [("one", 2.0), ("none", 1.0), (None, 3.0), ("long", None)]
    )]
    expected = {}
    for k, run, x in queries:
        best = {}
        for by, px, py in points:
            if by == run and by is not None and px is not None:
                best[px] = max(best.get(px, py), py)
        xs = sorted(best)
        if x is None or len(xs) < 2:
            expected[k] = None
            continue
        b = min(max(bisect.bisect_left(xs, x), 1), len(xs) - 1)
        x0, x1 = xs[b - 1], xs[b]
        expected[k] = best[x0] + (x - x0) / (x1 - x0) * (best[x1] - best[x0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        asked = spark.createDataFrame(queries, "id long, run_id string, psnr double")
        known = spark.createDataFrame(points, "run_id string, psnr double, ssim double")
        assert interpolate._in_parts(known.withColumnRenamed("run_id", "_by").select("_by", F.col("psnr").alias("_x"), F.lit(1).alias("_kind"), F.struct(F.col("psnr").alias("x"), F.col("ssim").alias("y")).alias("_point"))).select("_part").distinct().count() > 3
        got = {r["id"]: r["predicted"] for r in interpolate.predict(asked, known, ["id"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.keys() == expected.keys()
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in expected.items())


def test_work_on_small_files_is_dealt_to_many_tasks(spark):
    """A file of few bytes is one task of a scan; the queries whose rows are much work deal them first."""
    queries, wanted = registry.queries(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("jpeg_quality", "jpeg_table_errors", "probe_variants", "gradient_banding"):
        assert queries[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == wanted, name


def test_paths_of_documents_are_counted_in_as_many_tasks_as_they_have(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(variants, "kind_of", lambda value, real=variants.kind_of: kept.append(1) or real(value))
    persisted = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    found = registry.queries()["probe_paths"](spark, "/root/testdata/sf0.001")
    assert len(kept) == 4 and found.count() == 15  # a pass for each level, none for the counts
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == persisted  # no level is left behind


def test_matches_pass_no_side_through_the_driver(spark):
    for name in ("sidecar_cascade", "sidecar_summary", "metadata_sidecars", "existing_sidecars", "live_photos", "tree_pairs", "timestamp_sources"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan, name


def test_nearest_table_matches_brute_force(spark):
    def scaled(q):
        scale = 5000.0 / q if q < 50 else 200.0 - 2.0 * q
        return [min(max(int((scale * v + 50.0) // 100.0), 1), 255) for v in V.JPEG_LUMINANCE]

    rng = random.Random(3)
    made = [scaled(q) for q in (1, 49, 50, 100)] + [[rng.randrange(1, 256) for _ in range(64)] for _ in range(20)] + [[v + rng.randrange(3) for v in scaled(rng.randrange(1, 101))] for _ in range(20)]
    odd = [None, [1] * 63, [None] + [1] * 63]
    rows = spark.createDataFrame(list(enumerate(made + odd)), "id long, table array<int>").repartition(3)
    got = {r["id"]: tuple(r)[1:] for r in classify.jpeg_quality(rows, "id").collect()}
    for k, table in enumerate(made):
        (a, p), (b, q) = sorted((float(sum((x - y) ** 2 for x, y in zip(table, scaled(q)))), q) for q in range(1, 101))[:2]
        lean = (1 if q > p else -1) * (a / (a + b)) * 0.5 if 0 < a < b else 0.0
        assert got[k] == (p, a, a == 0, p + lean)
    assert all(got[len(made) + k] == (1, None, None, 1.0) for k in range(3))
