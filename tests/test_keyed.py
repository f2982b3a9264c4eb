"""Keyed tables: plans, commits, and what is read and written."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import store
from tessera.sources import keyed
from tessera.streaming import resume

SCHEMA = "content_hash string, algorithm_version int, created_at long, payload string"


def some_records(spark, n, version=1):
    return spark.range(n).select(
        F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.lit(version).alias("algorithm_version"), F.col("id").alias("created_at"), F.concat(F.lit("p"), "id").alias("payload")
    )


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def data_folders(spark, location):
    return {r["folder"] for r in keyed.manifest(spark, location).filter("bucket >= 0").collect()}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, tmp_path):
    location = str(tmp_path / "records")
    keyed.create(some_records(spark, 2_000), location, ["content_hash"], 16, low="created_at", options={"parquet.block.size": "8192", "parquet.page.row.count.limit": "50", "parquet.block.row.count.limit": "50"})
    return location


def test_round_trip_and_buckets(spark, table):
    assert rows(keyed.records(spark, table)) == rows(some_records(spark, 2_000)) and keyed.records(spark, table).columns == some_records(spark, 1).columns
    files = spark.read.parquet(f"{table}/data/*").select("_slot", keyed.bucket_of(["content_hash"], 16).alias("b"), "_metadata.file_path")
    assert files.filter("_slot <> b").count() == 0 and files.select("file_path").distinct().count() == 16
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        keyed.create(some_records(spark, 3), table, ["content_hash"], 16)


def test_lookup_does_not_shuffle_the_table(spark, table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        known = keyed.read(spark, table)
        probes = spark.range(100).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
        plan = plan_of(probes.join(known, "content_hash", "left"))
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        side = plan[plan.index("FileScan") - 200 :]
        assert "Exchange" not in side.split("FileScan")[0]
        index = spark.createDataFrame([("/a", 1, 1, 0, 0, "x")], "file_path string, mtime long, file_size long, ctime long, btime long, content_hash string")
        asked = spark.createDataFrame([("/a", 1, 1, 0, 0, "y")], index.schema)
        plan = plan_of(store.lookup(asked, index, known, F.lit(True)))
        for scan in plan.split("FileScan parquet")[:-1]:  # what stands on each scan of the table, up to the join
            assert "Exchange" not in scan.splitlines()[-1] and "Exchange" not in scan.splitlines()[-2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_point_reads_one_bucket_and_skips_row_groups(spark, table):
    wanted = some_records(spark, 2_000).filter("created_at = 77").first()["content_hash"]
    found = keyed.point(spark, table, {"content_hash": wanted})
    assert [r["created_at"] for r in found.collect()] == [77]
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    figure = lambda name: scan.metrics().get(name).get().value()
    read = figure("numOutputRows")
    assert figure("numFiles") == 1
    held = keyed.records(spark, table).filter(keyed.bucket_of(["content_hash"], 16) == F.pmod(F.hash(F.lit(wanted)), F.lit(16))).count()
    assert 0 < read < held, (read, held)
    assert keyed.point(spark, table, {"content_hash": "none"}).count() == 0


def test_ten_keys_write_at_most_ten_buckets(spark, table):
    before = data_folders(spark, table)
    changes = some_records(spark, 10, 2).withColumn("created_at", F.lit(5_000).cast("long")).unionByName(some_records(spark, 10, 3).withColumn("created_at", F.lit(4_000).cast("long")))
    assert keyed.put(changes, table, ["created_at"]) == 1
    after = data_folders(spark, table)
    assert 1 <= len(after - before) <= 10 and len(after) == 16
    expected = store.upsert(some_records(spark, 2_000), changes, ["content_hash"], ["created_at"])
    assert rows(keyed.records(spark, table)) == rows(expected)
    assert rows(keyed.records(spark, table, 0)) == rows(some_records(spark, 2_000))
    assert keyed.put(changes.limit(0), table, ["created_at"]) is None and keyed.current_version(spark, table) == 1


def test_a_batch_that_fails_leaves_the_table(spark, table):
    boom = F.udf(lambda x: 1 // 0, "long")
    with pytest.raises(Exception, match="ZeroDivisionError|division"):
        keyed.put(some_records(spark, 50, 9).withColumn("created_at", boom("created_at")), table, ["created_at"])
    assert keyed.current_version(spark, table) == 0 and rows(keyed.records(spark, table)) == rows(some_records(spark, 2_000))
    spark.range(1).write.parquet(f"{table}/data/keyed_half/_slot=3")  # what a writer left that was lost half-way
    assert keyed.remove_unreferenced(spark, table) >= 1
    assert rows(keyed.records(spark, table)) == rows(some_records(spark, 2_000))


def test_expiry_reads_only_buckets_with_old_rows(spark, table):
    assert keyed.expire(spark, table, 0) is None
    before = data_folders(spark, table)
    assert keyed.expire(spark, table, 3) == 1
    assert 1 <= len(data_folders(spark, table) - before) <= 3
    assert rows(keyed.records(spark, table)) == rows(some_records(spark, 2_000).filter("created_at >= 3"))


def test_vacuum_packs_buckets_and_removes_versions(spark, table):
    for version in (2, 3):
        keyed.put(some_records(spark, 40, version), table, ["algorithm_version"])
    expected = rows(keyed.records(spark, table))
    sizes = [r["bytes"] for r in keyed.manifest(spark, table).filter("bucket >= 0").collect()]
    target = sum(sizes) // 4 + 1
    assert keyed.packed_buckets(sum(sizes), 16, target) == 4 and keyed.packed_buckets(10, 12, 1000) == 3 and keyed.packed_buckets(10**9, 8, 1) == 8
    assert keyed.vacuum(spark, table, target) > 0
    assert rows(keyed.records(spark, table)) == expected and len(data_folders(spark, table)) == 4
    live = {r["folder"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{table}/data").select(F.regexp_extract("path", "(.*)/", 1).alias("folder")).collect()}
    assert {f.rpartition("/data/")[2] for f in live} == {f.rpartition("/data/")[2] for f in data_folders(spark, table)}
    assert keyed.vacuum(spark, table, target) == 0
    keyed.put(some_records(spark, 5, 7), table, ["algorithm_version"])
    assert keyed.records(spark, table).filter("algorithm_version = 7").count() == 5


def test_empty_tables_and_null_keys(spark, tmp_path):
    location = str(tmp_path / "t")
    keyed.create(spark.createDataFrame([], SCHEMA), location, ["content_hash"], 4)
    assert keyed.records(spark, location).count() == 0 and keyed.current_version(spark, f"{location}-none") is None
    keyed.put(spark.createDataFrame([(None, 1, 1, "a"), ("x", 1, 1, "b"), ("x", 2, 2, "c")], SCHEMA), location, ["created_at"])
    assert rows(keyed.records(spark, location)) == [("x", 2, 2, "c"), (None, 1, 1, "a")] or rows(keyed.records(spark, location)) == [(None, 1, 1, "a"), ("x", 2, 2, "c")]
    with pytest.raises(ValueError, match="no keyed table"):
        keyed.read(spark, f"{location}-none")


def test_stream_puts_new_files_once(spark, tmp_path):
    source, out, seen = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "seen")
    schema = "path string, size long, seq long"

    def run(progress):
        query = resume.upsert_new(resume.new_rows(spark, str(source), schema), out, ["path"], ["seq"], progress, 4)
        query.awaitTermination(60)
        assert query.exception() is None
        return sorted((r["path"], r["size"]) for r in keyed.records(spark, out).collect())

    for new in [[("a", 1, 1), ("b", 1, 2)], [("a", 2, 3)], []]:
        if new:
            spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(str(source))
        last = run(seen)
    assert last == [("a", 2), ("b", 1)] and keyed.current_version(spark, out) == 1
    spark.createDataFrame([("c", 5, 4)], schema).coalesce(1).write.mode("append").parquet(str(source))
    assert run(f"{seen}-lost") == [("a", 2), ("b", 1), ("c", 5)]  # batch 0 again: the table isn't emptied


def test_streamed_upserts_keep_the_last_of_all_files(spark, tmp_path):
    """A file that comes later may hold an earlier row."""
    source, out, schema = tmp_path / "source", str(tmp_path / "table"), "path string, size long, seq long"
    for new in [[("a", 1, 5), ("b", 1, 2), (None, 1, 9)], [("a", 2, 3), ("b", 2, 4), (None, 2, 8)]]:
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(str(source))
        resume.upsert_new(resume.new_rows(spark, str(source), schema), out, ["path"], ["seq"], str(tmp_path / "seen"), 4).awaitTermination(60)
    assert {(r["path"], r["size"], r["seq"]) for r in keyed.records(spark, out).collect()} == {("a", 1, 5), ("b", 2, 4), (None, 1, 9)}
    assert keyed.records(spark, out).count() == 3
