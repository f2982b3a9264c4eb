"""Snapshots that are refreshed, ordered logs, sources that are valid as a whole, and arrays that many tasks read."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog, checkpoint
from tessera.sources import files, logs, probe, snapshots


def put(path, size=1):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"x" * size)


def names(frame, root):
    return sorted((os.path.relpath(r["path"], root), r["size"]) for r in frame.collect())


def test_only_changed_directories_are_read_again(spark, tmp_path):
    root = tmp_path / "lib"
    for name in ("a.jpg", "one/b.png", "one/deep/c.heic", "two/d.jpg", "two/e.txt", "three/f.gif"):
        put(root / name)
    (root / "empty").mkdir()
    snapshot = snapshots.Snapshot(spark, str(root), str(tmp_path / "snap"), parts=8)
    relative = lambda f: {os.path.relpath(r["directory"], root) for r in f.collect()}
    assert relative(snapshot.refresh()) == {".", "one", "one/deep", "two", "three", "empty"}
    assert names(snapshot.files(), root) == [("a.jpg", 1), ("one/b.png", 1), ("one/deep/c.heic", 1), ("three/f.gif", 1), ("two/d.jpg", 1)]
    assert [os.path.relpath(r["path"], root) for r in snapshot.queue().collect()][:2] == ["one/deep/c.heic", "two/d.jpg"]
    assert relative(snapshot.refresh()) == set() and snapshot.version() == 1
    stamp = {d: os.stat(d).st_mtime_ns for d, _, _ in os.walk(snapshot.folder + "/files") if "part=" in d}

    put(root / "two" / "new.webp", 5)
    put(root / "one" / "deep" / "fresh" / "g.jpg", 2)
    (root / "three" / "f.gif").unlink()
    before = os.stat(root / "one").st_mtime_ns
    hidden = root / "one" / "h.jpg"
    hidden.write_bytes(b"x")
    os.utime(root / "one", ns=(before, before))  # one's time is what it was: it isn't looked into again
    assert relative(snapshot.refresh()) == {"two", "one/deep", "one/deep/fresh", "three"}
    expected = [("a.jpg", 1), ("one/b.png", 1), ("one/deep/c.heic", 1), ("one/deep/fresh/g.jpg", 2), ("two/d.jpg", 1), ("two/new.webp", 5)]
    assert names(snapshot.files(), root) == expected
    touched = {f"part={r['p']}" for r in spark.createDataFrame([(str(root / d),) for d in ("two", "one/deep", "one/deep/fresh", "three")], "d string").select(snapshots.part_of(F.col("d"), 8).alias("p")).collect()}
    for folder, when in stamp.items():
        if os.path.basename(folder) not in touched:
            assert os.stat(folder).st_mtime_ns == when

    for name in ("one/deep/fresh/g.jpg",):
        (root / name).unlink()
    (root / "one" / "deep" / "fresh").rmdir()
    snapshot.refresh()
    assert names(snapshot.files(), root) == [e for e in expected if "fresh" not in e[0]]


def test_refreshed_rows(spark):
    old = spark.createDataFrame([("/a", "/a/1", 1), ("/b", "/b/1", 1), ("/gone", "/gone/1", 1)], "directory string, path string, size long")
    known = spark.createDataFrame([("/a", 1), ("/b", 1), ("/gone", 1)], "directory string, mtime long")
    current = spark.createDataFrame([("/a", 1), ("/b", 2), ("/new", 5)], "directory string, mtime long")
    listed = spark.createDataFrame([("/b", "/b/2", 2), ("/new", "/new/1", 1), ("/a", "/a/ignored", 9)], old.schema)
    assert sorted(r["path"] for r in snapshots.refreshed(old, known, current, listed).collect()) == ["/a/1", "/b/2", "/new/1"]
    assert snapshots.refreshed(old.limit(0), known.limit(0), current, listed.limit(0)).count() == 0


ENTRY = {"kind": "entry", "path": "/p", "size": 0, "mtime": 1, "ctime": 1, "btime": 1}


def test_log_order_of_files_of_different_sizes(spark, tmp_path):
    number = 0
    for name, count in (("part-0001", 2), ("part-0002", 50), ("part-0003", 1), ("part-0004", 400)):
        with open(tmp_path / name, "w") as out:
            for _ in range(count):
                out.write(json.dumps(ENTRY | {"path": f"/{number % 7}", "size": number}) + "\n")
                number += 1
    for limit in ("700", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        try:
            log = probe.checkpoint_log(spark, str(tmp_path))
            assert [r["size"] for r in log.orderBy("seq").collect()] == list(range(number))
            assert sorted(r["size"] for r in checkpoint.latest(log).collect()) == list(range(number - 7, number))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_torn_legacy_and_blank_lines(spark, tmp_path):
    head = {"kind": "header", "format_version": 1}
    (tmp_path / "log").write_text(json.dumps(head) + "\n\n  \n" + json.dumps(ENTRY) + "\n/old/bare path.jpg\n" + json.dumps(ENTRY | {"size": 9}) + '\n{"kind": "entry", "path": "/q", "si')
    rows = probe.checkpoint_log(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["kind"], r["path"], r["size"]) for r in rows] == [("header", None, None), ("entry", "/p", 0), ("legacy", "/old/bare path.jpg", None), ("entry", "/p", 9), ("broken", None, None)]
    assert [r["size"] for r in checkpoint.latest(probe.checkpoint_log(spark, str(tmp_path))).collect()] == [9]


def test_generations(spark, tmp_path):
    location = str(tmp_path)
    assert logs.read_log(spark, location).count() == 0
    schema = "kind string, path string, size long, mtime long, ctime long, btime long, format_version int, seq long"
    for turn in range(3):
        rows = [("header", None, None, None, None, None, turn, 0)] + [("entry", f"/{k}", turn * 100 + k, 1, 1, 1, None, k + 1) for k in range(20)]
        logs.append_log(spark.createDataFrame(rows, schema).repartition(5), location)
    read = lambda: [(r["kind"], r["path"], r["size"]) for r in logs.read_log(spark, location).orderBy("seq").collect()]
    assert len(read()) == 63 and [r[2] for r in read() if r[1] == "/3"] == [3, 103, 203]
    assert logs.compact_log(spark, location) == 1
    assert len(read()) == 21 and {r for r in read() if r[0] == "entry"} == {("entry", f"/{k}", 200 + k) for k in range(20)}
    logs.append_log(spark.createDataFrame([("entry", "/3", 999, 1, 1, 1, None, 1)], schema), location)
    (tmp_path / "generation=000000000002" / logs.COMPACTED).mkdir(parents=True)  # a compaction that was lost half-way
    assert [r[2] for r in read() if r[1] == "/3"] == [203, 999]


def test_files_count_as_a_whole_or_not_at_all(spark, tmp_path):
    (tmp_path / "good").write_bytes("/a\n\n /é \n/a\n".encode())
    (tmp_path / "bad").write_bytes(b"/x\n" * 500 + b"/y\xff\n" + b"/z\n" * 500)
    (tmp_path / "more").write_bytes(b"/b\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        assert sorted(r["path"] for r in files.read_paths(spark, str(tmp_path)).collect()) == ["/a", "/b", "/é"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_cache_documents(spark):
    good = json.dumps({"capacity": 2, "entries": [["a", {"value": 1}], ["b", {"value": [1, 2]}], ["c", {"value": None}]]}, indent=2)
    docs = spark.createDataFrame([(good,), (good[:-1],), ('{"entries": 3}',), ("",), (None,)], "json string")
    rows = [(r["key"], json.loads(r["e"])) for r in logs.cache_entries(docs).select("key", F.to_json("entry").alias("e"), "place").orderBy("place").collect()]
    assert rows == [("b", {"value": [1, 2]}), ("c", {"value": None})]
    assert logs.cache_entries(docs, capacity=9).count() == 3


def metadata(rng, n):
    odd = ['he said "hi"', "back\\slash", "end\\", 'x"SourceFile": {"', "}, {", "]", "日本\n語", "", "[{"]
    return [
        {"SourceFile": f"/d/{k} {rng.choice(odd)}.jpg", "ExifIFD:DateTimeOriginal": rng.choice(odd), "XMP-xmpMM:HistoryWhen": [rng.choice(odd), "x"], "Other": {"a": [1, {"b": rng.choice(odd)}]}}
        for k in range(n)
    ]


def test_one_array_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    read = lambda f: sorted(map(repr, f.collect()))
    for k, (n, text) in enumerate([(60, dict(indent=2)), (60, dict(separators=(",", ":"))), (1, dict()), (0, dict())]):
        place = tmp_path / f"m{k}"
        place.write_text(json.dumps(metadata(rng, n), ensure_ascii=False, **text), encoding="utf-8")
        whole = read(probe.exif_records(spark.read.text(str(place), wholetext=True), "value"))
        assert len(whole) == n
        for size in ("137", "1000") if n > 1 else ("1000",):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            try:
                found = probe.exif(spark, str(place))
                if n > 1:
                    assert spark.read.option("lineSep", probe.RECORD_KEY).text(str(place)).rdd.getNumPartitions() > 5
                assert read(found) == whole
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", [
    '[{"SourceFile": "/a", "Tag": "SourceFile"}, {"SourceFile": "/b"}]', '[{"Tag": 1, "SourceFile": "/a"}, {"SourceFile": "/b"}]',
    '[{"SourceFile": "/a", "Parts": [{"x": 1}, {"SourceFile": "/n"}]}, {"SourceFile": "/b"}]', '{"SourceFile": "/a"}', '[{"SourceFile": "/a"}', "not json", "",
])
def test_arrays_of_another_form_are_read_whole(spark, tmp_path, text):
    (tmp_path / "odd").write_text(text)
    (tmp_path / "plain").write_text('[{"SourceFile": "/p"}]')
    whole = sorted(map(repr, probe.exif_records(spark.read.text(str(tmp_path), wholetext=True), "value").collect()))
    assert sorted(map(repr, probe.exif(spark, str(tmp_path)).collect())) == whole


def test_snapshot_keys_of_queues(spark, tmp_path):
    put(tmp_path / "a" / "v.mp4", 3)
    snapshot = snapshots.Snapshot(spark, str(tmp_path / "a"), str(tmp_path / "s"), probe=snapshots.video_keys)
    snapshot.refresh()
    assert [(r["size"], r["relative_depth"]) for r in snapshot.files().collect()] == [(3, 0)]
    assert catalog.sort_files(snapshot.files(), "name").count() == 1
