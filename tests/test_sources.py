import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.operators import classify, pixels
from tessera.sources import files, magic, probe


def png(*chunks):
    out = b"\x89PNG\r\n\x1a\n"
    for name, data in chunks:
        out += struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return out


def gif(palette_bits=3, frames=3, vendor=b"NETSCAPE2.0"):
    out = b"GIF89a" + struct.pack("<HH", 10, 10) + bytes([0x80 | palette_bits, 0, 0]) + bytes(3 * (2 << palette_bits))
    out += b"\x21\xff\x0b" + vendor + b"\x03\x01\x00\x00\x00"
    for _ in range(frames):
        out += b"\x21\xf9\x04\x00\x32\x00\x00\x00" + b"\x2c" + bytes(9) + b"\x02\x02\x4c\x01\x00"
    return out + b";"


def test_scan_snapshot_and_lists(spark, tmp_path):
    root = tmp_path / "lib" / "a"
    root.mkdir(parents=True)
    (root / "x.JPG").write_bytes(b"12345")
    (root / "y.txt").write_bytes(b"1")
    found = files.scan(spark, str(tmp_path / "lib"), ["jpg"], content=True)
    rows = files.hashed(found).collect()
    assert [(r["size"], r["data_checksum"]) for r in rows] == [(5, zlib.crc32(b"12345"))]
    key = files.snapshot_key("r", "image", True, ["PNG", "jpg"])
    assert key == files.snapshot_key("r", "image", True, ["jpg", "png", "JPG"])
    files.write_snapshot(files.scan(spark, str(tmp_path / "lib")), str(tmp_path / "snap"), key)
    assert files.read_snapshot(spark, str(tmp_path / "snap"), key).count() == 2
    files.write_paths(spark.createDataFrame([("a",), ("a",), ("b",)], "path string"), str(tmp_path / "list"))
    assert sorted(r["path"] for r in files.read_paths(spark, str(tmp_path / "list")).collect()) == ["a", "b"]
    table = spark.createDataFrame([(1, "x"), (2, "y")], "id int, k string")
    for kind in ("parquet", "orc", "json", "csv"):
        options = {"header": "true", "inferSchema": "true"} if kind == "csv" else {}
        if kind == "csv":
            table.write.csv(str(tmp_path / kind), header=True)
        else:
            files.write_table(table, str(tmp_path / kind), kind)
        assert files.read_table(spark, str(tmp_path / kind), kind, **options).count() == 2


@pytest.mark.parametrize(("head", "expected"), [
    (b"\x89PNG\r\n\x1a\n", "PNG"), (b"\xff\xd8\xff\xe0", "JPEG"), (b"GIF89a", "GIF"), (b"RIFF\0\0\0\0WEBP", "WebP"), (b"\0\0\0\x20ftypavif", "AVIF"), (b"\0\0\0\x20ftypheix", "HEIC"),
    (b"\0\0\0\x20ftypmif1\0\0\0\0avif", "AVIF"), (b"\0\0\0\x20ftypisom", "Unknown"), (b"\xff\x0a", "JXL"), (b"II*\0", "TIFF"), (b"BM", "BMP"), (b"qoif", "QOI"), (b"\0\0\1\0", "ICO"), (b"text", "Unknown"),
])
def test_image_format(spark, head, expected):
    frame = spark.createDataFrame([(bytearray(head.ljust(40, b" ")),), (bytearray(head[:4]),)], "content binary")
    assert [r[0] for r in frame.select(magic.image_format(F.col("content"))).collect()] == [expected, None]


def test_byte_walkers(spark):
    assert magic.chunk_counts(png((b"IHDR", bytes(13)), (b"acTL", bytes(8)), (b"IDAT", b"IDAT"), (b"IDAT", b"x"), (b"IEND", b""))) == {"IDAT": 2, "acTL": 1, "fcTL": 0, "ANIM": 0, "ANMF": 0, "VP8L": 0}
    figures = magic.gif_figures(gif())
    assert figures == {"palette": 16, "frames": 3, "vendors": ["NETSCAPE2.0"], "duration": 1.5}
    assert magic.gif_figures(gif()[:60])["palette"] == 16
    inner = struct.pack(">I", 12) + b"av1C" + b"abcd"
    outer = struct.pack(">I", 8 + len(inner)) + b"ipco" + inner
    assert magic.boxes(outer, "av1C") == [b"abcd"] and magic.boxes(b"", "x") == []
    zigzag_start = [0, 1, 8, 16, 9, 2]
    table = bytes(range(1, 65))
    jpeg = b"\xff\xd8\xff\xdb" + struct.pack(">H", 67) + b"\x00" + table + b"\xff\xda"
    assert [magic.jpeg_tables(jpeg)[0].index(v) for v in range(1, 7)] == zigzag_start
    frame = spark.createDataFrame([("a", bytearray(gif())), ("b", None), ("c", bytearray(jpeg))], "path string, content binary")
    got = {r["path"]: r for r in magic.byte_figures(frame).collect()}
    assert got["a"]["frames"] == 3 and got["b"]["palette"] is None and got["c"]["quant_table"][0] == 1


def test_probe_json(spark):
    document = {
        "format": {"format_name": "mov,mp4", "duration": "12.5", "bit_rate": "1000"},
        "streams": [
            {"codec_type": "audio", "codec_name": "aac", "bit_rate": "128000"},
            {"codec_type": "video", "codec_name": "mjpeg", "width": 1, "height": 1, "nb_frames": "1"},
            {"codec_type": "video", "codec_name": "hevc", "width": 1920, "height": 1080, "pix_fmt": "yuv420p10le", "r_frame_rate": "60/1", "avg_frame_rate": "30000/1001", "nb_frames": "300",
             "side_data_list": [{"a": "1", "b": "2"}, {"a": "3"}], "tags": {"x": "y"}},
        ],
    }
    frame = spark.createDataFrame([(json.dumps(document),), ("not json",), ("{}",), (None,)], "json string")
    first, *rest = probe.parsed_probe(frame).collect()
    assert (first["codec"], first["width"], first["bit_depth"], first["duration"], first["audio_codec"]) == ("hevc", 1920, 10, 12.5, "aac")
    assert abs(first["fps"] - 29.97) < 0.01 and first["side_data"] == {"a": "3", "b": "2"} and first["has_audio"]
    assert all(r["codec"] is None and not r["has_audio"] for r in rest)


def test_text_sources(spark, tmp_path):
    (tmp_path / "exif.json").write_text(json.dumps([{"SourceFile": "/a", "FileName": "a", "ExifIFD:DateTimeOriginal": "2020:01:01 00:00:00"}, {"SourceFile": "/b", "XMP-xmp:CreateDate": "-"}]))
    rows = {r["path"]: r for r in probe.exif(spark, str(tmp_path / "exif.json")).collect()}
    assert rows["/a"]["exif_original"].startswith("2020") and rows["/b"]["xmp_created"] == "-" and rows["/b"]["xmp_history"] is None
    logs = spark.createDataFrame([("Succeeded: 3\nFailed: 1\nSucceeded: 5",), ("nothing",)], "text string")
    assert [(r["succeeded"], r["skipped"], r["failed"]) for r in probe.run_counts(logs).collect()] == [(5, 0, 1), (0, 0, 0)]
    side = probe.sidecar_text(spark.createDataFrame([("id\n\nsrc",)], "text string")).first()
    assert (side["document_id"], side["derived_from"], side["source"]) == ("id", None, "src")
    assert [r["line"] for r in probe.merged_logs([logs.limit(1), logs.filter("text = 'nothing'")]).collect()][-1] == "nothing"
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "p.jsonl").write_text('{"kind":"header","format_version":1}\n{"kind":"entry","path":"/a","size":1}\n{"kind":"entry","path":"/a","size":2}\n')
    log = probe.checkpoint_log(spark, str(tmp_path / "log")).orderBy("seq").collect()
    assert [r["size"] for r in log] == [None, 1, 2]


def test_text_functions(spark):
    frame = spark.createDataFrame([("1-02:03:04", "30000/1001", "SSIM All:0.98 x"), ("03:04", "25", "PSNR average:inf"), ("x", "1/0", "")], "e string, r string, m string")
    got = frame.select(text.elapsed_secs(F.col("e")), text.rational(F.col("r")), text.metric(F.col("m"), "All"), text.metric(F.col("m"), "average"), text.truncated(F.col("m"), 6)).collect()
    assert [r[0] for r in got] == [93784, 184, None] and got[1][1] == 25 and got[2][1] is None
    assert got[0][2] == 0.98 and got[1][3] == float("inf") and got[0][4] == "SSI..."
    shown = spark.createDataFrame([(500,), (2048,), (5 * 1024**2,), (3 * 1024**3,)], "n long").select(text.bytes_text(F.col("n"))).collect()
    assert [r[0] for r in shown] == ["500 B", "2.00 KB", "5.00 MB", "3.00 GB"]
    p = spark.createDataFrame([("/a\\\\b//c.mp4",)], "p string").select(paths.normalised(F.col("p")), paths.converted(F.lit("/a/c.mp4"), "MP4")).first()
    assert tuple(p) == ("/a/b/c.mp4", "/a/c_hevc.MP4")


def test_halves_of_byte_texts_go_to_the_even(spark):
    """x.xx5 units exactly, as the C library and DuckDB write them."""
    shown = spark.createDataFrame([(181_376,), (181_377,), (1_024 + 384,), (2**20 + 2**17,), (2**30 + 3 * 2**27,)], "n long").select(text.bytes_text(F.col("n"))).collect()
    assert [r[0] for r in shown] == ["177.12 KB", "177.13 KB", "1.38 KB", "1.12 MB", "1.38 GB"]


def test_windows_of_pixels():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 255, (40, 40)).astype(float)
    assert abs(pixels.window_ssim(a, a) - 1) < 1e-9 and abs(pixels.multi_scale_ssim(a, a) - 1) < 1e-9
    noisy = np.clip(a + rng.normal(0, 40, a.shape), 0, 255)
    assert pixels.window_ssim(a, noisy) < 0.95 and pixels.window_ssim(a[:5, :5], a[:5, :5]) == pytest.approx(1)
    assert pixels.window_ssim(a, a[:10]) is None and pixels.neighbourhood(np.stack([a[:2]] * 3, axis=2))["sharpness"] == 0
    assert pixels.neighbourhood(np.zeros((9, 9, 3)))["edge_density"] == 0


def test_dithering():
    import numpy as np

    flat = np.full((20, 20, 3), 120)
    board = flat.copy()
    board[::2, ::2] = board[1::2, 1::2] = 140
    assert pixels.dithering(flat) == 0.0 and pixels.dithering(board) == 1.0 and pixels.dithering(flat[:4]) == 0.0
    assert pixels.perceived_difference(np.array([0.0, 0, 0]), np.array([0.0, 10, 0])) == 20.0


def test_rules_are_read(spark):
    rules = {r["name"]: r for r in classify.classifier_rules(spark).collect()}
    assert len(rules) == 14 and rules["ICON"]["width_high"] == 512.0 and rules["ICON"]["has_alpha"] and rules["MEME"]["color_diversity_low"] == 0.2


def test_large_images_are_sampled(spark):
    many = [(k * 7919 >> 3) % 256 for k in range(120_000)]
    images = spark.createDataFrame([(1, many, 400), (2, many * 10, 400), (3, [1, 2] * 30, 10), (4, [], 10), (5, None, 10)], "id long, px array<int>, width int")
    colours = {r["id"]: r for r in pixels.distinct_colours(images, "id", "px").collect()}
    contrast = {r["id"]: r["contrast"] for r in pixels.contrast(images, "id", "px").collect()}
    for key, taken in ((1, many[::10]), (2, (many * 10)[::20]), (3, [1, 2] * 30)):
        mean = sum(taken) / len(taken)
        assert colours[key]["colours"] == len({v // 4 for v in taken}) and abs(contrast[key] - min((sum((v - mean) ** 2 for v in taken) / len(taken)) ** 0.5 / 80, 1)) < 1e-9
    covered = {r["id"]: r for r in pixels.coverage(images, "id", "px", "width").collect()}
    picked = [many[y * 400 + x] for y in range(1, 300, 2) for x in range(1, 400, 2)]
    counts = sorted((picked.count(v) for v in set(picked)), reverse=True)
    needed = next(k for k in range(1, len(counts) + 1) if sum(counts[:k]) >= int(len(picked) * 0.85))
    assert (covered[1]["colours"], covered[1]["needed"]) == (len(counts), needed)
    assert covered[3]["score"] == 0.0 and covered[3]["colours"] == 2
    assert (covered[4]["colours"], covered[4]["needed"], contrast[4], contrast[5], colours[5]["colours"]) == (0, None, 0.0, None, None)


def test_partial_names_match_brute_force(spark):
    from tessera.operators import matching

    names = ["IMG_0001", "IMG_00012", "IMG_0001 (1)", "IMG_0002", "xIMG_0001", "日本語の写真", "日本語の写真x", "abc", "a" * 10, "a" * 14, "a" * 15]
    media = spark.createDataFrame([(f"/d/{n}.jpg", None, None) for n in names], "path string, document_id string, xmp_ref string")
    sides = spark.createDataFrame([(f"/d/{n}.xmp", None, None, None) for n in names + ["IMG_000", "zz"]], "xmp_path string, document_id string, derived_from string, source string")
    got = {(r["xmp_path"], r["path"]) for r in matching.sidecar_candidates(sides, media).filter("rank = 7").groupBy("xmp_path").agg(F.min("path").alias("path")).collect()}
    expected = set()
    for x in names + ["IMG_000", "zz"]:
        size = lambda s: len(s.encode())
        held = [m for m in names if size(x) >= 4 and (x in m or m in x) and min(size(x), size(m)) * 100 // max(size(x), size(m)) >= 70]
        if held:
            expected.add((f"/d/{x}.xmp", min(f"/d/{m}.jpg" for m in held)))
    assert got == expected
