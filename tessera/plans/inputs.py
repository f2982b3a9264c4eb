"""Stand-in rows made from the given tables, as one text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.lineage import spread_out

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def pick(key: str, *values) -> str:
    """One of the values by key modulo their number; strings, numbers, booleans and None."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else str(v)

    return f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {i} THEN {literal(v)}" for i, v in enumerate(values)) + " END"


EXTENSIONS = (".jpg", ".PNG", ".webp", ".heic", ".gif", ".tiff", ".mov", ".mp4", ".mkv", ".xmp", ".txt", "", ".jpeg", ".avif", ".svg", ".jxl", ".MOV", ".HEIC")
CODECS = (
    "h264", "libx264", "HEVC", "x265", "av1", "libaom-av1", "vp9", "libvpx", "vp8", "mpeg4", "msmpeg4v2", "mpeg2video", "mpeg1video", "wmv3", "theora", "rv40",
    "flv1", "vp6f", "prores", "dnxhd", "mjpeg", "Motion JPEG", "ffv1", "utvideo", "huffyuv", "rawvideo", "raw", "lagarith", "magicyuv", "gif", "apng", "JPEG XL",
    "avif", "heic", "webp anim", "webp", "jpeg", "png", "bmp", "tiff", "h266", "av2", "cinepak", "indeo", "unknown thing", "",
)
MESSAGES = (
    "No space left on device", "Output exists: x", "Skipped by rule", "ffmpeg failed with exit code 1", "file is corrupt", "metadata lost on the way",
    "Broken pipe", "please skip this", "something else", "assertion failed", "ENOSPC", "cjxl: could find no file",
)
SHA = "@sha@"

TEXT = {
    "files": f"""SELECT doc_id AS file_id,
        '/lib/' || source || CASE WHEN doc_id % 3 = 0 THEN '/' || lang ELSE '' END || '/' || CASE WHEN doc_id % 17 = 0 THEN '.' ELSE '' END
          || 'doc_' || CAST(doc_id AS STRING) || {pick('doc_id', *EXTENSIONS)} AS path,
        CASE WHEN doc_id % 29 = 0 THEN NULL ELSE n_chars END AS size,
        CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (16 + doc_id * 37 % 4000) * (16 + doc_id * 53 % 3000) END AS pixel_count,
        CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 700) / 10e0 END AS duration_secs,
        CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 24e0 + (doc_id % 4) * 12 END AS frame_rate,
        doc_id % 900 AS frame_count FROM documents""",
    "path_index": f"""SELECT CASE WHEN doc_id % 10 = 9 THEN '/moved/' ELSE '/lib/' END || source || '/doc_' || CAST(doc_id AS STRING) AS file_path, {SHA}(text) AS content_hash, doc_id * 1000 AS mtime, n_chars AS file_size,
        doc_id * 1000 AS atime, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id * 1000 + 5 END AS ctime, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE doc_id * 1000 + 7 END AS btime
        FROM documents""",
    "lookups": f"""SELECT '/lib/' || source || '/doc_' || CAST(doc_id AS STRING) AS file_path, {SHA}(text) AS content_hash,
        CASE WHEN doc_id % 8 = 0 THEN doc_id * 1000 + 1 ELSE doc_id * 1000 END AS mtime, n_chars AS file_size,
        CASE WHEN doc_id % 12 = 1 THEN 1 ELSE doc_id * 1000 + 5 END AS ctime, doc_id * 1000 + 7 AS btime FROM documents""",
    "analysis_records": f"""SELECT {SHA}(text) AS content_hash, max(n_chars) AS file_size, min(doc_id) * 60 + 1700000000 AS created_at,
        CAST(1086 + max(quality) + CASE WHEN min(doc_id) % 10 = 0 THEN 2 ELSE 0 END AS INT) AS algorithm_version,
        CASE WHEN min(doc_id) % 15 = 0 THEN NULL ELSE max(n_chars) % 97 END AS data_checksum, max(n_chars) % 97 + CASE WHEN min(doc_id) % 7 = 0 THEN 1 ELSE 0 END AS payload_checksum
        FROM documents JOIN labels USING (doc_id) GROUP BY {SHA}(text)""",
    "quality_records": f"""SELECT {SHA}(text) AS content_hash, max(n_chars) AS file_size, min(doc_id) * 61 + 1700000000 AS created_at,
        CAST(CASE WHEN min(doc_id) % 20 = 0 THEN NULL ELSE 1085 + min(doc_id) % 4 END AS INT) AS algorithm_version, max(n_chars) % 97 AS data_checksum,
        max(n_chars) % 97 + CASE WHEN min(doc_id) % 9 = 0 THEN 1 ELSE 0 END AS payload_checksum
        FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 GROUP BY {SHA}(text)""",
    "video_records": f"""SELECT {SHA}(text) AS content_hash, max(length(text)) AS file_size, min(item_id) * 63 + 1700000000 AS created_at,
        CAST(1086 + min(item_id) % 3 AS INT) AS algorithm_version, CAST(NULL AS BIGINT) AS data_checksum, max(length(text)) % 97 AS payload_checksum
        FROM benchmark GROUP BY {SHA}(text)""",
    "changes": f"""SELECT {SHA}(text) AS content_hash, n_chars AS file_size, doc_id * 60 + 1800000000 AS created_at, CAST(1087 AS INT) AS algorithm_version,
        n_chars % 97 AS data_checksum, n_chars % 97 AS payload_checksum, CASE WHEN doc_id % 3 > 0 OR doc_id % 13 = 0 THEN 'failed' END AS analysis_error FROM documents""",
    "probe": f"""SELECT p_partkey AS id, {pick('p_partkey', *CODECS)} AS codec,
        {pick('p_partkey', 0.0, 0.0, 0.0, 0.0, 0.15, 2.5, 0.04, 60.0, 0.001)} AS bpp,
        {pick('p_partkey', 640, 1280, 1920, 2560, 3840, 1080, 15, 1920, 0, 4000, 1280)} AS width, {pick('p_partkey', 480, 720, 1080, 1440, 2160, 1920, 15, 800, 10, 1000, 720)} AS height,
        {pick('p_partkey', 23.976, 24.0, 30.0, 50.0, 60.0, 240.0, 12000.0, 0.0, None, 2000.0)} AS fps, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE (p_partkey % 400) / 4e0 END AS duration,
        p_partkey * 7919 % 20000000 AS bitrate, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey * 7919 % 19000000 END AS video_bitrate,
        p_partkey * 104729 % 500000000 AS file_size, {pick('p_partkey', 8, 8, 10, 12, 16, 0, 9)} AS bit_depth, p_partkey % 2 = 0 AS has_b_frames,
        {pick('p_partkey', None, 0, 1, 2, 3)} AS b_frame_count, {pick('p_partkey', None, 1, 5, 30, 100, 250, 400, 0)} AS gop_size,
        {pick('p_partkey', None, 'yuv420p', 'yuv422p10le', 'yuv444p', 'rgb24', 'gbrp', 'NV12', 'gray', 'bgra', 'yuvj411p')} AS pix_fmt,
        {pick('p_partkey', None, 'bt709', 'bt2020nc', 'smpte170m')} AS color_space, {pick('p_partkey', None, True, False)} AS is_hdr,
        {pick('p_partkey', None, 'Animation', 'ScreenRecording', 'LiveAction', 'Gaming', 'FilmGrain', 'Unknown')} AS content_type,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 90) * 1e0 END AS spatial, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_partkey % 45) * 1e0 END AS temporal,
        {pick('p_partkey', None, True, False, False)} AS film_grain, {pick('p_partkey', None, 'veryslow', 'slow', 'medium', 'fast', 'ultrafast', '4', '12', 'x', '300')} AS preset,
        p_partkey % 5 = 0 AS has_alpha, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 101 END AS estimated_quality,
        {pick('p_partkey', None, 'crf=23:preset=slow', 'qp=18', 'x CRF 20.5 y', 'cqp=30', 'preset=Fast lossless=1', '', 'qp=0', 'crf=:qp=7', 'crf=300')} AS encoder_params FROM part""",
    "gifs": f"""SELECT p_partkey AS id, {pick('p_partkey', 'funny.gif', 'IMG_1234.gif', 'd41d8cd98f00b204e9800998ecf8427e.gif', '1699999999.gif', 'two words.gif', 'a-b_c d.gif', '笑い猫です.gif', None, '', '--.gif', 'one2three', '猫cat.gif', 'a b c d e.gif')} AS name,
        {pick('p_partkey', 90, 199, 320, 640, 1920, 2000, 0)} AS width, {pick('p_partkey', 90, 150, 240, 480, 1080, 1200, 5, 0, 300)} AS height,
        {pick('p_partkey', 0.0, 0.5, 0.9, 2.0, 5.0, 9.5, 20.0, 45.0)} AS duration, {pick('p_partkey', 0, 3, 10, 40, 200)} AS frames, p_partkey * 7919 % 3000000 AS size,
        {pick('p_partkey', None, 0, 2, 16, 33, 64, 100, 128, 200, 256)} AS palette, {pick('p_partkey', None, 'NETSCAPE2.0', 'GIPHY    ', 'TENORx', 'aSTICKER')} AS vendor FROM part""",
    "images": f"""SELECT p_partkey AS id, (p_partkey * 37 % 101) / 100e0 AS edge_density, (p_partkey * 53 % 101) / 100e0 AS color_diversity, (p_partkey * 71 % 101) / 100e0 AS texture_variance,
        (p_partkey * 83 % 101) / 100e0 AS noise_level, (p_partkey * 29 % 101) / 100e0 AS sharpness, (p_partkey * 31 % 101) / 100e0 AS contrast, (p_partkey * 43 % 101) / 100e0 AS complexity,
        p_partkey % 11 = 0 AS is_animated, p_partkey % 3 = 0 AS has_alpha, {pick('p_partkey', 256, 512, 1080, 1920, 4000)} AS width, {pick('p_partkey', 256, 500, 1920, 1080, 0, 300, 2000)} AS height,
        {pick('p_partkey', 'PNG', 'JPEG', 'GIF', 'TIFF', 'WebP', 'AVIF', 'HEIC', 'JXL', 'BMP', 'HEIF')} AS format, p_partkey % 4 = 0 AS lossless, p_partkey * 7919 % 30000000 AS size, p_partkey % 101 AS quality,
        (p_partkey % 90) / 10e0 AS entropy FROM part""",
    "dated": f"""SELECT o_orderkey AS id, '/d/' || CAST(o_orderkey AS STRING) || '.jpg' AS path, {', '.join(
        f"CASE WHEN (o_orderkey + {k}) % 4 = 0 THEN {blank} WHEN (o_orderkey + {k}) % 4 = 1 THEN NULL ELSE CAST(1986 + o_orderkey * {7 + k} % 46 AS STRING) || {pick(f'o_orderkey + {k}', ':', '-')} || {pick(f'o_orderkey + {3 * k}', '01', '02', '03', '04', '05', '06', '07', '08', '09', '10', '11', '12', '13')} || {pick(f'o_orderkey + {k}', ':', '-')} || {pick(f'o_orderkey + {5 * k}', '01', '15', '28', '31', '07')} || {pick(f'o_orderkey + {2 * k}', ' ', 'T', ' ')} || '10:30:' || {pick(f'o_orderkey + {k}', '00', '59', '61', '12', '33')} || {pick(f'o_orderkey + {k}', '', '.5', '+02:00', 'Z', '-05:00', '', '')} END AS {name}"
        for k, (name, blank) in enumerate([('xmp_ps_created', "''"), ('xmp_created', "'-'"), ('xmp_history', "'0000:00:00 00:00:00'"), ('exif_original', "'2001-01-01'"), ('exif_created', "'x'"), ('xmp_metadata', "'-'")]))} FROM orders""",
    "results": f"""SELECT event_id AS id, event_type, event_type IN ('view', 'signup', 'purchase') AS ok, event_type = 'signup' AS skipped, {pick('event_id', *MESSAGES)} AS message,
        1000 + event_id % 5000 AS input_size, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (1000 + event_id % 5000) * (40 + event_id % 70) // 100 END AS output_size,
        {pick('event_id', 'passed', 'passed', 'failed', 'warning', 'passed')} AS status FROM events""",
    "trace": """SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS iteration, 10e0 + event_id * 7 % 60 / 2e0 AS crf,
        CASE WHEN event_id % 3 = 0 THEN 15000 ELSE CAST(floor(value * 1000) AS BIGINT) END AS size, 20011 AS input_size, 0.9e0 + event_id * 31 % 1000 / 10000e0 AS ssim,
        30e0 + event_id * 13 % 40 / 4e0 AS psnr, CASE WHEN event_id % 5 < 3 THEN 41.5e0 ELSE 40e0 + event_id % 7 / 10e0 END AS score, event_id % 9 / 4e0 AS secs, 20e0 AS initial_crf, event_id FROM events""",
    "media": f"""SELECT '/m/' || p_brand || '/' || p_name || '_' || CAST(p_partkey AS STRING) || {pick('p_partkey', '.jpg', '.PNG', '.mov', '.heic', '.txt', '.webp', '.gif')} AS path,
        CASE WHEN p_partkey % 10 = 4 THEN ' doc-' || CAST(p_partkey AS STRING) || ' ' END AS document_id,
        CASE WHEN p_partkey % 10 = 6 THEN 'see dir/ref_' || CAST(p_partkey AS STRING) || '.xmp and more' END AS xmp_ref FROM part""",
    "sidecars": """SELECT CASE p_partkey % 10
          WHEN 0 THEN '/m/' || p_brand || '/' || p_name || '_' || CAST(p_partkey AS STRING) || '.jpg.xmp'
          WHEN 1 THEN '/m/' || p_brand || '/' || p_name || '_' || CAST(p_partkey AS STRING) || '.xmp'
          WHEN 2 THEN '/m/' || p_brand || '/' || upper(p_name) || '_' || CAST(p_partkey AS STRING) || '.raw.XMP'
          WHEN 3 THEN '/m/' || p_brand || '/x' || CAST(p_partkey AS STRING) || '.xmp'
          WHEN 4 THEN '/m/' || p_brand || '/0123abcd-0123-4567-89AB-' || lpad(CAST(p_partkey AS STRING), 12, '0') || '.xmp'
          WHEN 5 THEN '/m/' || p_brand || '/' || replace(p_name, ' ', '--') || CAST(p_partkey AS STRING) || '.xmp'
          WHEN 6 THEN '/m/' || p_brand || '/ref_' || CAST(p_partkey AS STRING) || '.xmp'
          WHEN 7 THEN '/m/' || p_brand || '/' || p_name || '_' || CAST(p_partkey AS STRING) || 'ab.xmp'
          WHEN 8 THEN '/m/' || p_name || '_' || CAST(p_partkey AS STRING) || '.xmp'
          ELSE '/m/' || p_brand || '/no' || CAST(p_partkey AS STRING) || '.xmp' END AS xmp_path,
        CASE WHEN p_partkey % 10 = 4 THEN 'doc-' || CAST(p_partkey AS STRING) END AS document_id,
        CASE WHEN p_partkey % 10 = 3 THEN CASE WHEN p_partkey % 20 = 3 THEN 'uuid:1' ELSE p_name || '_' || CAST(p_partkey AS STRING) || '.jpg' END END AS derived_from,
        CASE WHEN p_partkey % 10 = 3 THEN p_name || '_' || CAST(p_partkey AS STRING) || '.PNG' END AS source FROM part""",
    "outputs": f"""SELECT '/out/' || source || CASE WHEN doc_id % 3 = 0 THEN '/' || lang ELSE '' END || '/' || 'doc_' || CAST(doc_id AS STRING) || {pick('doc_id', *EXTENSIONS)} AS path, n_chars AS size
        FROM documents WHERE doc_id % 5 <> 2
        UNION ALL SELECT '/out/' || source || CASE WHEN doc_id % 3 = 0 THEN '/' || lang ELSE '' END || '/' || 'doc_' || CAST(doc_id AS STRING) || '.JXL' AS path, n_chars AS size FROM documents WHERE doc_id % 5 = 2""",
    "log": """SELECT 'entry' AS kind, '/lib/' || CAST(user_id AS STRING) AS path, event_id % 3 + 100 AS size, event_id % 2 AS mtime, user_id AS ctime, 7 AS btime, event_id AS seq FROM events WHERE event_type <> 'signup'""",
    "present": """SELECT CASE WHEN user_id % 7 = 0 THEN '/away/' ELSE '/lib/' END || CAST(user_id AS STRING) AS path, CASE WHEN user_id % 9 = 0 THEN NULL ELSE 100 + user_id % 3 END AS size, user_id % 2 AS mtime, user_id AS ctime, 7 AS btime
        FROM events GROUP BY user_id
        UNION ALL SELECT '/lib/new' || CAST(c_custkey AS STRING) AS path, c_custkey AS size, 0 AS mtime, 0 AS ctime, 0 AS btime FROM customer""",
    "pixels": """SELECT vec_id, label, @pixels@ AS px FROM embeddings""",
    "probe_json": f"""SELECT p_partkey AS id, '/v/' || CAST(p_partkey AS STRING) || '.' || {pick('p_partkey', 'mov', 'mp4', 'mkv', 'avi', 'webm', 'm4v')} AS path, p_partkey * 104729 % 500000000 AS size,
        CASE WHEN p_partkey % 17 = 0 THEN '{{"streams": [{{"codec_type": "video", "codec_name": "gif", "width": 10, "height": 10}}]}}' ELSE '{{"format": {{"duration": "' || {pick('p_partkey', '12.5', '0', 'N/A', '3600.25', '0.5')} || '"}}, "streams": [{{"codec_type": "video", "codec_name": "'
        || {pick('p_partkey', 'h264', 'hevc', 'av1')} || '", "width": ' || {pick('p_partkey', '640', '1920', '0')} || ', "height": 360, "r_frame_rate": "' || {pick('p_partkey', '30/1', '90000/1', '25', '0/0')} || '", "avg_frame_rate": "' || {pick('p_partkey', '30000/1001', '0/0', '24/1', '20000/1', '60')}
        || '", "duration": "' || {pick('p_partkey', 'N/A', '10.5', '-1', '0.0')} || '", "nb_frames": "' || {pick('p_partkey', '0', 'N/A', '300', '15')} || '", "nb_read_frames": "' || {pick('p_partkey', '77', 'x')} || '", "bit_rate": "' || {pick('p_partkey', '8000000', 'N/A', '0', '123456')}
        || '"}}' || CASE WHEN p_partkey % 4 = 1 THEN '' ELSE ', {{"codec_type": "audio", "codec_name": "aac", "bit_rate": "128000"}}' END || ']}}' END AS json FROM part""",
    "colors": f"""SELECT p_partkey AS id, {pick('p_partkey', None, 'bt709', 'bt2020', 'smpte432', 'display-p3', 'film')} AS primaries, {pick('p_partkey', 'smpte2084', None, 'arib-std-b67', 'bt709', 'srgb', 'iec61966-2-1', 'linear')} AS transfer,
        {pick('p_partkey', 'bt2020nc', 'bt709', None, 'rgb', 'smpte170m')} AS matrix, {pick('p_partkey', None, 5, 7, 8, 4)} AS profile, {pick('p_partkey', None, 2, 4)} AS compat, {pick('p_partkey', None, '', 'opus', 'AAC', 'libVorbis')} AS audio,
        {pick('p_partkey', 'mp4', 'MKV', 'mov')} AS container, {pick('p_partkey', None, 'srt', 'ASS', 'dvd_subtitle')} AS subtitle FROM part""",
    "pngs": f"""SELECT p_partkey AS id, {pick('p_partkey', 3, 2, 3, 3, 6, 0, 3)} AS colour_type, p_partkey % 4 = 0 AS has_transparency, {pick('p_partkey', 64, 120, 400, 1000, 10)} AS width, {pick('p_partkey', 64, 100, 300, 800, 12, 90)} AS height,
        {pick('p_partkey', 8, 8, 4, 16, 8, 2)} AS bit_depth, {pick('p_partkey', None, 4, 16, 20, 32, 40, 70, 100, 130, 150, 205, 245, 256)} AS palette, p_partkey % 257 AS used, p_partkey % 81 / 10e0 AS entropy, p_partkey % 19 / 18e0 AS entropy_ratio,
        p_partkey * 997 % 200000 AS size, {pick('p_partkey', 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)} AS tool, p_partkey * 3 % 11 / 10e0 AS dithering, p_partkey * 7 % 11 / 10e0 AS banding, {pick('p_partkey', 0.85, 0.70, 0.50, 0.25, 0.0)} AS frequency FROM part""",
    "side_data": f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN '[]' ELSE '[{{"side_data_type": "' || {pick('p_partkey', 'DOVI configuration record', 'Mastering display metadata', 'HDR10+ dynamic', 'x')} || '", "dv_profile": "' || {pick('p_partkey', '8', '5', 'x')} || '", "green_x": "8500/50000", "green_y": "39850/50000", "blue_x": "6550/50000",
        "blue_y": "2300/50000", "red_x": "35400/50000", "red_y": "14600/50000", "white_point_x": "15635/50000", "white_point_y": "16450/50000", "max_luminance": "' || {pick('p_partkey', '10000000/10000', '4000000/10000')} || '", "min_luminance": "50/10000"}},
        {{"side_data_type": "' || {pick('p_partkey', 'Content light level metadata', 'other')} || '", "max_content": "' || CAST(p_partkey % 1000 AS STRING) || '", "max_average": "200"}}]' END AS json FROM part""",
    "directories": """SELECT o_orderpriority AS root, '/s/' || CAST(o_custkey AS STRING) AS path, max(o_orderkey) AS mtime FROM orders GROUP BY o_orderpriority, o_custkey""",
}
ENGINE = {
    "spark": {
        "@sha@(text)": "sha2(text, 256)", "//": "DIV",
        "@pixels@": "transform(embedding, x -> CAST(least(greatest(floor((CAST(x AS DOUBLE) + 1e0) * 127.5e0), 0), 255) AS INT))",
    },
    "duckdb": {"@sha@(text)": "sha256(text)", "@pixels@": "[CAST(least(greatest(floor((CAST(x AS DOUBLE) + 1e0) * 127.5e0), 0), 255) AS INT) FOR x IN embedding]"},
}


def text(name: str, engine: str) -> str:
    out = TEXT[name]
    for token, own in ENGINE[engine].items():
        out = out.replace(token, own)
    return out


def load(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A stand-in, or a given table by its own name; with ``spread`` its rows are dealt to as many tasks as shuffles have, for work that is large beside what a row takes in a file."""
    if name in TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread_out(table, table.columns[0]) if spread else table
    query, used = text(name, "spark"), {}
    for table in TABLES:
        if re.search(rf"\b(FROM|JOIN) {table}\b", query):
            query = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 \0{table}\0", query)
            used[table] = load(spark, sf_dir, table, spread)
    query = query.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub("\0(\\w+)\0", r"{\1}", query), **used)


def ctes(*names: str) -> str:
    """WITH clause of stand-ins for DuckDB, without the word itself."""
    return ",\n".join(f"{n} AS ({text(n, 'duckdb')})" for n in names)
