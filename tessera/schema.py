"""Schemas of the store and of what is read from files, as Spark's DDL."""

from __future__ import annotations

RECORD = "content_hash string not null, file_size bigint not null, created_at bigint not null, algorithm_version int, content_fingerprint_hash string, data_checksum bigint"
PATH_INDEX = "file_path string not null, content_hash string not null, mtime bigint not null, file_size bigint not null, atime bigint, ctime bigint, btime bigint"
METADATA = "key string not null, value int not null"
FILE = "path string, size bigint, relative_depth int, format_priority int, pixel_count bigint, duration_secs double, frame_rate double, estimated_work bigint"
DATES = "path string, filename string, xmp_ps_created string, xmp_created string, xmp_history string, exif_original string, exif_created string, xmp_metadata string"
CHECKPOINT = (
    "kind string, path string, size bigint, mtime bigint, ctime bigint, btime bigint, format_version int, target_dir string, "
    "output_root string, cache_algorithm_version int, cache_schema_version int, created_at bigint"
)
PROBE = (
    "format struct<format_name: string, duration: string, size: string, bit_rate: string, tags: map<string, string>>, "
    "streams array<struct<codec_type: string, codec_name: string, width: int, height: int, pix_fmt: string, r_frame_rate: string, "
    "avg_frame_rate: string, duration: string, nb_frames: string, bit_rate: string, color_space: string, color_transfer: string, "
    "bits_per_raw_sample: string, has_b_frames: int, tags: map<string, string>, side_data_list: array<map<string, string>>>>"
)
PRECHECK = (
    "format struct<duration: string>, streams array<struct<codec_name: string, width: int, height: int, r_frame_rate: string, avg_frame_rate: string, "
    "duration: string, nb_frames: string, nb_read_frames: string, bit_rate: string>>"
)
