"""What media tools print: probe and metadata JSON, sidecar text, metric and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import color, sizes, text
from tessera.schema import PRECHECK, PROBE
from tessera.sources import logs


def _long(column: Column) -> Column:
    return column.try_cast("bigint")


def parsed_probe(documents: DataFrame, column: str = "json") -> DataFrame:
    """``documents`` with the figures of its probe JSON; malformed JSON gives nulls.

    The video stream is the one with most frames, the last of equals.
    """
    return with_figures(documents, F.from_json(column, PROBE))


def with_figures(documents: DataFrame, p: Column) -> DataFrame:
    """``documents`` with the figures of a probe ``p`` of the form PROBE."""
    streams = F.coalesce(p["streams"], F.array())
    videos = F.filter(streams, lambda s: s["codec_type"] == "video")
    ranked = F.transform(videos, lambda s, i: F.struct(F.coalesce(_long(s["nb_frames"]), F.lit(0).cast("bigint")).alias("n"), i.alias("i")))
    v = F.get(videos, F.array_max(ranked)["i"])
    audio = F.get(F.filter(streams, lambda s: s["codec_type"] == "audio"), F.lit(0))
    side = F.reduce(F.coalesce(v["side_data_list"], F.array().cast("array<map<string,string>>")), F.expr("cast(map() as map<string,string>)"), lambda a, b: F.map_from_entries(F.array_distinct(F.concat(F.filter(F.map_entries(a), lambda e: ~F.map_contains_key(b, e["key"])), F.map_entries(b)))))
    duration = F.coalesce(p["format"]["duration"].try_cast("double"), v["duration"].try_cast("double"))
    real, mean = text.rational(v["r_frame_rate"]), text.rational(v["avg_frame_rate"])
    return documents.withColumns({
        "format_name": p["format"]["format_name"], "duration": duration, "codec": v["codec_name"], "width": v["width"], "height": v["height"],
        "pix_fmt": v["pix_fmt"], "fps": F.coalesce(F.when(mean > 0, mean), F.when(real > 0, real)), "real_rate": real, "mean_rate": mean, "frames": _long(v["nb_frames"]),
        "bit_rate": _long(p["format"]["bit_rate"]), "video_bit_rate": _long(v["bit_rate"]), "audio_codec": audio["codec_name"], "audio_bit_rate": _long(audio["bit_rate"]),
        "color_space": v["color_space"], "color_transfer": v["color_transfer"], "bit_depth": F.coalesce(_long(v["bits_per_raw_sample"]), F.nullif(F.regexp_extract(v["pix_fmt"], r"p(\d\d)(?:le|be)$", 1), F.lit("")).try_cast("bigint"), F.lit(8)).cast("int"),
        "has_audio": audio.isNotNull(), "tags": v["tags"], "side_data": side,
    })


# The tags that the date analysis takes, by the names of its columns.
EXIF_NAMES = {
    "SourceFile": "path", "FileName": "filename", "XMP-photoshop:DateCreated": "xmp_ps_created", "XMP-xmp:CreateDate": "xmp_created",
    "XMP-xmpMM:HistoryWhen": "xmp_history", "ExifIFD:DateTimeOriginal": "exif_original", "ExifIFD:CreateDate": "exif_created", "XMP-xmp:MetadataDate": "xmp_metadata",
}


def exif_records(documents: DataFrame, column: str = "json") -> DataFrame:
    """A row for each metadata record of JSON arrays or of lone records, with the names that the date analysis takes; a list, such as a history, counts by its first entry. Malformed JSON gives no rows."""
    array = F.when(F.rlike(column, F.lit(r"^\s*\{")), F.concat(F.lit("["), column, F.lit("]"))).otherwise(F.col(column))
    record = F.explode(F.from_json(array, "array<map<string,string>>")).alias("_r")
    value = lambda tag: F.col("_r")[tag]
    first = lambda v: F.when(F.startswith(v, F.lit("[")), F.get_json_object(v, "$[0]")).otherwise(v)
    return documents.select(record).select(*[first(value(tag)).alias(name) for tag, name in EXIF_NAMES.items()])


#: What every record of the tool starts with behind its brace. Inside a JSON string its quotes would have backslashes, so it stands only where a key or a value does.
RECORD_KEY = '"SourceFile"'


def split_records(chunks: DataFrame, column: str = "value") -> DataFrame:
    """``chunks`` of text between one RECORD_KEY and the next, as JSON arrays of one record in ``column``: what belongs to the record after it is cut off."""
    body = F.regexp_replace(column, r"\s*(,\s*\{|\])?\s*$", "")
    return chunks.withColumn(column, F.concat(F.lit("[{" + RECORD_KEY), body, F.lit("]")))


def exif(spark: SparkSession, location: str) -> DataFrame:
    """The records of files of metadata JSON, one array or record in each, however large: Spark deals parts of a file to tasks, which start at records.

    The tool writes a record's SourceFile first. A file in which that is the text of a value, too, or of which a record starts otherwise, is read whole, in one task.
    """
    parts = spark.read.option("lineSep", RECORD_KEY).text(location).select("value", "_metadata.file_path", "_metadata.file_block_start")
    like = lambda pattern: F.rlike("value", F.lit(pattern))
    opening = like(r"^\s*\[\s*\{\s*$") & (F.col("file_block_start") == 0)
    one = F.col("record").isNotNull() & like(r"^\s*:")
    found = split_records(parts.withColumn("raw", F.col("value"))).withColumns({"record": F.from_json("value", "array<map<string,string>>"), "text": F.col("value"), "value": F.col("raw")})
    shape = F.when(opening, "opening").when(one & like(r"\}\s*,\s*\{\s*$"), "next").when(one & like(r"\}\s*\]\s*$"), "last").otherwise("odd")
    ends = [F.count_if(shape == k).alias(k) for k in ("opening", "last", "odd")]
    odd = found.groupBy("file_path").agg(*ends).filter("opening <> 1 or last <> 1 or odd > 0").select("file_path")
    split = exif_records(found.filter(~opening).join(odd, "file_path", "left_anti").select(F.col("text").alias("value")), "value")
    whole = spark.read.text(location, wholetext=True).select("value", "_metadata.file_path").join(odd, "file_path", "left_semi")
    return split.unionByName(exif_records(whole, "value"))


def sidecar_text(documents: DataFrame, column: str = "text") -> DataFrame:
    """``documents`` with document_id, derived_from and source: the lines of the tool's short form, by position; a blank tag shifts those after it."""
    line = lambda k: F.nullif(F.trim(F.get(F.split(column, "\n"), F.lit(k))), F.lit(""))
    return documents.withColumns({"document_id": line(0), "derived_from": line(1), "source": line(2)})


def checkpoint_log(spark: SparkSession, location: str) -> DataFrame:
    """Records of a checkpoint log's files with seq, their order: by file name, then by line. See ``logs`` for legacy and broken lines, and for logs of generations."""
    return logs.records(logs.ordered_lines(spark, location))


def run_counts(logs: DataFrame, column: str = "text") -> DataFrame:
    """``logs`` with succeeded, skipped and failed: the last number that the log gives for each, else 0."""
    return logs.withColumns({k.lower(): text.last_count(F.col(column), k) for k in ("Succeeded", "Skipped", "Failed")})


def merged_logs(sections: list[DataFrame]) -> DataFrame:
    """section, line_no, line of several logs in order."""
    from functools import reduce

    numbered = [s.select(F.lit(i).alias("section"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")) for i, s in enumerate(sections)]
    return reduce(DataFrame.unionByName, numbered).orderBy("section", "line_no")


def stream_sizes(documents: DataFrame, path: str = "path", size: str = "size", column: str = "json") -> DataFrame:
    """``documents`` with video_size, audio_size, overhead and method: from bit rates and length where the probe tells both, else estimated by container."""
    p = F.from_json(column, PROBE)
    first = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    secs = p["format"]["duration"].try_cast("double")
    of = lambda kind: F.coalesce(sizes.rate_bytes(_long(first(kind)["bit_rate"]), secs), F.lit(0).cast("bigint"))
    measured = documents.withColumns({"_v": of("video"), "_a": of("audio"), "_known": F.coalesce(secs > 0, F.lit(False))})
    known, total = F.col("_known") & (F.col("_v") > 0), F.col(size)
    guess = sizes.estimated_overhead(F.col(path), total)
    return measured.withColumns({
        "video_size": F.when(known, F.col("_v")).otherwise(sizes.saturating_minus(total, guess)), "audio_size": F.when(known, F.col("_a")).otherwise(F.lit(0).cast("bigint")),
        "overhead": F.when(known, sizes.saturating_minus(total, F.col("_v") + F.col("_a"))).otherwise(guess), "method": F.when(known, "BitrateCalculation").otherwise("Estimated"),
    }).drop("_v", "_a", "_known")


def precheck_figures(documents: DataFrame, size: str = "size", column: str = "json") -> DataFrame:
    """``documents`` with duration, fps, frames and bpp of the first stream.

    The length is the stream's own, else the container's, else frames by rate; a rate
    that looks like a time base is replaced by frames by length; bits are the stream's, else the whole file's.
    """
    p = F.from_json(column, PRECHECK)
    s = F.get(p["streams"], F.lit(0))
    positive = lambda c: F.when((c > 0) & ~F.isnan(c), c)
    usable = lambda c: F.when((c > 0) & (c < float("inf")), c)
    mean = usable(text.rational(s["avg_frame_rate"]))
    rate = F.coalesce(F.when(mean <= 10_000, mean), usable(text.rational(s["r_frame_rate"])))
    own = F.coalesce(_long(s["nb_frames"]), F.lit(0).cast("bigint"))
    figures = documents.withColumns({
        "_rate": rate, "_own": own, "_counted": F.when(own == 0, F.coalesce(_long(s["nb_read_frames"]), own)).otherwise(own), "_bits": _long(s["bit_rate"]),
        "_stream": positive(s["duration"].try_cast("double")), "_format": positive(p["format"]["duration"].try_cast("double")), "_area": s["width"].cast("bigint") * s["height"],
    })
    figures = figures.withColumn("duration", F.coalesce("_stream", "_format", F.when(F.col("_counted") > 0, F.col("_counted") / F.col("_rate"))))
    inferred = F.col("_counted") / F.col("duration")
    figures = figures.withColumn("fps", F.when((F.col("_rate") > 10_000) & (F.col("duration") >= 0.001) & (inferred > 0) & (inferred <= 10_000), inferred).otherwise(F.col("_rate")))
    frames = F.when((F.col("_counted") == 0) & (F.col("duration") > 0), (F.col("duration") * F.col("fps")).cast("bigint")).otherwise(F.greatest("_counted", F.lit(1)))
    figures = figures.withColumn("frames", frames)
    stream_bytes = F.when(F.col("_bits") > 0, sizes.rate_bytes(F.col("_bits"), F.col("duration")))
    used = F.when(stream_bytes > 0, stream_bytes).otherwise(F.col(size))
    total = F.nullif(F.col("_area") * F.col("frames"), F.lit(0).cast("bigint"))
    bpp = F.when(F.col("_rate").isNotNull() & F.col("duration").isNotNull(), used * 8.0 / total)
    return figures.withColumn("bpp", bpp).drop("_rate", "_own", "_counted", "_bits", "_stream", "_format", "_area")


def hdr_side_data(documents: DataFrame, column: str = "side") -> DataFrame:
    """``documents`` (side: an array of maps) with dolby_vision, dv_profile, hdr10_plus, mastering_display and max_cll; of several entries the last that tells counts."""
    kind = lambda e: F.lower(F.coalesce(e["side_data_type"], F.lit("")))
    has = lambda pattern: F.exists(column, lambda e: F.rlike(kind(e), F.lit(pattern)))
    last = lambda pattern, value: F.try_element_at(F.filter(F.transform(F.filter(column, lambda e: F.rlike(kind(e), F.lit(pattern))), value), lambda v: v.isNotNull()), F.lit(-1))
    return documents.withColumns({
        "dolby_vision": F.coalesce(has("dolby vision|dovi"), F.lit(False)), "dv_profile": last("dolby vision|dovi", lambda e: e["dv_profile"].try_cast("int")),
        "hdr10_plus": F.coalesce(has(r"hdr10\+|hdr dynamic|smpte2094-40"), F.lit(False)), "mastering_display": last("mastering display", color.mastering_display),
        "max_cll": last("content light", color.light_level),
    })
