"""The file catalogue: what there is, in which order it is worked on, and whether a snapshot still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import values as V
from tessera.functions import paths
from tessera.operators.lineage import settle


def with_extension(files: DataFrame, extensions: list[str]) -> DataFrame:
    return files.filter(paths.has_extension(F.col("path"), extensions))


def whole_thousandths(value: Column) -> Column:
    """A sort key of doubles: thousandths, null for negative and non-finite ones."""
    good = (value >= 0) & (value < float("inf")) & ~F.isnan(value)
    return F.when(good, F.round(value * 1000.0).cast("bigint"))


def estimated_work(pixel_count: Column, frame_count: Column, duration: Column, rate: Column) -> Column:
    frames = F.when(frame_count > 0, frame_count).when((duration > 0) & (rate > 0), F.greatest(F.round(duration * rate), F.lit(1.0)).cast("bigint"))
    return F.try_multiply(pixel_count, frames)


SORTS = {"size_asc": [F.asc, "size"], "size_desc": [F.desc, "size"], "name": [F.asc, "path"]}


def sort_files(files: DataFrame, how: str) -> DataFrame:
    """By size either way, without files whose size is unknown, or by name with all; ties by path. ``none`` keeps the order."""
    if how == "none":
        return files
    direction, column = SORTS[how]
    found = files if column == "path" else files.filter(F.col("size").isNotNull())
    return found.orderBy(direction(column), F.asc("path"))


def image_order() -> list[Column]:
    """Deeper files first, then by format, size and area, unknown areas last."""
    return [F.desc("relative_depth"), F.asc("format_priority"), F.asc("size"), F.asc_nulls_last("pixel_count"), F.asc("path")]


def video_order() -> list[Column]:
    """Deeper files first, then by work, length, size, area and rate, unknown ones last."""
    key = lambda c: whole_thousandths(F.col(c)).asc_nulls_last()
    return [
        F.desc("relative_depth"), F.asc_nulls_last("estimated_work"), key("duration_secs"), F.asc("size"), F.asc_nulls_last("pixel_count"),
        key("frame_rate"), F.asc("path"),
    ]


def image_queue(files: DataFrame, root: str) -> DataFrame:
    images = files.filter(paths.kind(F.col("path")) == "image")
    return images.withColumns({"relative_depth": paths.depth(F.col("path"), root), "format_priority": paths.format_priority(F.col("path"))}).orderBy(*image_order())


def video_queue(files: DataFrame, root: str) -> DataFrame:
    videos = files.filter(paths.kind(F.col("path")) == "video")
    work = estimated_work(F.col("pixel_count"), F.col("frame_count"), F.col("duration_secs"), F.col("frame_rate"))
    return videos.withColumns({"relative_depth": paths.depth(F.col("path"), root), "estimated_work": work}).orderBy(*video_order())


def with_rank(files: DataFrame, order: list[Column], column: str = "rank") -> DataFrame:
    """``files`` with the position of each row from 1, without bringing all rows to one task.

    Rows are range-partitioned by the order; each partition numbers its own rows
    behind the rows of those before it. ``order`` must be total. Which
    partition a row is in is settled first, as a range partitioning done twice may differ. One size for each partition is broadcast.
    """
    parts = settle(files.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(before), "_part").withColumn(column, F.col("_before") + own).drop("_part", "_before")


def kind_counts(files: DataFrame) -> DataFrame:
    """One row of counts by kind over files that aren't hidden, and the number of outputs to expect."""
    kind = paths.kind(F.col("path"))
    of = lambda k: F.count_if(kind == k)
    shown = files.filter(~paths.is_hidden(F.col("path")))
    return shown.agg(
        F.count(F.lit(1)).alias("total"), of("image").alias("images"), of("video").alias("videos"), of("sidecar").alias("sidecars"),
        of("other").alias("others"),
    ).withColumn("expected", F.col("total") - F.col("sidecars"))


def shell_counts(files: DataFrame) -> DataFrame:
    """As the launcher counts: hidden files count by kind but not in the total, and other is what is left of it."""
    kind, shown = paths.shell_kind(F.col("path")), ~paths.is_hidden(F.col("path"))
    of = lambda k: F.count_if(kind == k)
    return files.agg(
        F.count_if(shown).alias("total"), of("image").alias("images"), of("video").alias("videos"), of("sidecar").alias("sidecars"),
    ).withColumn("others", F.col("total") - F.col("images") - F.col("videos") - F.col("sidecars"))


def directory_bytes(files: DataFrame, extensions: list[str]) -> DataFrame:
    """directory, files, bytes of the files with one of the extensions."""
    return (
        with_extension(files, extensions).groupBy(paths.directory(F.col("path")).alias("directory"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    )


def disk_precheck(files: DataFrame, available: int) -> DataFrame:
    """Bytes needed (all inputs and a fixed headroom) and whether they are there."""
    needed = F.coalesce(F.sum("size"), F.lit(0)) + V.DISK_HEADROOM
    return files.agg(needed.alias("needed")).withColumn("enough", F.col("needed") <= available)


def normal_extensions(extensions: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(extensions, F.lower)))


def snapshot_valid(snapshots: DataFrame, directories: DataFrame, current: DataFrame, expected: DataFrame) -> DataFrame:
    """root, valid: whether a snapshot's settings are the expected ones and none of its directories has changed.

    ``snapshots`` and ``expected`` have root, version, recursive, extensions; ``directories`` (root, path, mtime) is
    what the snapshot saw, ``current`` (path, mtime) what there is; a directory that is gone has time 0.
    """
    seen = directories.join(current.select("path", F.col("mtime").alias("_now")), "path", "left")
    same = seen.groupBy("root").agg(F.bool_and(F.col("mtime") == F.coalesce("_now", F.lit(0))).alias("_same"))
    wanted = expected.select("root", *[F.col(c).alias(f"_{c}") for c in ("version", "recursive", "extensions")])
    met = snapshots.join(wanted, "root", "left").join(same, "root", "left")
    settings = (F.col("version") == F.col("_version")) & (F.col("recursive") == F.col("_recursive")) & (normal_extensions(F.col("extensions")) == normal_extensions(F.col("_extensions")))
    return met.select("root", (F.coalesce(settings, F.lit(False)) & F.coalesce("_same", F.lit(True))).alias("valid"))


def hot_start_score(path: Column, index: Column, last_extension: str | None, last_directory: str | None, window: int = 48) -> Column:
    """How well a pending file goes on from the last success: same extension, same directory, nearness."""
    same_ext = F.lit(False) if last_extension is None else paths.extension(path) == last_extension
    same_dir = F.lit(False) if last_directory is None else paths.directory(path) == last_directory
    score = F.when(same_ext, 4).otherwise(0) + F.when(same_dir, 2).otherwise(0)
    return F.struct(score.alias("match"), (window - index).cast("int").alias("near"))


def hot_start(pending: DataFrame, last_extension: str | None, last_directory: str | None, window: int = 48) -> DataFrame:
    """The pending file (index, path) to take next, among the first ``window``."""
    first = pending.filter(F.col("index") < window)
    score = hot_start_score(F.col("path"), F.col("index"), last_extension, last_directory, window)
    return first.agg(F.max_by(F.struct("index", "path"), score).alias("best")).select("best.*")


def expired_logs(files: DataFrame, program: str, keep: int) -> DataFrame:
    """Logs (path, modified) of a program beyond the newest ``keep``; ties by path."""
    name = paths.name(F.col("path"))
    logs = files.filter(F.startswith(name, F.lit(program)) & F.endswith(name, F.lit(".log")) & F.col("modified").isNotNull())
    return with_rank(logs, [F.desc("modified"), F.asc("path")], "_rank").filter(F.col("_rank") > keep).drop("_rank")
