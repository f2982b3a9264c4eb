"""Files of lines: in the order they were written, whole or not at all, and logs that are compacted by generations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import checkpoint
from tessera.schema import CHECKPOINT
from tessera.sources.keyed import _children

BLANKS = " \t\r\n\x0b\x0c"
#: Parts of a generation's folder, in the order they are read.
COMPACTED, APPENDED = "1-compacted", "2-appended"


def ordered_lines(spark: SparkSession, location: str | list[str]) -> DataFrame:
    """file, seq, line of text files; seq orders the lines by file name, then by their place in the file.

    Spark deals parts of files to tasks by their sizes, so the place is the start of a part and the order within it; a task reads the lines of a part in order.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return spark.read.option("recursiveFileLookup", "true").text(location).select(at["file"].alias("file"), at.alias("seq"), F.col("value").alias("line"))


def whole_files(lines: DataFrame, sound: Column) -> DataFrame:
    """The ``lines`` of files all of whose lines are ``sound``; of other files none."""
    broken = lines.filter(~F.coalesce(sound, F.lit(False))).select("file").distinct()
    return lines.join(broken, "file", "left_anti")


def processed_paths(spark: SparkSession, location: str | list[str]) -> DataFrame:
    """path: the distinct lines of files of paths that aren't blank. A file with a byte that isn't UTF-8 is broken, and gives no path."""
    lines = whole_files(ordered_lines(spark, location), F.is_valid_utf8("line"))
    return lines.select(F.btrim("line", F.lit(BLANKS)).alias("path")).filter("path <> ''").distinct()


def cache_entries(documents: DataFrame, column: str = "json", capacity: int | None = None) -> DataFrame:
    """key, entry (a variant), place of cache documents ``{"capacity": n, "entries": [[key, entry], ...]}``; a malformed document or one without both gives no row.

    Of more entries than ``capacity`` (by default the document's own) the last stay.
    """
    parsed = documents.select(F.try_parse_json(F.col(column)).alias("_v"))
    held = F.try_variant_get("_v", "$.entries", "array<variant>")
    limit = F.lit(capacity) if capacity else F.try_variant_get("_v", "$.capacity", "int")
    rows = parsed.select(limit.alias("_limit"), F.size(held).alias("_n"), F.posexplode(held).alias("place", "_e"))
    kept = rows.filter(F.col("place") >= F.col("_n") - F.col("_limit"))
    return kept.select(F.try_variant_get("_e", "$[0]", "string").alias("key"), F.try_variant_get("_e", "$[1]", "variant").alias("entry"), "place").filter("key is not null")


def records(lines: DataFrame) -> DataFrame:
    """The rows of checkpoint ``lines`` (seq, line): fields of CHECKPOINT, and seq.

    kind is header or entry as the line says, legacy for a bare path, and broken for a line that isn't a record, such as the torn last one of a run that was lost.
    Blank lines are none.
    """
    text = F.btrim("line", F.lit(BLANKS))
    shown = lines.select("seq", text.alias("_t")).filter("_t <> ''").withColumn("_r", F.from_json("_t", f"{CHECKPOINT}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bare = ~F.startswith("_t", F.lit("{"))
    good = F.col("_r._bad").isNull() & F.col("_r.kind").isin("header", "entry") & ((F.col("_r.kind") == "header") | F.col("_r.path").isNotNull())
    kind = F.when(bare, "legacy").when(F.coalesce(good, F.lit(False)), F.col("_r.kind")).otherwise("broken")
    names = [f.split()[0] for f in CHECKPOINT.split(", ")]
    usable = kind.isin("header", "entry")
    fields = {n: F.when(usable, F.col(f"_r.{n}")) for n in names} | {"kind": kind, "path": F.when(bare, F.col("_t")).when(usable, F.col("_r.path"))}
    return shown.select(*[fields[n].alias(n) for n in names], "seq")


def _generations(spark: SparkSession, location: str) -> list[str]:
    """Folders of the log's generations that are complete, the last one last; that of number 0 needs no mark."""
    found = [f for f in _children(spark, location) if "/generation=" in f]
    done = lambda f: f.endswith("=000000000000") or any(c.endswith("/_SUCCESS") for c in _children(spark, f"{f}/{COMPACTED}"))
    return [f for f in found if done(f)]


def read_log(spark: SparkSession, location: str) -> DataFrame:
    """The rows of the last complete generation of a log, in order of seq: what was compacted, then what was appended since."""
    found = _generations(spark, location)
    if not found:
        return records(spark.createDataFrame([], "seq struct<file:string,block:bigint,place:bigint>, line string"))
    return records(ordered_lines(spark, found[-1]))


def _lines(rows: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in CHECKPOINT.split(", ")]
    return rows.select(F.to_json(F.struct(*[F.col(n) for n in names if n in rows.columns])).alias("value"))


def append_log(entries: DataFrame, location: str) -> None:
    """Add rows, which have ``seq``, to the last generation, behind what is there; of one call they stay in that order.

    Files are named by the time of the call, in one numbering with those before. Writers of the same moment are ordered by chance.
    """
    import time

    found = _generations(entries.sparkSession, location)
    folder = found[-1] if found else f"{location}/generation=000000000000"
    ordered = entries.repartitionByRange(F.col("seq")).sortWithinPartitions("seq") if "seq" in entries.columns else entries
    _lines(ordered).write.text(f"{folder}/{APPENDED}/{time.time_ns():020d}-{uuid.uuid4().hex}")


def compact_log(spark: SparkSession, location: str) -> int:
    """Write the next generation, with the last header and the last entry of each path, and return its number.

    It counts once Spark has marked it as written to its end; until then, or if that fails, readers see the one before. Nobody may append meanwhile. Legacy and broken lines go.
    """
    last = _generations(spark, location)[-1]
    number = int(last.rpartition("=")[2]) + 1
    kept = checkpoint.compacted(read_log(spark, location))
    _lines(kept.orderBy(F.col("kind") != "header", "seq")).write.mode("overwrite").text(f"{location}/generation={number:012d}/{COMPACTED}")
    return number
