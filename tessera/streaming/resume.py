"""Batches over new files only, and sliding figures over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.store import upsert
from tessera.sources import keyed


def new_rows(spark: SparkSession, folder: str, schema, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the rows of files that arrive in ``folder``."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(folder)


def process_new(stream: DataFrame, work: Callable[[DataFrame, int], None], progress: str) -> StreamingQuery:
    """Run ``work`` once on whatever is new since the last call; ``progress`` remembers what is done, so that a run can be resumed."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", progress).trigger(availableNow=True).start()


def upsert_new(stream: DataFrame, location: str, key: list[str], order: list[str], progress: str, buckets: int = 64) -> StreamingQuery:
    """Keep the last row of each key by ``order``, whichever file it came in, in a keyed table (``tessera.sources.keyed``) of ``buckets`` buckets.

    A batch rewrites the buckets that its keys fall in and then commits the next version, so readers never see half of one, and a batch that
    fails leaves the version before. A batch that is run again puts the same rows again. What the table has is told by its manifest, not by batch numbers: with a new
    or lost progress folder all files are put once more on top of it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if keyed.exists(batch.sparkSession, location):
                keyed.put(batch, location, order, latest=True)
            else:
                keyed.create(upsert(batch.limit(0), batch, key, order), location, key, buckets)
        finally:
            batch.unpersist()

    return process_new(stream, merge, progress)


def outcome_windows(events: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window, event_type, n, value: tumbling counts and sums, final once the watermark has passed."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    )
