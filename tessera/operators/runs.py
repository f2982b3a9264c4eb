"""What a run did: outcomes, bytes and whether everything is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions import errors, sizes
from tessera.operators.catalog import kind_counts


def rate(part: Column, total: Column, empty: float = 100.0) -> Column:
    return F.when(total > 0, part / F.nullif(total, F.lit(0).cast("bigint")).cast("double") * 100.0).otherwise(empty)


def classified(results: DataFrame, media: str) -> DataFrame:
    """``results`` (ok, skipped, message) with outcome, as the image or the video tools count."""
    rule = errors.image_outcome if media == "image" else errors.video_outcome
    return results.withColumn("outcome", rule(F.col("ok"), F.col("skipped"), F.coalesce("message", F.lit(""))))


def batch_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by outcome and the success rate: skips count in the total, pauses don't; an empty run is a full success."""
    of = lambda k: F.count_if(F.col("outcome") == k)
    counted = results.groupBy(*(by or [])).agg(
        F.count_if(F.col("outcome") != "paused").alias("total"), of("succeeded").alias("succeeded"), of("failed").alias("failed"),
        of("skipped").alias("skipped"), of("paused").alias("paused"),
    )
    return counted.withColumn("success_rate", rate(F.col("succeeded"), F.col("total")))


def bytes_summary(results: DataFrame, media: str) -> DataFrame:
    """Input and output bytes of successes, and the reduction in percent.

    The video tools count the input again where the output's size is unknown, the image tools nothing.
    """
    output = F.coalesce("output_size", "input_size") if media == "video" else F.col("output_size")
    done = results.filter(F.col("outcome") == "succeeded")
    total = done.agg(F.coalesce(F.sum("input_size"), F.lit(0)).alias("input_bytes"), F.coalesce(F.sum(output), F.lit(0)).alias("output_bytes"))
    return total.withColumns({
        "reduction": sizes.reduction_percent(F.col("output_bytes"), F.col("input_bytes")), "ratio": sizes.ratio(F.col("output_bytes"), F.col("input_bytes")),
    })


def health(checks: DataFrame) -> DataFrame:
    """passed, failed, warnings and the rate of passes in percent; nothing checked is healthy."""
    of = lambda k: F.count_if(F.col("status") == k)
    out = checks.agg(of("passed").alias("passed"), of("failed").alias("failed"), of("warning").alias("warnings"))
    return out.withColumn("rate", rate(F.col("passed"), F.col("passed") + F.col("failed") + F.col("warnings")))


def completeness(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """expected, actual, missing, passed: numbers of files only; more outputs than expected pass."""
    want = kind_counts(inputs).select(F.col("expected"))
    have = kind_counts(outputs).select(F.col("total").alias("actual"))
    return want.join(have).withColumn("missing", F.col("expected") - F.col("actual")).withColumn("passed", F.col("missing") <= 0)


def throughput(results: DataFrame, elapsed_secs: float) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("files")).withColumn("average_secs", F.when(F.col("files") > 0, elapsed_secs / F.nullif("files", F.lit(0).cast("bigint"))).otherwise(0.0))


def counters(results: DataFrame) -> DataFrame:
    """One row of counts by medium and outcome (results has medium, outcome)."""
    of = lambda m, o: F.count_if((F.col("medium") == m) & (F.col("outcome") == o)).alias(f"{m}_{o}")
    return results.agg(*[of(m, o) for m in ("image", "video") for o in ("succeeded", "failed", "skipped")])


def copy_counts(files: DataFrame, copied: Column, skipped: Column) -> DataFrame:
    """One row: total, copied, skipped and failed, which are neither, of the files to copy."""
    done, left = F.coalesce(copied, F.lit(False)), F.coalesce(skipped, F.lit(False))
    return files.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("copied"), F.count_if(left & ~done).alias("skipped"), F.count_if(~done & ~left).alias("failed"))


def _figures() -> list[Column]:
    of = lambda k: F.count_if(F.col("outcome") == k)
    done = F.col("outcome") == "succeeded"
    summed = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0))
    return [
        F.count_if(F.col("outcome") != "paused").alias("total"), *[of(k).alias(k) for k in ("succeeded", "failed", "skipped", "paused")],
        summed("input_size").alias("input_bytes"), summed("output_size").alias("output_bytes"),
    ]


def reported(results: DataFrame) -> tuple[DataFrame, Observation]:
    """``results`` (outcome, input_size, output_size), and what to ask for their figures once they are written: the pass that writes also counts.

    A task that is tried again counts once, as only its successful end does. A stage that is run again, because its shuffle files were lost, may
    count some rows twice: where that matters write first and take ``figures`` of what is there.
    """
    seen = Observation()
    return results.observe(seen, *_figures()), seen


def figures(results: DataFrame) -> DataFrame:
    """One row: the same figures by an aggregate over ``results``."""
    return results.agg(*_figures())


def write_report(results: DataFrame, location: str) -> dict:
    """Write ``results`` as Parquet and return their figures and the reduction in percent, in one pass."""
    rows, seen = reported(results)
    rows.write.parquet(location)
    out = dict(seen.get)
    return out | {"reduction": (1 - out["output_bytes"] / out["input_bytes"]) * 100 if out["input_bytes"] else 0.0}
