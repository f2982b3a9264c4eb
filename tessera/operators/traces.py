"""Traces of iterative searches: what the search saw, and where it should have stopped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(run: str, order: str) -> Window:
    return Window.partitionBy(run).orderBy(order)


def trailing(trace: DataFrame, run: str = "run_id", order: str = "iteration", width: int = 3) -> DataFrame:
    """``trace`` (size, input_size) with variance over the last ``width`` shares of the input, null before, and the relative change of size.

    The change is null for the first row and infinite after a size of 0.
    """
    w = _by(run, order)
    last = w.rowsBetween(1 - width, 0)
    share = F.col("size") / F.nullif("input_size", F.lit(0).cast("bigint")).cast("double")
    before = F.lag("size").over(w)
    variance = F.when(F.count(share).over(last) == width, F.var_pop(share).over(last))
    change = F.when(before == 0, float("inf")).otherwise(F.abs(F.col("size") - before) / F.nullif(before, F.lit(0).cast("bigint")).cast("double"))
    return trace.withColumns({"variance": variance, "change": change})


def early_exit(trace: DataFrame, run: str = "run_id", order: str = "iteration", least: int = 6, variance: float = 1e-6, change: float = 0.005) -> DataFrame:
    """run, exit_iteration: the first iteration from ``least`` on whose variance or change is negligible, else null."""
    done = (F.col(order) >= least) & ((F.col("variance") < variance) | (F.col("change") < change))
    return trailing(trace, run, order).groupBy(run).agg(F.min(F.when(done, F.col(order))).alias("exit_iteration"))


def streaks(trace: DataFrame, condition: Column, run: str = "run_id", order: str = "iteration") -> DataFrame:
    """``trace`` with streak: how many rows up to this one meet the condition in a row, 0 where it fails."""
    w = _by(run, order).rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(w)
    marked = trace.withColumn("_hit", F.coalesce(condition, F.lit(False))).withColumn("_island", island)
    within = Window.partitionBy(run, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("streak", F.sum(F.when(F.col("_hit"), 1).otherwise(0)).over(within)).drop("_hit", "_island")


def with_change(trace: DataFrame, column: str, run: str = "run_id", order: str = "iteration") -> DataFrame:
    return trace.withColumn("_delta", F.col(column) - F.lag(column).over(_by(run, order)))


def plateau(trace: DataFrame, column: str, run: str = "run_id", order: str = "iteration", threshold: float = 0.1, needed: int = 3) -> DataFrame:
    """run, plateau_at: the first row that ends ``needed`` changes below the threshold in a row."""
    flat = streaks(with_change(trace, column, run, order), F.abs("_delta") < threshold, run, order)
    return flat.groupBy(run).agg(F.min(F.when(F.col("streak") >= needed, F.col(order))).alias("plateau_at"))


def ceiling(trace: DataFrame, column: str, run: str = "run_id", order: str = "iteration", least: int = 3) -> DataFrame:
    """run, crf, best: the row with the best quality, the last of equals; null with fewer than ``least`` rows."""
    top = F.max_by(F.struct("crf", F.col(column).alias("best")), F.struct(F.col(column), F.col(order)))
    enough = F.count(F.lit(1)) >= least
    return trace.groupBy(run).agg(F.when(enough, top).alias("_t")).select(run, "_t.crf", "_t.best")


def zero_gain(trace: DataFrame, column: str, run: str = "run_id", order: str = "iteration", threshold: float = 5e-5) -> DataFrame:
    """run, longest: the longest streak of gains too small to count."""
    flat = streaks(with_change(trace, column, run, order), F.abs("_delta") < threshold, run, order)
    return flat.groupBy(run).agg(F.max("streak").alias("longest"))


def failures_in_a_row(trace: DataFrame, column: str, passed: Column, run: str = "run_id", order: str = "iteration", needed: int = 3) -> DataFrame:
    """run, credible_at: the first row that ends ``needed`` failures in a row, none of which beats the whole number of the best before."""
    earlier = _by(run, order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.floor(column)).over(earlier)
    marked = trace.withColumn("_no_better", F.coalesce(F.floor(column) <= best, F.lit(False)))
    found = streaks(marked, ~passed & F.col("_no_better"), run, order)
    return found.groupBy(run).agg(F.min(F.when(F.col("streak") >= needed, F.col(order))).alias("credible_at"))


def small_improvements(trace: DataFrame, column: str, run: str = "run_id", order: str = "iteration", share: float = 0.005, needed: int = 2) -> DataFrame:
    """run, stop_at: the first row that ends ``needed`` relative gains below ``share`` in a row."""
    before = F.lag(column).over(_by(run, order))
    gain = (F.col(column) - before) / F.nullif(before, F.lit(0.0))
    found = streaks(trace.withColumn("_gain", gain), F.col("_gain") < share, run, order)
    return found.groupBy(run).agg(F.min(F.when(F.col("streak") >= needed, F.col(order))).alias("stop_at"))


def eta(progress: DataFrame, total: int, run: str = "run_id", order: str = "iteration", width: int = 10) -> DataFrame:
    """``progress`` (secs of each step) with eta_secs: the mean of the last steps times what remains; null when nothing does."""
    w = _by(run, order)
    left = F.lit(total) - F.row_number().over(w)
    mean = F.avg("secs").over(w.rowsBetween(1 - width, 0))
    return progress.withColumn("eta_secs", F.when(left > 0, mean * left))


def overall_eta(elapsed: Column, done: Column, total: Column) -> Column:
    return F.when(done > 0, elapsed / F.nullif(done, F.lit(0).cast("bigint")).cast("double") * (total - done))
