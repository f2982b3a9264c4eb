"""Piecewise linear mapping between two measures, each query between its nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import settle

_POINT = "struct<x:double,y:double>"


def _in_parts(rows: DataFrame) -> DataFrame:
    """``rows`` (_by, _x, _kind, _point) with _part, _before (the last two points at or before the row in its part and run) and _after (the next two)."""
    rows = settle(rows.repartitionByRange("_by", "_x", "_kind").withColumn("_part", F.spark_partition_id()))
    run = Window.partitionBy("_part", "_by")
    # behind a query stands the point at its own x, so that it lies before the query
    up, down = run.orderBy("_x", F.desc("_kind")), run.orderBy(F.desc("_x"), "_kind")
    past = lambda window, column, upto: F.last(column, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, upto))
    pair = lambda other: F.when(F.col("_point").isNotNull(), F.struct(F.col("_point").alias("near"), other.alias("far")))
    rows = rows.withColumns({"_low": pair(past(up, "_point", -1)), "_high": pair(past(down, "_point", -1))})
    return rows.withColumns({"_before": past(up, "_low", 0), "_after": past(down, "_high", -1)})


def _carried(rows: DataFrame) -> DataFrame:
    """(_part, _by, _earlier, _later): for each part of a run the last two points of the parts before it and the first two of those behind it."""
    ends = rows.filter("_point is not null").groupBy("_part", "_by").agg(
        F.max_by(F.struct("_point", "_low"), "_x").alias("last"), F.min_by(F.struct("_point", "_high"), "_x").alias("first")
    )
    parts = rows.select("_part", "_by").distinct().join(ends, ["_part", "_by"], "left")
    run = Window.partitionBy("_by")

    def gathered(window, end: str, pair: str) -> Column:
        """The nearest two points of the other parts: the outermost part with points has one at least, the next one the other."""
        near = F.last(end, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
        listed = F.collect_list(f"{end}._point").over(window.rowsBetween(Window.unboundedPreceding, -1))
        second = F.get(listed, F.size(listed) - 2)
        return F.when(near.isNotNull(), F.struct(near["_point"].alias("near"), F.coalesce(near[pair]["far"], second).alias("far")))

    return parts.select(
        "_part", "_by", gathered(run.orderBy("_part"), "last", "_low").alias("_earlier"), gathered(run.orderBy(F.desc("_part")), "first", "_high").alias("_later")
    )


def predict(queries: DataFrame, points: DataFrame, key: list[str], x: str = "psnr", y: str = "ssim", by: str = "run_id") -> DataFrame:
    """``key``, predicted: y at each query's x from the calibration points of the same ``by``; beyond them the outermost two go on.

    Points at one x count once, with their highest y; points and queries without x or ``by`` have none. Null with fewer than two
    points. Queries and points are sorted together by run and x into parts of about the same size, so a long run is many tasks' work; what a part lacks at
    its ends comes from its neighbours, of which each run and part has one row.
    """
    once = points.filter(F.col(by).isNotNull() & F.col(x).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(x).cast("double").alias("_x")).agg(F.max(y).cast("double").alias("_y"))
    marked = once.select("_by", "_x", F.lit(1).alias("_kind"), F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")).cast(_POINT).alias("_point"))
    asked = queries.select(F.col(by).alias("_by"), F.col(x).cast("double").alias("_x"), F.lit(0).alias("_kind"), F.struct(*key).alias("_key"))
    usable = F.col("_by").isNotNull() & F.col("_x").isNotNull()
    rows = _in_parts(asked.filter(usable).unionByName(marked, allowMissingColumns=True))
    carried = _carried(rows)
    met = rows.filter("_kind = 0").join(carried, ["_part", "_by"], "left")
    # two points before and two behind: the nearest are the part's own, as far as it has them
    joined = lambda own, other: F.struct(
        F.coalesce(F.col(own)["near"], F.col(other)["near"]).alias("near"),
        F.when(F.col(own).isNotNull(), F.coalesce(F.col(own)["far"], F.col(other)["near"])).otherwise(F.col(other)["far"]).alias("far"),
    )
    met = met.withColumns({"low": joined("_before", "_earlier"), "high": joined("_after", "_later")})
    low, high = F.col("low"), F.col("high")
    a = F.when(low["near"].isNull(), high["near"]).when(high["near"].isNull(), low["far"]).otherwise(low["near"])
    b = F.when(low["near"].isNull(), high["far"]).when(high["near"].isNull(), low["near"]).otherwise(high["near"])
    value = a["y"] + (F.col("_x") - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0)) * (b["y"] - a["y"])
    none = asked.filter(~F.coalesce(usable, F.lit(False))).select("_key.*", F.lit(None).cast("double").alias("predicted"))
    return met.select("_key.*", value.alias("predicted")).unionByName(none)


def mapping_quality(points: DataFrame, by: str = "run_id") -> DataFrame:
    """by, quality: trust in a calibration by its number of points."""
    n = F.count(F.lit(1))
    return points.groupBy(by).agg(F.when(n < 3, 0.5).otherwise(F.least(0.6 + F.least(n / 20.0, F.lit(0.35)), F.lit(0.95))).alias("quality"))
