"""When files were made, by the most trusted of their dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import values as V
from tessera.functions import dates


def best_dates(files: DataFrame, **years: int) -> DataFrame:
    """``files`` with best_date, date_source and all_dates, a map of what each source says.

    The date is that of the source with the highest priority whose text is a date; None names no source.
    The texts are one array, which is parsed element by element: six copies of the parser would make generated code too large to compile.
    """
    known = [(c, label) for c, label in V.DATE_SOURCES if c in files.columns]
    stamps = F.transform(F.array(*[F.col(c) for c, _ in known]), lambda t: dates.parsed(t, **years))
    named = F.zip_with(stamps, F.array(*[F.lit(label) for _, label in known]), lambda d, s: F.struct(d.alias("date"), s.alias("source")))
    said = F.map_filter(F.create_map(*[x for c, label in known for x in (F.lit(label), F.col(c))]), lambda _, v: v.isNotNull())
    found = files.select("*", F.get(F.filter(named, lambda x: x["date"].isNotNull()), F.lit(0)).alias("_best"), said.alias("all_dates"))
    return found.select(*files.columns, F.col("_best.date").alias("best_date"), F.coalesce("_best.source", F.lit("None")).alias("date_source"), "all_dates")


def by_source(dated: DataFrame) -> DataFrame:
    return dated.groupBy("date_source").agg(F.count(F.lit(1)).alias("files"))


def by_year(dated: DataFrame) -> DataFrame:
    """year, files, percent: whole percent of the dated files, cut off."""
    years = dated.filter("best_date is not null").groupBy(F.year("best_date").alias("year")).agg(F.count(F.lit(1)).alias("files"))
    share = F.col("files") / F.sum("files").over(Window.partitionBy()).cast("double") * 100.0
    return years.withColumn("percent", share.cast("int"))


def top_months(dated: DataFrame, n: int = 15) -> DataFrame:
    """month, files of the months with most files; ties by month."""
    months = dated.filter("best_date is not null").groupBy(F.date_format("best_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("files"))
    return months.orderBy(F.desc("files"), "month").limit(n)


def date_range(dated: DataFrame) -> DataFrame:
    """Which file is earliest and which latest; of several the first path, and the last."""
    row = F.struct("path", "best_date", "date_source")
    order = F.struct("best_date", "path")
    found = dated.filter("best_date is not null").agg(F.min_by(row, order).alias("earliest"), F.max_by(row, order).alias("latest"))
    return found.selectExpr("stack(2, 'earliest', earliest, 'latest', latest) as (which, file)").select("which", "file.*").filter("path is not null")


def totals(dated: DataFrame) -> DataFrame:
    return dated.agg(F.count(F.lit(1)).alias("total"), F.count("best_date").alias("dated")).withColumn("undated", F.col("total") - F.col("dated"))
