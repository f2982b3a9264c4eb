"""The corpus pipeline: five stages, each of which works on all that its predecessor kept.

All but the last return the columns they get, whatever their names; only text and n_chars change. Repeated rows are judged
alike, but for near duplicates, of which one row stays. An empty table gives empty tables throughout.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.language_id import session_filter
from tessera.llm.line_dedup import drop_repeated_lines
from tessera.llm.packing import pack_documents
from tessera.llm.shared import shared_folder, table, temporary
from tessera.llm.simhash import drop_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no language claims: null texts, texts without letters, and those of which no learned language has any n-gram."""
    return session_filter(spark, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; no row goes, a null text becomes empty, and n_chars, where there is such a column, follows the text."""
    kept = drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near duplicates, that of the least doc_id; rows without doc_id stay, texts without words are one group."""
    return drop_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; its columns are the packing's own."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language), ("line_dedup", lines), ("simhash", near_duplicates),
    ("decontaminate", benchmark_leaks), ("packing", packing),
]

#: The filters are fitted and the packing is greedy, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with temporary(spark):  # a stage that is written needs nothing of what it left on its way
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
