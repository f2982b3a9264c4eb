"""Helpers the training-data operators share: lineage cuts, block tasks, connected components, byte-level words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most over-full cells whose sizes are sent to all tasks; the rest are blocked inside their task.
MAX_SPLIT_CELLS = 65_536


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, from ``spark.checkpoint.dir``.

    Only a local master, whose executors are the driver itself, gets a folder
    of its own if that is unset.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, which cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(column) == F.char_length(column)
    return F.when(plain, F.lower(column)).otherwise(F.translate(column, upper, upper.lower()))


def block_tasks(rows: DataFrame, cell: list[str], id_column: str, block_rows: int) -> DataFrame:
    """Deal the rows of each cell out so that no task holds more than about two blocks of ``block_rows``.

    Adds ``block``, ``block_a`` and ``block_b``. A cell of more than
    ``block_rows`` rows is hashed into blocks and each pair of its blocks
    becomes one task. Rows of one task share ``cell + [block_a, block_b]``;
    with ``block_a < block_b`` only pairs across the two blocks are new.
    Sizes of the ``MAX_SPLIT_CELLS`` fullest cells are broadcast; a cell
    beyond those is smaller than ``rows / MAX_SPLIT_CELLS`` and stays whole.
    """
    large = (
        rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_rows)
        .orderBy(F.desc("_n"), *cell).limit(MAX_SPLIT_CELLS)
        .select(*cell, F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks"))
    )
    blocks = F.coalesce(F.col("_blocks"), F.lit(1))
    dealt = rows.join(F.broadcast(large), cell, "left").withColumn(
        "block", F.pmod(F.xxhash64(F.lit("block"), F.col(id_column)), blocks).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other")
    return dealt.select("*", other).select(
        *rows.columns, "block",
        F.least("block", "_other").alias("block_a"), F.greatest("block", "_other").alias("block_b"),
    )


class Forest:
    """Labels of the components among the n rows of one task; a row's label is the least position in its component."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, row: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[row]))
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]

    def edges(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A star of edges for each component; with sorted ids the hub is the smallest."""
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        return ids[moved], ids[self.root[moved]]


#: Name of the part of the scratch folder that is in use; see ``temporary``.
_SCOPE: ContextVar[str] = ContextVar("scope", default="kept")


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/scratch-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, one of those that ``clean`` removes."""
    return f"{_scratch_root(spark)}/{_SCOPE.get()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Remove all that operators have written on their way in this application. Results that aren't read to their end or written elsewhere are lost."""
    remove(spark, _scratch_root(spark))


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What operators write on their way within this block goes at its end; their results must be written by then."""
    before = _SCOPE.set(uuid.uuid4().hex)
    try:
        yield
    finally:
        remove(spark, f"{_scratch_root(spark)}/{_SCOPE.get()}")
        _SCOPE.reset(before)


def written(df: DataFrame, parts: int | None = None) -> DataFrame:
    """``df`` as Parquet in the shared checkpoint folder, in at most ``parts`` files, read back.

    For loops: a checkpoint keeps what Spark estimated of its size, and the
    estimates of joins multiply from round to round, to numbers of so many
    digits that planning takes minutes. Files tell their true size. They stay
    until ``forget`` or ``clean``.
    """
    folder = scratch(df.sparkSession, "written")
    (df.coalesce(parts) if parts else df).write.parquet(folder)
    back = df.sparkSession.read.schema(df.schema).parquet(folder)
    back._scratch = folder
    return back


def forget(*frames: DataFrame) -> None:
    """Remove the files of frames that ``written`` gave, once nothing reads them any more."""
    for frame in frames:
        remove(frame.sparkSession, frame._scratch)


#: Edges of one file of the rounds of connected components.
FILE_EDGES = 500_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (a, b) reaches.

    Alternating large-star and small-star rounds; each halves the depth of
    the trees, until they are stars. Edges and minima are written to the checkpoint folder each
    round, so that lost executors cost one step and both sides of each join
    are plain scans, which lets Spark split a hub's partition. Files are as many as the edges need, and a round's go when the next one's are there.
    """
    edges = written(_pairs(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    parts = 1 + 2 * edges.count() // FILE_EDGES
    while not _stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), parts)
        large = _pairs(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = written(large, parts)
        lower = written(large.groupBy("a").agg(F.min("b").alias("m")), parts)
        joined = large.join(lower, "a")
        small = joined.select("b", "m").union(joined.select(F.col("a").alias("b"), "m"))
        nearer = written(_pairs(small.select(F.col("b").alias("a"), F.col("m").alias("b"))), parts)
        forget(edges, least, large, lower)
        edges = nearer
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a lesser one, which itself has none: then that one is the component's least node."""
    ends = edges.select("a", F.lit(1).alias("down"), F.lit(0).alias("hub")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("a").agg(F.sum("down").alias("down"), F.max("hub").alias("hub")).filter("down > 1 or down = 1 and hub = 1").isEmpty()


# --- words of many texts at once -------------------------------------------------------------

#: Bytes of text that one step of the array code takes together.
CHUNK_BYTES = 1_000_000
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.full(1, _BASE, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the splitmix64 finaliser, fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: Iterable[bytes], at_least: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in runs of about ``at_least`` bytes; a text is never cut."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= at_least:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


class Words:
    """Words (runs of digits, letters and non-ASCII after A-Z lower-casing) of some texts, as arrays.

    ``start`` and ``end`` are byte offsets into ``data``, ``text`` the index of
    the text, ``hash`` 64 bits of the lower-cased word, ``first[i]`` the number
    of words before text i (one entry more than texts).
    """

    def __init__(self, texts: list[bytes]):
        global _powers
        self.data = b"\n".join(texts) + b"\n"
        lowered = np.frombuffer(self.data.translate(LOWER), np.uint8)
        self.offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
        word = _WORD[lowered]
        edge = np.diff(word, prepend=False, append=False)
        edges = np.flatnonzero(edge)
        self.start, self.end = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.offset)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        length = self.end - self.start
        if len(length) and length.max() > len(_powers):
            _powers = np.cumprod(np.full(int(length.max()) + 1, _BASE, np.uint64))
        if len(length):
            letters = lowered[word].astype(np.uint64)
            before = np.cumsum(length) - length
            place = np.arange(len(letters)) - np.repeat(before, length)
            total = np.add.reduceat((letters + np.uint64(1)) * _powers[place], before)
            self.hash = mix(total + length.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)


def encoded(texts: pd.Series) -> list[bytes]:
    """UTF-8 of each text, b"" for null."""
    return [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]


def ids_and_texts(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id string, text string, ...) for tasks in Python: numbers that may be null would become floating there."""
    return docs.select(docs["doc_id"].cast("string").alias("doc_id"), docs["text"].cast("string").alias("text"), *more)


def with_long_ids(found: DataFrame, column: str = "doc_id") -> DataFrame:
    return found.withColumn(column, F.col(column).cast("long"))


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores behind it as no column of ``columns`` has that name, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
