"""Line dedup: lines that several documents repeat stay only in the largest doc_id that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut, lower_ascii, unused

#: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, t1, pos, h1, h2): each line whose key is long enough; h1 and h2 are 128 bits of the key."""
    exploded = docs.select(
        docs["doc_id"].alias("doc_id"), F.xxhash64(_text(docs)).alias("t1"), F.posexplode(F.split(_text(docs), "\n", -1)).alias("pos", "line")
    )
    keyed = exploded.filter(F.char_length("line") >= min_chars).select("doc_id", "t1", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        "doc_id", "t1", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2")
    )


def rebuilt(docs: DataFrame, name: str, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` and one more column ``name``: a struct of text, n_lines and n_dropped, as ``dedup_lines`` has them."""
    lines = cut(_lines(docs, min_chars))
    common = cut(
        lines.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
        .filter(F.col("n") >= min_docs).select("h1", "h2", "last")
    )
    drops = (
        lines.join(common, ["h1", "h2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy(F.col("doc_id").alias("_doc"), F.col("t1").alias("_t1")).agg(F.collect_set("pos").alias("_drop"))
    )
    same = docs["doc_id"].eqNullSafe(drops["_doc"]) & (F.xxhash64(_text(docs)) == drops["_t1"])
    parts = F.split(_text(docs), "\n", -1)

    def kept(lines: Column) -> Column:
        """As an argument of a function the lines are split off once for a text, not again for each line."""
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(drops["_drop"], F.array().cast("array<int>")))
        return F.struct(
            F.when(drops["_drop"].isNull(), _text(docs)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")).alias("text"),
            F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(drops["_drop"]), F.lit(0)).cast("long").alias("n_dropped"),
        )

    made = F.get(F.transform(F.array(parts), kept), F.lit(0)).alias(name)
    return docs.join(drops, same, "left").select(*[docs[f"`{c}`"] for c in docs.columns], made)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with each text rebuilt from the lines that stay, and new columns n_lines, n_dropped.

    A text is split at \\n; a null or empty text is one empty line. A line's
    key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points in at least ``min_docs`` documents lose all
    their lines except in the largest doc_id that holds them, where all
    stay. Rows of one doc_id are one document for the count; each keeps or
    loses lines as that doc_id does. A null doc_id counts for no document
    and is never the largest. The columns of ``docs`` stay as they are but
    for text, which is never null afterwards, and for columns named n_lines and n_dropped,
    which give way to the new ones; ``drop_repeated_lines`` keeps those, too. An empty table stays empty.
    """
    name = unused("_lines", docs.columns)
    own = [F.col(f"{name}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return rebuilt(docs, name, min_chars, min_docs).select(*own, f"{name}.n_lines", f"{name}.n_dropped")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` without repeated lines, as ``dedup_lines`` drops them; all columns but text stay as they are, whatever their names."""
    name = unused("_lines", docs.columns)
    return rebuilt(docs, name, min_chars, min_docs).select(*[F.col(f"{name}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
