"""Source divergence audit: how far the words of a language's sources lie from each other, and which words make the difference."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import LOWER, encoded, written

#: Probabilities are whole numbers of this share of one, and each count stands for so many more.
UNIT, PRIOR = 1_000_000_000, 5
#: Distinct counts that a task holds before it passes them on.
HELD_COUNTS = 200_000
#: Postings of one task of pairs, and sources of one of its two sides.
TASK_POSTINGS, TASK_SOURCES = 200_000, 256
#: Counts below this are buckets of their own; above, each doubling has so many buckets.
EXACT_COUNTS, OCTAVE = 32, 16
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _named(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences of each term in each group, and documents that hold it; a row without term for each group."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], dict] = {}
        size = 0

        def passed() -> pd.DataFrame:
            shown = lambda t: None if t is None else t.decode("utf-8", "replace")
            rows = [(*group, shown(term), n, d) for group, terms in held.items() for term, (n, d) in terms.items()]
            return pd.DataFrame(rows, columns=["lang", "source", "term", "n", "d"], dtype=object)

        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], encoded(batch["text"])):
                terms = held.setdefault((lang, source), {None: (0, 0)})
                size -= len(terms)
                mine: dict[bytes, int] = {}
                for term in _TERM.findall(text.translate(LOWER)):
                    mine[term] = mine.get(term, 0) + 1
                for term, n in mine.items():
                    old = terms.get(term, (0, 0))
                    terms[term] = (old[0] + n, old[1] + 1)
                size += len(terms)
                if size > HELD_COUNTS:
                    yield passed()
                    held, size = {}, 0
        yield passed()

    texts = docs.select(_named(docs["lang"]).alias("lang"), _named(docs["source"]).alias("source"), docs["text"].cast("string").alias("text"))
    found = texts.mapInPandas(counted, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _probability(count: str, total: str, terms: str) -> Column:
    """One and the whole part of UNIT * (count + PRIOR) / (total + PRIOR * terms), exact at any size; null without terms."""
    wide = lambda c: f"CAST({c} AS DECIMAL(20,0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + ({UNIT} * ({wide(count)} + {PRIOR})) div ({wide(total)} + {PRIOR} * {wide(terms)}) END")


def tables(docs: DataFrame, min_docs: int = 30) -> tuple[DataFrame, DataFrame]:
    """(groups, postings), both written.

    groups: lang, source, v (kept terms of the lang), p0 (probability of a term that the group lacks, null if v is 0).
    postings: lang, source, term, n, p, q for kept terms that the group has.
    """
    counts = written(term_counts(docs))
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("c"), F.sum("d").alias("d")).filter(F.col("d") >= min_docs)
    kept = written(kept.select("lang", "term", "c"))
    langs = written(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("c_all")))
    kept = kept.join(langs, "lang").select("lang", "term", _probability("c", "c_all", "v").alias("q"))
    postings = written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "q"))
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    groups = (
        counts.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", F.coalesce("n_all", F.lit(0)).alias("n_all"), F.coalesce("v", F.lit(0)).alias("v"))
    )
    groups = written(groups.withColumn("p0", _probability("0", "n_all", "v")))
    postings = written(postings.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", _probability("n", "n_all", "v").alias("p"), "q"))
    return groups.select("lang", "source", "v", "p0"), postings


def _best(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def leading_terms(postings: DataFrame, top: int = 50) -> DataFrame:
    """(lang, source, item, value, rank): the ``top`` terms that a group has most above its lang.

    A group's terms lie in buckets by their count. The largest probability of a bucket and the least that
    the lang gives any of its terms bound all differences in it. The buckets are searched best
    first: those of the highest bounds until they hold ``top`` terms, whose kth difference is then known, and of the rest
    all whose bound isn't strictly below it; an equal one may hold a term that comes first by name. A group of fewer terms has all of them.
    """
    bucket = F.when(F.col("n") < EXACT_COUNTS, F.col("n")).otherwise(F.floor(F.log2(F.col("n").cast("double")) * OCTAVE) + EXACT_COUNTS).cast("long")
    above = postings.filter("p > q").withColumn("bucket", bucket).select("lang", "source", "bucket", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), "p", "q")
    key = ["lang", "source", "bucket"]
    bounds = above.groupBy(*key).agg(F.count(F.lit(1)).alias("terms"), (F.max("p") - F.min("q")).alias("bound"))
    ahead = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = written(bounds.withColumn("before", F.coalesce(F.sum("terms").over(ahead), F.lit(0))))
    first = written(_best(above.join(bounds.filter(F.col("before") < top), key).select("lang", "source", "item", "value"), top))
    kth = first.filter(F.col("rank") == top).select("lang", "source", F.col("value").alias("kth"))
    open_ = bounds.filter(F.col("before") >= top).join(kth, ["lang", "source"]).filter("bound >= kth").select(*key)
    later = above.join(open_, key).select("lang", "source", "item", "value")
    return _best(first.drop("rank").unionByName(later), top)


def _distances(group: pd.DataFrame) -> pd.DataFrame:
    """Sums over the terms of one task: the pairs of its two sides' sources, each both ways.

    All sources have header rows, without a term. The postings of a source are held against all others' postings
    of the same terms; what is left of the two sides follows from the probabilities that they give to terms they lack.
    """
    head = group[group["term"].isna()].sort_values("source")
    names, blank, side = head["source"].to_numpy(), head["p0"].fillna(0).to_numpy(np.int64), head["block"].to_numpy()
    posted = group[group["term"].notna()]
    terms = pd.factorize(posted["term"])[0]
    n_terms = int(terms.max()) + 1 if len(terms) else 0
    owner = np.searchsorted(names, posted["source"].to_numpy()) if len(terms) else np.zeros(0, np.int64)
    p = posted["p"].to_numpy(np.int64)
    rows = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[rows], np.arange(len(names) + 1))
    first = bool((group["part"] == 0).any())
    v = head["v"].to_numpy(np.int64)
    out = []
    for g in range(len(names)):
        mine = rows[starts[g] : starts[g + 1]]
        own = np.full(n_terms, blank[g])
        own[terms[mine]] = p[mine]
        values, times = np.unique(own, return_counts=True)
        total = (np.abs(values[:, None] - blank) * times[:, None]).sum(axis=0)  # as if the others had none of the terms
        more = np.abs(own[terms] - p) - np.abs(own[terms] - blank[owner])
        total += np.rint(np.bincount(owner, weights=more, minlength=len(names))).astype(np.int64)
        total += ((v if first else 0) - n_terms) * np.abs(blank - blank[g])
        others = np.flatnonzero((np.arange(len(names)) != g) & ((side != side[g]) | (side.min() == side.max())))
        out.append(pd.DataFrame({"source": names[g], "item": names[others], "value": total[others]}))
    found = pd.concat(out).astype({"source": object, "item": object})
    return found.assign(lang=group["lang"].iloc[0])[["lang", "source", "item", "value"]]


def source_distances(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each two sources of a lang the sum of their terms' differences.

    Postings of a term meet in one task; a lang's terms are dealt to tasks of about ``TASK_POSTINGS`` rows and its sources to blocks of
    ``TASK_SOURCES``, of which each two are a task. A task adds up its terms, so that no row is made for a term and a pair.
    """
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TASK_SOURCES).cast("int").alias("blocks"))
    heavy = postings.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TASK_POSTINGS).cast("int").alias("parts"))
    plan = written(sizes.join(heavy, "lang", "left").select("lang", "blocks", F.coalesce("parts", F.lit(1)).alias("parts")))
    block = F.pmod(F.xxhash64(F.lit("block"), "source"), F.col("blocks")).cast("int").alias("block")
    head = groups.join(plan, "lang").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), "p0", "v", "blocks", block,
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    body = postings.join(plan, "lang").select(
        "lang", "source", "term", "p", F.lit(None).cast("long").alias("p0"), F.lit(None).cast("long").alias("v"), "blocks", block,
        F.pmod(F.xxhash64(F.lit("part"), "term"), F.col("parts")).cast("int").alias("part"),
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = head.unionByName(body).select("*", other).select(
        "lang", "source", "term", "p", "p0", "v", "part", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")
    )
    schema = "lang string, source string, item string, value long"
    return rows.groupBy("lang", "part", "a", "b").applyInPandas(_distances, schema).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how the sources of each lang differ.

    Null text, lang and source of ``docs`` count as ''. Terms are runs of letters and non-ASCII characters, A-Z lower-cased; a lang keeps
    those of at least ``min_docs`` of its rows. Each (lang, source) and each lang gives each kept term a probability in UNITs, with
    PRIOR more than its count. Part `pair` has each other source of the lang, by the sum of the absolute differences over all kept terms, 0 if the
    lang keeps none; part `term` the ``top`` kept terms that the source has and whose probability lies most above the lang's.
    Ranks are from 1 in each group and part; ties go by the item's bytes. Repeated rows are documents of their own; an empty table gives no
    row, a lang with one source no pair; other columns are ignored.
    """
    groups, postings = tables(docs, min_docs)
    pairs = source_distances(groups, postings)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    named = pairs.unionByName(leading_terms(postings, top).withColumn("part", F.lit("term")))
    return named.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
