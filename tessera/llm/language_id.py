"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import CHUNK_BYTES, chunks, encoded, mix, unused

#: Bytes of the n-grams, n-grams kept for each language, and the share of its training texts that must hold one.
GRAM, MAX_GRAMS, MIN_SHARE = 4, 20_000, 0.02
#: Distinct texts of each language in the bounded training sample, about; never more than twice as many.
SAMPLE_TEXTS = 4_000
#: log2 of the filter's positions, and positions a member sets.
BITS, HASHES = 18, 3
UNKNOWN = "und"
_KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def normalised(text: bytes) -> bytes:
    """Lower case with everything but letters and non-ASCII as single spaces, one space at both ends."""
    return b" " + b" ".join(text.decode("utf-8", "replace").lower().encode("utf-8").translate(_KEEP).split()) + b" "


def grams(data: np.ndarray, n: int = GRAM) -> np.ndarray:
    """The n-byte windows of ``data`` as numbers."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(data) - n + 1, np.uint64)
    for k in range(n):
        out |= data[k : len(data) - n + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    return out


def positions(values: np.ndarray, bits: int = BITS) -> Iterator[np.ndarray]:
    """The filter positions of each n-gram."""
    spread = mix(values)
    for k in range(HASHES):
        yield (spread >> np.uint64(k * 21)) & np.uint64((1 << bits) - 1)


@dataclass
class LanguageFilter:
    """A mask of languages at each position; the AND of an n-gram's positions holds all languages that have it.

    A mask is one byte, or as many 64-bit words as the languages need.
    """

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    fallback: str

    @classmethod
    def build(cls, members: dict[str, np.ndarray], fallback: str) -> LanguageFilter:
        languages = sorted(members)
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        width = 8 * np.dtype(kind).itemsize
        masks = np.zeros((1 << BITS, max(1, -(-len(languages) // width))), kind)
        fill = np.zeros(len(languages))
        for k, lang in enumerate(languages):
            word, bit = masks[:, k // width], kind(1 << k % width)
            for place in positions(members[lang]):
                word[place] |= bit
            fill[k] = (word & bit != 0).mean()
        return cls(languages, masks, fill**HASHES, fallback)

    def rates(self, texts: list[bytes]) -> np.ndarray:
        """For each text and language the share of its n-grams in that language, less what false positives add."""
        out = np.zeros((len(texts), len(self.languages)))
        for first, part in chunks(map(normalised, texts)):
            counts, totals = self._counts(part)
            share = counts / np.maximum(totals, 1)[:, None]
            out[first : first + len(part)] = np.clip((share - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)
        return out

    def languages_of(self, values: np.ndarray) -> np.ndarray:
        """The mask of all languages that have each n-gram."""
        found = np.full((len(values), self.masks.shape[1]), np.iinfo(self.masks.dtype).max, self.masks.dtype)
        for place in positions(values):
            found &= self.masks[place]
        return found

    def _counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the n-grams that each language has, and all of them."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        found = np.zeros((len(data), self.masks.shape[1]), self.masks.dtype)
        for at in range(0, len(data), CHUNK_BYTES):
            values = grams(data[at : at + CHUNK_BYTES + GRAM - 1])
            found[at : at + len(values)] = self.languages_of(values)
        for k in range(1, GRAM):  # windows across two texts count for neither
            found[np.maximum(starts[1:] - k, 0)] = 0
        kind, width = self.masks.dtype.type, 8 * self.masks.dtype.itemsize
        held = [np.add.reduceat(((found[:, k // width] >> kind(k % width)) & kind(1)).astype(np.int64), starts) for k in range(len(self.languages))]
        return np.stack(held, axis=1), np.array([max(0, len(t) - GRAM + 1) for t in texts])

    def predict(self, texts: pd.Series) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rate of that language) for each text."""
        has_letter = np.array([isinstance(t, str) and any(map(str.isalpha, t)) for t in texts], bool)
        rates = self.rates(encoded(texts)) if self.languages else np.zeros((len(texts), 0))
        names, score, best_rate = [], np.zeros(len(texts)), np.zeros(len(texts))
        for i, known in enumerate(has_letter):
            if not known or not self.languages:
                names.append(UNKNOWN)
                continue
            k = int(rates[i].argmax())
            best_rate[i] = rates[i, k]
            names.append(self.languages[k] if rates[i, k] > 0 else self.fallback)
            score[i] = rates[i, k] / rates[i].sum() if rates[i, k] > 0 else 0.0
        return names, score, best_rate


def train_filter(labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS, max_grams: int = MAX_GRAMS, min_share: float = MIN_SHARE) -> LanguageFilter:
    """Fit on ``labelled`` (text, lang): the n-grams that at least ``min_share`` of a language's texts hold.

    The sample has about ``sample_texts`` distinct whole texts of each language, or all it has, chosen
    by the hash of the text; copies count once. Every language is learned. Null texts and languages are left out, empty tables teach nothing.
    """
    rows = labelled.filter("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    spark = labelled.sparkSession
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("distinct"), F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return LanguageFilter.build({}, UNKNOWN)
    rate = spark.createDataFrame([(r["lang"], min(1.0, sample_texts / r["distinct"])) for r in counts], "lang string, rate double")
    chance = F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(rate), "lang").filter(chance < F.col("rate")).select("lang", "text").distinct()

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang", sort=False):
                for _, texts in chunks(encoded(part["text"])):
                    each = [np.unique(grams(np.frombuffer(normalised(t), np.uint8))) for t in texts]
                    value, n = np.unique(np.concatenate(each), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": value.view(np.int64), "n": n, "texts": 0})
                yield pd.DataFrame({"lang": [lang], "gram": [-1], "n": [0], "texts": [len(part)]})

    grouped = sample.mapInPandas(held, "lang string, gram long, n long, texts long")
    summed = grouped.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    sizes = {r["lang"]: r["texts"] for r in summed.filter("gram = -1").collect()}
    need = spark.createDataFrame([(k, max(2.0 if v > 1 else 1.0, min_share * v)) for k, v in sizes.items()], "lang string, need double")
    frequent = summed.filter("gram >= 0").join(F.broadcast(need), "lang").filter("n >= need")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = frequent.withColumn("place", place).filter(F.col("place") <= max_grams).select("lang", "gram").toPandas()
    members = {lang: part["gram"].to_numpy(np.int64).view(np.uint64) for lang, part in best.groupby("lang")}
    return LanguageFilter.build(members, counts[0]["lang"])


def with_language(docs: DataFrame, model: LanguageFilter, name: str) -> DataFrame:
    """``docs`` and one more column ``name``: a struct of lang_pred, score and rate. Only texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rate double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, score, rate = shared.value.predict(texts)
            yield pd.DataFrame({"lang_pred": names, "score": score, "rate": rate})

    return docs.select("*", predicted(F.col("text").cast("string")).alias(name))


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """``docs`` with lang_pred, score and rate, from the whole text alone.

    lang_pred is ``und`` where the text is null or has no letter, or nothing was learned; score is the share
    that the winner has of all languages' corrected rates, rate its own rate. A text
    whose n-grams no language has gets the most frequent language with score 0.
    Ties go to the first language by name. Rows may repeat; an empty table stays empty. Other columns stay as they are, but columns named
    lang_pred, score and rate give way to the new ones; ``with_language`` and ``session_filter`` keep those, too.
    """
    name, new = unused("_language", docs.columns), ("lang_pred", "score", "rate")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    return with_language(docs, model, name).select(*own, *[f"{name}.{c}" for c in new])


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def train_on_documents(docs: DataFrame) -> LanguageFilter:
    return train_filter(docs.filter(~F.coalesce(held_out(), F.lit(False))))


def session_filter(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without those that no language claims: null texts, texts without letters, and texts of which no n-gram is known.

    Learns from the rows of ``docs`` that aren't held out. All columns stay as
    they are, whatever their names; repeated rows stay; where nothing can be learned no row stays.
    """
    name = unused("_language", docs.columns)
    named = with_language(docs, train_on_documents(docs), name)
    return named.filter((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.rate") > 0)).drop(name)
