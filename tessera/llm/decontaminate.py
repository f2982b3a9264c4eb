"""Benchmark decontamination by canonical templates, which also finds re-parameterised questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Words, chunks, cut, encoded, ids_and_texts, mix, with_long_ids

#: Words of a window, words that a window must hold besides placeholders, and windows of an item that a document must share.
WINDOW, MIN_LITERAL, MIN_WINDOWS = 8, 4, 6
#: Items of fewer words are no evidence.
MIN_ITEM_WORDS = 5
#: Benchmark windows up to this number are broadcast as a prefilter; beyond it every window is joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: Units that are placeholders after a number.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams lb lbs pound pounds oz ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years dollar dollars euro euros cent cents usd eur percent degree degrees km2 m2 m3 kmh mph w kw v hz mb gb tb"
).split()
_NUMBER, _UNIT, _NAME, _PLAIN = (np.uint64(k) for k in (0xA5A5_0001, 0xA5A5_0002, 0xA5A5_0003, 0xA5A5_0004))
_ODD = np.uint64(0x100000001B3)


class Templates:
    """Word values of some texts, their typed placeholders, and the hashes of their windows."""

    def __init__(self, words: Words, names: bool):
        self.words = words
        data = np.frombuffer(words.data, np.uint8)
        n = len(words.start)
        unit_hashes = np.sort(Words([" ".join(UNITS).encode()]).hash)
        digit = (data >= 0x30) & (data <= 0x39)
        digits = np.concatenate([[0], np.cumsum(digit)])
        number = digits[words.end] - digits[words.start] == words.end - words.start if n else np.zeros(0, bool)
        after = np.concatenate([[False], number[:-1]]) if n else number
        after[words.first[:-1][words.first[:-1] < n]] = False
        at = np.minimum(np.searchsorted(unit_hashes, words.hash), len(unit_hashes) - 1)
        unit = after & (unit_hashes[at] == words.hash)
        name = np.zeros(n, bool)
        if names and n:
            first = data[words.start]
            second = data[np.minimum(words.start + 1, len(data) - 1)]
            capital = ((first >= 0x41) & (first <= 0x5A)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
            ends = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b".!?:\n\"", np.uint8)))])
            before = np.concatenate([[0], words.end[:-1]])
            opens = ends[words.start] > ends[before]
            opens[words.first[:-1][words.first[:-1] < n]] = True
            name = capital & ~opens
        self.slot = number | unit | name
        self.value = words.hash
        self.shown = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, words.hash)))

    def windows(self, width: int, min_literal: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the windows inside one text that hold enough literal words."""
        good, out, _ = self._hashed(width, min_literal, self.shown)
        return good, mix(out[good] + np.uint64(width))

    def plain_windows(self, width: int, min_literal: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the windows inside one text that hold too few, with every word as it is."""
        good, out, inside = self._hashed(width, min_literal, self.value)
        inside[good] = False
        rest = np.flatnonzero(inside)
        return rest, mix(out[rest] + _PLAIN + np.uint64(width))

    def _hashed(self, width: int, min_literal: int, shown: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows with enough literal words, sums of all windows, and which of them lie inside one text."""
        n = len(shown) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        out, slots = np.zeros(n, np.uint64), np.zeros(n, np.int8)
        for k in range(width):
            out = out * _ODD + mix(shown[k : n + k] + np.uint64(k))
            slots += self.slot[k : n + k]
        text = self.words.text
        inside = text[:n] == text[width - 1 :]
        return np.flatnonzero(inside & (width - slots >= min_literal)), out, inside

    def slots(self, firsts: np.ndarray, width: int) -> pd.Series:
        value = self.value.view(np.int64)
        return pd.Series([value[i : i + width][self.slot[i : i + width]].tolist() for i in firsts.tolist()], dtype=object)


def no_slots(firsts: np.ndarray) -> pd.Series:
    return pd.Series([[]] * len(firsts), dtype=object)


def every_window(words: Words, width: int) -> list[tuple[np.ndarray, np.ndarray, Templates | None]]:
    """(first word, hash, what has the slots): windows with names as placeholders and without, and those with too few literal words, plain."""
    named, literal = Templates(words, True), Templates(words, False)
    least = min(MIN_LITERAL, width)
    return [(*named.windows(width, least), named), (*literal.windows(width, least), literal), (*literal.plain_windows(width, least), None)]


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, need, need_free, width, pos, h, plain, item_slots): windows of each benchmark text, with and without names as placeholders.

    An item of fewer than ``WINDOW`` words is one window of its own width. Windows with too few literal words have
    every word as it is, and no slots. A leak has ``need`` windows of any kind, or ``need_free`` of those that may be reworded.
    """

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, part in chunks(encoded(batch["text"])):
                words = Words(part)
                sizes = np.diff(words.first)
                for width in sorted({min(WINDOW, int(s)) for s in sizes if s >= MIN_ITEM_WORDS}):
                    found = every_window(words, width)
                    canonical = np.bincount(words.text[found[1][0]], minlength=len(sizes))
                    need, need_free = np.minimum(MIN_WINDOWS, sizes - width + 1), np.where(canonical > 0, np.minimum(MIN_WINDOWS, canonical), MIN_WINDOWS)
                    for at, h, t in found:
                        mine = np.minimum(sizes[words.text[at]], WINDOW) == width
                        at, h = at[mine], h[mine]
                        text = words.text[at]
                        yield pd.DataFrame({
                            "item_id": batch["item_id"].to_numpy()[first + text], "need": need[text], "need_free": need_free[text], "width": width,
                            "pos": at - words.first[text], "h": h.view(np.int64), "plain": t is None, "item_slots": t.slots(at, width) if t else no_slots(at),
                        })

    schema = "item_id long, need int, need_free int, width int, pos long, h long, plain boolean, item_slots array<long>"
    rows = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(cut_up, schema).distinct()


def document_windows(docs: DataFrame, wanted: np.ndarray | None, widths: list[int]) -> DataFrame:
    """(doc_id, t1, pos, h, doc_slots): windows of whole texts; with ``wanted`` (sorted hashes) only those."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, part in chunks(encoded(batch["text"])):
                words = Words(part)
                for width in widths:
                    for at, h, t in every_window(words, width):
                        if shared.value is not None:
                            hit = np.minimum(np.searchsorted(shared.value, h), len(shared.value) - 1)
                            hit = shared.value[hit] == h
                            at, h = at[hit], h[hit]
                        row = first + words.text[at]
                        yield pd.DataFrame({
                            "doc_id": batch["doc_id"].array[row], "t1": batch["t1"].to_numpy()[row], "pos": at - words.first[words.text[at]],
                            "h": h.view(np.int64), "doc_slots": t.slots(at, width) if t else no_slots(at),
                        })

    rows = ids_and_texts(docs, F.xxhash64(docs["text"].cast("string")).alias("t1"))
    return with_long_ids(rows.mapInPandas(cut_up, "doc_id string, t1 long, pos long, h long, doc_slots array<long>"))


def rare_windows(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(h, item_id): for each item the windows at its rarest places, of which every leak has one; ``found`` are the documents' windows.

    A leak lacks fewer places than all but ``need``, so as many places and one more, whichever they are, meet every leak. Those
    are taken that make the fewest pairs of items and documents: by the number of items that share the window times that of its places in documents. So neither a phrase which many
    items begin with nor one that many documents quote makes pairs.
    """
    key = ["item_id", "need", "need_free"]
    shared = wanted.groupBy("h").agg(F.count_distinct("item_id").alias("items"))
    met = found.groupBy("h").agg(F.count(F.lit(1)).alias("met"))
    shared = shared.join(met, "h", "left").select("h", (F.col("items") * F.coalesce("met", F.lit(0))).alias("pairs"))
    places = wanted.join(shared, "h").groupBy(*key, "pos", "plain").agg(F.max("pairs").alias("pairs"))
    every, kind = Window.partitionBy(*key), Window.partitionBy(*key, "plain")
    rank = lambda w, needed: F.row_number().over(w.orderBy("pairs", "pos")) <= F.count(F.lit(1)).over(w) - F.col(needed) + 1
    rare = places.select(*key, "pos", (rank(every, "need") | ~F.col("plain") & rank(kind, "need_free")).alias("rare")).filter("rare")
    return wanted.join(rare, [*key, "pos"], "left_semi").select("h", "item_id").distinct()


def united(places: str) -> Column:
    return F.size(F.array_distinct(F.flatten(F.collect_set(places)))).cast("long")


def contamination(docs: DataFrame, items: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, t1, item_id, n_windows, n_item, reworded) for each document and benchmark item that it leaks.

    Numbers, units after a number, and capitalised words inside a sentence
    become typed placeholders; windows of ``WINDOW`` canonical words are
    joined on their hash, first those of each item's rarest places, then all of the pairs that these find. Windows whose values are the item's own count. Those with other values at one shift between document and item
    count only if their placeholders' values map one to one, so that a
    question with other numbers or names matches and an accident doesn't. A
    leak has ``MIN_WINDOWS`` windows of the item, or all if it has fewer. Windows with fewer than ``MIN_LITERAL`` literal
    words count where every word is the same, numbers and units too; all others of an item suffice if they are fewer than ``MIN_WINDOWS``.
    t1 is XXH64 of the text and tells rows of one doc_id, or null ones,
    apart; equal rows are one. Null and empty texts hold nothing; items
    without id or of fewer than ``MIN_ITEM_WORDS`` words are left out; repeated items count once. Empty
    tables give no row; other columns are ignored. ``reworded`` tells that some value differs.
    """
    wanted = cut(item_windows(items))
    widths = [r["width"] for r in wanted.select("width").distinct().collect()]
    hashes = wanted.select("h").distinct().limit(max_broadcast + 1).toArrow()["h"].to_numpy().astype(np.int64)
    known = np.sort(hashes.view(np.uint64)) if len(hashes) <= max_broadcast else None
    found = document_windows(docs, known, widths if len(hashes) else [])
    found = cut(found if known is not None else found.join(wanted.select("h").distinct(), "h", "left_semi"))
    pairs = found.join(rare_windows(wanted, found), "h").select(F.col("doc_id").alias("_doc"), F.col("t1").alias("_t1"), "item_id").distinct()
    asked = pairs.join(wanted, "item_id")
    same_text = found["doc_id"].eqNullSafe(asked["_doc"]) & (found["t1"] == asked["_t1"])
    met = found.join(asked, same_text & (found["h"] == asked["h"])).withColumn("shift", found["pos"] - asked["pos"])
    met = met.withColumn("item_pos", asked["pos"])
    met = met.select("doc_id", "t1", "item_id", "need", "need_free", "shift", "plain", "item_pos", "item_slots", "doc_slots")
    key = ["doc_id", "t1", "item_id", "need", "need_free"]
    other = F.col("item_slots") != F.col("doc_slots")
    aligned = met.groupBy(*key, "shift").agg(
        F.collect_set(F.when(~other, F.col("item_pos"))).alias("same"), F.collect_set(F.when(other, F.col("item_pos"))).alias("changed"),
        F.collect_set(F.when(~F.col("plain"), F.col("item_pos"))).alias("free"),
        F.array_distinct(F.flatten(F.collect_set(F.when(other, F.arrays_zip("item_slots", "doc_slots"))))).alias("slots"),
    )
    one_way = F.size(F.array_distinct(F.transform("slots", lambda s: s["item_slots"]))) == F.size("slots")
    back = F.size(F.array_distinct(F.transform("slots", lambda s: s["doc_slots"]))) == F.size("slots")
    leaks = (
        aligned.withColumn("places", F.when(one_way & back, F.array_union("same", "changed")).otherwise(F.col("same")))
        .filter(F.size("places") > 0)
        .withColumns({"free": F.array_intersect("places", "free"), "reworded": F.size("changed").cast("boolean") & one_way & back})
        .groupBy(*key)
        .agg(united("places").alias("n_windows"), united("free").alias("n_free"), F.min("reworded").alias("reworded"))
    )
    return leaks.filter("n_windows >= need or n_free >= need_free").drop("need", "need_free", "n_free")


def flag_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, item_ids (sorted), n_windows, reworded.

    What leaks is told by ``contamination``. Null and empty texts leak nothing (false, no ids, 0, false). Rows with the same doc_id, or
    none, are judged by their own texts, repeated ones alike. An empty table gives no row, empty ``items`` only clean ones; other columns of both, whatever their names, are ignored.
    """
    leaks = (
        contamination(docs, items).groupBy(F.col("doc_id").alias("_doc"), F.col("t1").alias("_t1"))
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.sum("n_windows").alias("n_windows"), F.max("reworded").alias("reworded"))
    )
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("t1"))
    return ids.join(leaks, ids["doc_id"].eqNullSafe(leaks["_doc"]) & (ids["t1"] == leaks["_t1"]), "left").select(
        "doc_id", F.col("_t1").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), F.coalesce("reworded", F.lit(False)).alias("reworded"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that leak a benchmark item, by ``contamination``.

    Rows stay as they are, with all columns, whatever their names. Null and empty texts stay; rows with the same doc_id, or none, are judged by their own texts, repeated ones
    alike. An empty table stays empty, and with empty ``items`` all rows stay.
    """
    leaks = contamination(docs, items).select(F.col("doc_id").alias("_doc"), F.col("t1").alias("_t1")).distinct()
    same = docs["doc_id"].eqNullSafe(leaks["_doc"]) & (F.xxhash64(docs["text"].cast("string")) == leaks["_t1"])
    return docs.join(leaks, same, "left_anti")
