"""Best-fit packing of token sequences into bins of several permitted lengths."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import with_long_ids

#: Permitted sequence lengths, and the fixed cost in tokens that a bin has besides its length.
CAPACITIES = (512, 1_024, 2_048, 4_096)
BIN_COST = 16
#: Pieces one task packs together.
SHARD_PIECES = 20_000


def pack(lengths: np.ndarray, capacities: tuple[int, ...], bin_cost: int = BIN_COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity of that bin) for each piece; pieces longer than the largest capacity aren't allowed.

    Pieces come in falling order. Each goes to the open bin with the least
    room that still holds it. If there is none, a bin opens at the size with the
    least cost (its length and ``bin_cost``) for each token that a fill of pieces still to come would leave
    in it; at the end every bin shrinks to the least size that holds its contents.
    """
    sizes = sorted(capacities)
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    falling = lengths[order]
    for at, i in enumerate(order.tolist()):
        need = int(lengths[i])
        k = bisect.bisect_left(room, (need, -1))
        if k < len(room):
            left, where = room.pop(k)
        else:
            best = min((s for s in sizes if s >= need), key=lambda s: ((s + bin_cost) / _fill(falling, at, s), s))
            left, where = best, len(used)
            used.append(0)
        bins[i], offsets[i] = where, used[where]
        used[where] += need
        if left - need > 0:
            bisect.insort(room, (left - need, where))
    final = np.array([sizes[bisect.bisect_left(sizes, u)] for u in used], np.int64)
    return bins, offsets, final[bins] if len(bins) else bins


def _fill(falling: np.ndarray, at: int, size: int) -> int:
    """Tokens that the piece at ``at`` and the longest later ones that fit in turn would put in a bin of ``size``."""
    total = 0
    while at < len(falling) and total < size:
        at = max(at, int(np.searchsorted(-falling, total - size, "left")))
        if at >= len(falling) or falling[at] == 0:
            break
        copies = 1 if total == 0 else int(min((size - total) // falling[at], np.searchsorted(-falling, -falling[at], "right") - at))
        total += copies * int(falling[at])
        at += copies
    return max(1, total)


def pack_documents(
    docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """One row per piece of a document: doc_id, copy, piece, start, n_tokens, shard, bin, bin_offset, bin_tokens.

    Tokens are words between white space; any split of a text at white space keeps them whole. A document
    longer than the largest capacity is cut into pieces of that length and a
    rest; ``start`` is a piece's first token. Every document has at least
    one piece: null, empty and blank texts have one of no tokens, which takes no room. Pieces are dealt by
    hash over tasks of about ``shard_pieces``, and each packs its own by
    variable-capacity best fit, so each shard wastes at most its last few bins.
    Equal rows (doc_id and text) are packed each, told apart by ``copy``. A null doc_id stays null.
    An empty table gives no row; other columns are ignored.
    """
    largest = max(capacities)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    n_tokens = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), n_tokens.alias("total"))
    counted = rows.groupBy("doc_id", "t1", "total").count()
    numbered = counted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("copy"))
    last = F.greatest(F.ceil(F.col("total") / largest), F.lit(1)) - 1
    pieces = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "doc_id", "t1", "copy", "piece", (F.col("piece") * largest).alias("start"),
        F.least(F.lit(largest).cast("long"), F.col("total") - F.col("piece") * largest).alias("n_tokens"),
    )
    n = rows.agg(F.sum(F.greatest(F.ceil(F.col("total") / largest), F.lit(1)))).first()[0] or 0
    shards = max(1, math.ceil(int(n) / shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id", "t1", "copy", "piece"), F.lit(shards)))

    def packed(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "t1", "copy", "piece"], kind="stable").reset_index(drop=True)
        group["bin"], group["bin_offset"], group["bin_tokens"] = pack(group["n_tokens"].to_numpy(np.int64), capacities, bin_cost)
        return group[["doc_id", "copy", "piece", "start", "n_tokens", "shard", "bin", "bin_offset", "bin_tokens"]]

    fields = "doc_id string, copy long, piece long, start long, n_tokens long, shard long, bin long, bin_offset long, bin_tokens long"
    return with_long_ids(dealt.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("shard").applyInPandas(packed, fields))
