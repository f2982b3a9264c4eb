"""SimHash near-duplicates: fingerprints linked at a few differing bits through partitioning vantage-point trees.

The pipeline's stage links by the share of common five-word shingles, counted exactly. Its candidates are what the trees link and,
as a few bits don't reach a share of 0.8, what bands of least hashes propose.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Forest, block_tasks, connected_components, cut, ids_and_texts, mix, with_long_ids, written

#: Fingerprints, about, of the bounded sample on which the trees are fitted: one in ``SAMPLE_SHARE``, but from ``SAMPLE`` to ``MAX_SAMPLE``, and never more than twice as many.
SAMPLE, SAMPLE_SHARE, MAX_SAMPLE = 65_536, 64, 4_194_304
#: Fingerprints a leaf should hold, and rows of one block when it holds more.
LEAF = 8_192
#: Words whose shingles are hashed in one step.
STEP_WORDS = 200_000
#: Of the pipeline's stage: words of a shingle, and least share of common shingles (Jaccard) of a link.
COPY_WORDS, COPY_SHARE = 5, 0.8
#: Bands of least hashes, and hashes of a band: of pairs at a share of 0.8, 3 in a million meet in no band.
BANDS, BAND = 42, 6
#: Passes of least hashes over a text's shingles, and parts of the hash range that each pass takes one from.
PASSES, PARTS = 4, 64
#: Rows of one block of candidates, and shingles of one.
COPY_BLOCK, COPY_BLOCK_SHINGLES = 512, 400_000
#: Hubs that the open rows of a bucket are counted against, one after the other, before they meet each other.
HUB_TURNS = 2
#: Candidates that are counted together before looking which are still open, and shingles whose bits are summed in one step.
COUNT_STEP, STEP_SHINGLES = 64, 65_536
_ODD = np.uint64(0x100000001B3)
_TURNS = mix(np.arange(1, PASSES + 1, dtype=np.uint64)) | np.uint64(1)
_EDGES = np.arange(PARTS, dtype=np.uint64) << np.uint64(64 - PARTS.bit_length() + 1)
#: Least hashes of each band: one from each pass first, then from passes in turn, and from parts that lie apart.
_BAND_OF = np.array([((k % PASSES) * PARTS + (k // PASSES) * 37 % PARTS) for k in range(BANDS * BAND)]).reshape(BAND, BANDS).T


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 majority bits of the XXH64 of all word shingles, as an unsigned number; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    counts, total = np.zeros(64, np.int64), len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, STEP_WORDS):
        part = words[at : min(at + STEP_WORDS, total) + width - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        begins = [0, *(ends[: len(part) - width] + 1).tolist()]
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begins, ends[width - 1 :].tolist())], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(k) for k in np.flatnonzero(counts * 2 > total)))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row of ``docs``."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fps.view(np.int64)})

    return with_long_ids(ids_and_texts(docs).mapInPandas(hashed, "doc_id string, fp long"))


class VantageTree:
    """Overlapping partition of some bits of fingerprints.

    A node keeps those within ``mu + radius`` of its vantage point on the near
    side and those beyond ``mu`` on the far side. By the triangle inequality
    two of them at distance ``radius`` or less are together on one of
    the sides, so each close pair meets in some leaf.
    """

    def __init__(self, sample: np.ndarray, mask: int, depth: int, radius: int):
        self.mask, self.radius, self.nodes, self.leaves = np.uint64(mask), radius, [], 0
        self.top = self._grow(np.unique(sample & self.mask), depth)

    def _grow(self, sample: np.ndarray, depth: int) -> int:
        """Number of a node, or -1 - leaf."""
        if depth > 0 and len(sample) >= 16:
            point = sample[len(sample) // 2]
            away = np.sort(np.bitwise_count(sample ^ point))
            cuts = np.unique(away)
            near = np.searchsorted(away, cuts + self.radius, "right")
            far = len(away) - np.searchsorted(away, cuts, "right")
            k = int(np.maximum(near, far).argmin())
            if max(near[k], far[k]) < 0.9 * len(sample):
                mu, at = int(cuts[k]), len(self.nodes)
                away = np.bitwise_count(sample ^ point)
                self.nodes.append([int(point), mu, 0, 0])
                self.nodes[at][2] = self._grow(sample[away <= mu + self.radius], depth - 1)
                self.nodes[at][3] = self._grow(sample[away > mu], depth - 1)
                return at
        self.leaves += 1
        return -self.leaves

    def leaves_of(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, leaf) for every leaf that each fingerprint belongs to."""
        fps = fps & self.mask
        found, todo = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], [(self.top, np.arange(len(fps)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                found.append((rows, np.full(len(rows), -1 - node)))
                continue
            point, mu, near, far = self.nodes[node]
            away = np.bitwise_count(fps[rows] ^ np.uint64(point))
            todo += [(near, rows[away <= mu + self.radius]), (far, rows[away > mu])]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def trees(sample: np.ndarray, depth: int, radius: int) -> list[VantageTree]:
    """A tree for each half of the bits: two fingerprints at ``radius`` or less differ by ``radius // 2`` or less in one of the halves."""
    return [VantageTree(sample, mask, depth, radius // 2) for mask in (0xFFFFFFFF, 0xFFFFFFFF00000000)]


def close_edges(fps: np.ndarray, ids: np.ndarray, sides: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of all links among the rows of one task; sides differ where only pairs across count."""
    order = np.argsort(ids, kind="stable")
    fps, ids, sides = fps[order], ids[order], sides[order]
    forest, step = Forest(len(ids)), max(1, 2_000_000 // max(1, len(ids)))
    across = len(np.unique(sides)) > 1
    for at in range(0, len(ids), step):
        near = np.bitwise_count(fps[at : at + step, None] ^ fps[None, at:]) <= radius
        if across:
            near &= sides[at : at + step, None] != sides[None, at:]
        near &= np.arange(near.shape[1]) > np.arange(near.shape[0])[:, None]
        for row in np.flatnonzero(near.any(axis=1)):
            forest.link(at + row, at + np.flatnonzero(near[row]))
    return forest.edges(ids)


def fingerprint_edges(prints: DataFrame, radius: int = 3, leaf: int = LEAF) -> DataFrame:
    """(a, b) over ``prints`` (fp, rep), one row per distinct fingerprint: spanning forests of the links of each shard."""
    spark = prints.sparkSession
    n = prints.count()
    size = min(MAX_SAMPLE, max(SAMPLE, n // SAMPLE_SHARE))
    chosen = F.pmod(F.xxhash64(F.lit("tree"), "fp"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, size / max(1, n)))
    sample = prints.select("fp").filter(chosen).limit(2 * size).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log(max(1.0, n / leaf)) / np.log(1 / 0.57))))
    shared = spark.sparkContext.broadcast(trees(sample, depth, radius))

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for half, tree in enumerate(shared.value):
                row, where = tree.leaves_of(batch["fp"].to_numpy(np.int64).view(np.uint64))
                yield pd.DataFrame({"half": half, "leaf": where, "fp": batch["fp"].to_numpy()[row], "rep": batch["rep"].to_numpy()[row]})

    def linked(key, group: pd.DataFrame) -> pd.DataFrame:
        a, b = close_edges(
            group["fp"].to_numpy(np.int64).view(np.uint64), group["rep"].to_numpy(np.int64), group["block"].to_numpy(), radius
        )
        return pd.DataFrame({"a": a, "b": b})

    members = cut(prints.mapInPandas(routed, "half int, leaf long, fp long, rep long"))
    tasks = block_tasks(members, ["half", "leaf"], "fp", leaf)
    return tasks.groupBy("half", "leaf", "block_a", "block_b").applyInPandas(linked, "a long, b long")


def link_fingerprints(prints: DataFrame, radius: int = 3, leaf: int = LEAF) -> DataFrame:
    """(node, component) over ``prints`` (fp, rep), one row per distinct fingerprint, for those with any link."""
    return connected_components(fingerprint_edges(prints, radius, leaf))


def with_components(prints: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """``prints`` (doc_id, fp) with component_id, by the links ``groups`` (node, component) of ``nodes`` (fp, rep)."""
    known = prints.filter("doc_id is not null")
    several = cut(known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi"))
    if not several.isEmpty():  # several fingerprints under one doc_id tie their groups together
        again = known.join(several, "doc_id", "left_semi").join(nodes, "fp").filter("doc_id <> rep")
        extra = again.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        groups = connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(extra))
    classes = cut(
        nodes.join(groups, nodes["rep"] == groups["node"], "left")
        .select("fp", F.coalesce("component", "rep").alias("component_id"))
    )
    return prints.join(classes, "fp", "left")


def simhash_groups(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints are taken from whole texts, A-Z lower-cased, split at ASCII
    white space; equal fingerprints are one node, and nodes link at
    ``radius`` or fewer differing bits. component_id is the least doc_id
    reachable. Null and empty texts, and texts without words, have
    fingerprint zero and link like any other. Rows of one doc_id are one
    document that has several fingerprints' links. A row without doc_id has
    its fingerprint and the component of that fingerprint, or null if only
    such rows hold it; it joins nothing. An empty table gives no row; other
    columns of ``docs`` are ignored.
    """
    prints = cut(fingerprints(docs, shingle))
    known = prints.filter("doc_id is not null")
    nodes = cut(known.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = link_fingerprints(nodes, radius)
    return with_components(prints, nodes, groups).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``COPY_WORDS`` words, or of all its words if it has fewer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(COPY_WORDS, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * _ODD + each[k : n + k])
    return np.unique(out)


def majority(shingles: np.ndarray) -> int:
    """The SimHash of a set of shingles: bits that more than half of their hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), STEP_SHINGLES):
        part = shingles[at : at + STEP_SHINGLES]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(k) for k in np.flatnonzero(counts * 2 > len(shingles))))


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """A number for each band: two sets with a share J of common shingles agree in a band with a probability of about J ** ``BAND``.

    The range of hashes is cut into parts; the least hash at or after a part's
    start, around the end if need be, is common with probability J. Each pass orders the hashes anew.
    """
    if not len(shingles):
        return np.zeros(BANDS, np.uint64)
    least = []
    for turn in _TURNS:
        turned = np.sort(mix(shingles * turn))
        at = np.searchsorted(turned, _EDGES)
        at[at == len(turned)] = 0
        least.append(turned[at])
    out = np.arange(BANDS, dtype=np.uint64)
    for column in np.concatenate(least)[_BAND_OF].T:
        out = mix(out * _ODD + column)
    return out


def _rare_first(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all sets in a row, the rarest of each set first; sizes and starts."""
    size = np.array([len(x) for x in sets], np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.bincount(codes)
    rank = np.empty(len(held), np.int64)
    rank[np.argsort(held, kind="stable")] = np.arange(len(held))
    codes, owner = rank[codes], np.repeat(np.arange(len(sets)), size)
    return codes[np.lexsort((codes, owner))], size, np.cumsum(size) - size


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of several ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def alike_edges(sets: list[np.ndarray], ids: np.ndarray, sides: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of all pairs of one task with ``share`` or more of their shingles in common, counted exactly.

    Rows of equal ids are tied from the start. Two sets that have ``share`` in
    common have one of their rarest shingles in common, of each as many as it
    may lack and one more; only such pairs are counted.
    """
    order = np.argsort(ids, kind="stable")
    sets, ids, sides = [sets[k] for k in order], ids[order], sides[order]
    forest, across, parts = Forest(len(ids)), len(np.unique(sides)) > 1, round(share * 1_000_000)
    forest.root = np.searchsorted(ids, ids)
    codes, size, starts = _rare_first(sets)
    rare = np.where(size > 0, size - -(-parts * size // 1_000_000) + 1, 0)
    rare_codes, firsts = codes[_ranges(starts, rare)], np.cumsum(rare) - rare
    by_code = np.argsort(rare_codes, kind="stable")
    posted, rows = rare_codes[by_code], np.repeat(np.arange(len(ids)), rare)[by_code]
    low, high = np.searchsorted(posted, rare_codes, "left"), np.searchsorted(posted, rare_codes, "right")
    marked = np.zeros(int(codes.max()) + 1 if len(codes) else 0, bool)
    for row in range(len(ids) - 1):
        mine = slice(firsts[row], firsts[row] + rare[row])
        near = np.unique(rows[_ranges(low[mine], high[mine] - low[mine])])
        near = near[near > row]
        near = near[1_000_000 * np.minimum(size[near], size[row]) >= parts * np.maximum(size[near], size[row])]
        if across:
            near = near[sides[near] != sides[row]]
        near = near[forest.root[near] != forest.root[row]]
        if not len(near):
            continue
        own = codes[starts[row] : starts[row] + size[row]]
        marked[own] = True
        for at in range(0, len(near), COUNT_STEP):
            some = near[at : at + COUNT_STEP]
            some = some[forest.root[some] != forest.root[row]]
            if len(some):
                common = np.add.reduceat(marked[codes[_ranges(starts[some], size[some])]], np.cumsum(size[some]) - size[some], dtype=np.int64)
                alike = some[1_000_000 * common >= parts * (size[some] + size[row] - common)]
                if len(alike):
                    forest.link(row, alike)
        marked[own] = False
    a, b = forest.edges(ids)
    edges = np.unique(np.stack([a[a != b], b[a != b]]), axis=1)
    return edges[0], edges[1]


def bucket_members(nodes: DataFrame) -> DataFrame:
    """(bucket, rep, size, hub, weight), written: which of ``nodes`` (rep, size, sim, bands) may be near copies of each other.

    Buckets are bands of least hashes, equal SimHash fingerprints, and each pair that the trees
    link. Those with one member go; of those with the same members one stays, and weight is how many they were. hub is the least member.
    """
    banded = nodes.select("rep", "size", F.explode(F.concat("bands", F.array(F.xxhash64(F.lit("sim"), "sim")))).alias("bucket"))
    prints = cut(nodes.groupBy(F.col("sim").alias("fp")).agg(F.min("rep").alias("rep")))
    close = fingerprint_edges(prints).distinct().select(F.explode(F.array("a", "b")).alias("rep"), F.xxhash64(F.lit("edge"), "a", "b").alias("bucket"))
    sized = nodes.groupBy("rep").agg(F.max("size").alias("size"))
    members = written(banded.unionByName(close.join(sized, "rep")).groupBy("bucket", "rep").agg(F.max("size").alias("size")))
    who = [F.bit_xor(F.xxhash64(F.lit(k), "rep")).alias(f"x{k}") for k in (1, 2)]
    same = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("hub"), *who).filter("n > 1")
    kept = same.groupBy("n", "x1", "x2", "hub").agg(F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("weight"))
    return written(members.join(kept.select("bucket", "hub", "weight"), "bucket"))


def labelled(members: DataFrame, tied: DataFrame) -> DataFrame:
    """The members (bucket, rep, size) of buckets that hold more than one label; a label is what ``tied`` (node, component) says, else the row's own id."""
    rows = members.join(tied, members["rep"] == tied["node"], "left").select("bucket", "rep", "size", F.coalesce("component", "rep").alias("label"))
    rows = written(rows)
    open_ = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    return written(rows.join(open_, "bucket", "left_semi"))


def dealt_apart(rows: DataFrame) -> DataFrame:
    """Deal the rows (bucket, label, rep, size) out to tasks (tile, block_a, block_b) of about two blocks that miss no pair of different labels in a bucket.

    Small buckets share tiles of about a block; those of one least member, which have much the same rows, share one tile if together they are no more than a block, so that a
    row is in few tiles. In a larger bucket each label of more than a
    block has blocks of its own, which aren't paired among themselves; the
    other labels share blocks. So one large group of tied rows meets only the others.
    """
    weight = F.greatest(F.count(F.lit(1)) / F.lit(COPY_BLOCK), F.sum("size") / F.lit(COPY_BLOCK_SHINGLES)).alias("weight")
    sizes = written(rows.groupBy("bucket", "label").agg(weight, F.min("rep").alias("least")))
    whole = written(sizes.groupBy("bucket").agg(F.sum("weight").alias("whole"), F.min("least").alias("least")))
    small = whole.filter("whole <= 1")
    together = small.groupBy("least").agg(F.sum("whole").alias("together"))
    tiles = max(1, math.ceil(together.agg(F.sum("together")).first()[0] or 0))
    large = whole.filter("whole > 1").select("bucket")
    home = F.when(F.col("together") <= 1, F.xxhash64(F.lit("least"), "least")).otherwise(F.xxhash64(F.lit("bucket"), "bucket"))
    tile = F.struct(F.lit(False).alias("alone"), F.pmod(home, F.lit(tiles)).alias("tile")).alias("tile")
    shared = rows.join(small.join(together, "least").select("bucket", tile), "bucket").select("tile", "label", "rep").distinct()
    shared = shared.select("tile", "label", "rep", *[F.lit(0).cast("long").alias(c) for c in ("block", "block_a", "block_b")])
    parts = sizes.join(large, "bucket").groupBy("bucket", F.when(F.col("weight") > 1, F.col("label")).alias("home")).agg(F.ceil(F.sum("weight")).alias("blocks"))
    cell = Window.partitionBy("bucket")
    parts = written(
        parts.withColumn("first", F.sum("blocks").over(cell.orderBy("home").rowsBetween(Window.unboundedPreceding, 0)) - F.col("blocks"))
        .withColumn("all", F.sum("blocks").over(cell))
    )
    own = parts.filter("home is not null").select("bucket", F.col("home").alias("label"), F.struct("first", "blocks", "all", F.lit(True).alias("alone")).alias("own"))
    rest = parts.filter("home is null").select("bucket", F.struct("first", "blocks", "all", F.lit(False).alias("alone")).alias("rest"))
    dealt = rows.join(large, "bucket", "left_semi").join(own, ["bucket", "label"], "left").join(rest, "bucket", "left").withColumn("p", F.coalesce("own", "rest"))
    dealt = dealt.withColumn("block", F.col("p.first") + F.pmod(F.xxhash64(F.lit("block"), "rep"), F.col("p.blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("p.all") - 1), lambda o: ~F.col("p.alone") | (o < F.col("p.first")) | (o >= F.col("p.first") + F.col("p.blocks")))
    dealt = dealt.select(F.struct(F.lit(True).alias("alone"), F.col("bucket").alias("tile")).alias("tile"), "label", "rep", "block", F.explode(others).alias("other"))
    return shared.unionByName(dealt.select("tile", "label", "rep", "block", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b")))


def _alike(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Those of ``pairs`` (rep, hub) with ``share`` or more of their shingles in common, as (a, b)."""
    theirs = sets.select(F.col("rep").alias("hub"), F.col("shingles").alias("hub_shingles"))
    common = F.size(F.array_intersect("shingles", "hub_shingles"))
    enough = 1_000_000 * common.cast("long") >= round(share * 1_000_000) * (F.size("shingles") + F.size("hub_shingles") - common).cast("long")
    return pairs.join(sets, "rep").join(theirs, "hub").filter(enough).select(F.col("rep").alias("a"), F.col("hub").alias("b"))


def copy_edges(members: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """(a, b): links of near copies by ``share``, at least a forest of what the buckets of ``members`` hold; ``sets`` are (rep, shingles).

    First each row is counted against the hub that it shares most buckets with. That ties large groups. Where a bucket still has
    rows that aren't tied, ``HUB_TURNS`` more hubs are tried, by hash. What is then open in a bucket meets there, in tiles and blocks: ids
    are dealt first, and shingles are fetched for each of them once per task. Nothing is grouped before it is verified, so a
    bucket never grows with the chains that its members are in.
    """

    def counted(group: pa.Table) -> pa.Table:
        lists = group["shingles"].combine_chunks()
        bounds = lists.offsets.to_numpy()
        sets = np.split(lists.values.to_numpy().view(np.uint64)[bounds[0] : bounds[-1]], bounds[1:-1] - bounds[0])
        a, b = alike_edges(sets, group["label"].to_numpy(), group["block"].to_numpy(), share)
        return pa.table({"a": a, "b": b})

    best = F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub")
    pairs = members.filter("rep <> hub").groupBy("rep", "hub").agg(F.sum("weight").alias("n")).groupBy("rep").agg(best)
    edges = written(_alike(pairs, sets, share))
    tied = connected_components(edges)
    open_ = labelled(members, tied)
    for turn in range(HUB_TURNS):
        if open_.isEmpty():
            return edges
        hubs = open_.groupBy("bucket").agg(F.min_by(F.struct(F.col("rep").alias("hub"), F.col("label").alias("hub_label")), F.xxhash64(F.lit(turn), "rep")).alias("h")).select("bucket", "h.*")
        again = open_.join(hubs, "bucket").filter("label <> hub_label").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("n")).groupBy("rep").agg(best)
        more = written(_alike(again, sets, share))
        edges = edges.unionByName(more)
        if not more.isEmpty():
            tied = connected_components(edges)
            open_ = labelled(open_.select("bucket", "rep", "size"), tied)
    tasks = dealt_apart(open_).join(sets, "rep").select("tile", "block_a", "block_b", "label", "block", "shingles")
    return edges.unionByName(tasks.groupBy("tile", "block_a", "block_b").applyInArrow(counted, "a long, b long"))


def copy_groups(docs: DataFrame, share: float = COPY_SHARE) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``, linked where ``share`` or more of the five-word shingles are common.

    Texts with the same shingles are one node. The trees over SimHash
    fingerprints and bands of least hashes put nodes into buckets, and pairs in a bucket are counted exactly, as ``copy_edges``
    tells. Texts without words are one group. doc_id and component_id as in ``simhash_groups``.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_hashes(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "fp": [xxhash.xxh128_hexdigest(x.tobytes()) for x in sets], "size": [len(x) for x in sets],
                "sim": np.array([majority(x) for x in sets], np.uint64).view(np.int64), "bands": [bands_of(x).view(np.int64) for x in sets],
            })

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"rep": batch["rep"], "shingles": [shingle_hashes(t).view(np.int64) for t in batch["text"]]})

    texts = ids_and_texts(docs)
    prints = cut(with_long_ids(texts.mapInPandas(hashed, "doc_id string, fp string, size long, sim long, bands array<long>")))
    known = prints.filter("doc_id is not null")
    nodes = cut(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), *[F.any_value(c).alias(c) for c in ("size", "sim", "bands")]))
    members = bucket_members(nodes)
    reps = members.select("rep").distinct()
    chosen = with_long_ids(texts).withColumnRenamed("doc_id", "rep").join(reps, "rep", "left_semi")
    sets = written(chosen.dropDuplicates(["rep", "text"]).mapInPandas(sets_of, "rep long, shingles array<long>"))
    groups = connected_components(copy_edges(members, sets, share))
    return with_components(prints.select("doc_id", "fp"), nodes.select("fp", "rep"), groups)


def drop_near_duplicates(docs: DataFrame, share: float = COPY_SHARE) -> DataFrame:
    """``docs`` with one row for each group of ``copy_groups``: that of its component_id; rows without doc_id stay.

    Of several rows with that doc_id the one with the least hash of its text
    stays, or else of all its columns. Null and empty texts are texts without
    words, so one of them stays. All columns stay as they are, whatever their names; an empty table stays empty.
    """
    groups = copy_groups(docs, share)
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    repeated = groups.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1")
    kept = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    if repeated.isEmpty():
        return kept
    ids = repeated.select(F.col("doc_id").alias("_again"))
    order = F.struct(F.xxhash64(F.col("text").cast("string")), F.xxhash64(F.to_json(F.struct("*"))))
    once = (
        kept.join(ids, kept["doc_id"] == ids["_again"], "left_semi").select(F.col("doc_id").alias("_id"), F.struct("*").alias("_row"), order.alias("_order"))
        .groupBy("_id").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")
    )
    return kept.join(ids, kept["doc_id"] == ids["_again"], "left_anti").unionByName(once)
