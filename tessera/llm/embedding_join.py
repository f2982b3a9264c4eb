"""Embedding near-duplicates: an exact metric range join over pivot cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Forest, block_tasks, connected_components, cut

#: Vectors a cell should hold at home, and rows of one block when it holds more.
CELL = 4_096
#: Bounds of what is broadcast: labels that get pivots of their own, and all pivots' bytes.
MAX_LABELS, MAX_PIVOT_BYTES = 1_024, 16_000_000
#: Room for rounding in the distances that only decide on replication.
SLACK = 1e-6


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """The vectors as rows of length one in double precision; scaled first, so that no square overflows."""
    rows = np.stack([np.asarray(v, np.float64) for v in vectors])
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (rows @ pivots.T)))


def cell_links(ids, weights, rows, home, sides, least: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """How many other vectors each row of one task links with, and a spanning forest of the links.

    Pairs of two guests belong to another cell, pairs within one side of a two-sided task to another task.
    Rows are sorted by their distance to the first home row; only those that the triangle inequality leaves are compared.
    """
    radius = math.sqrt(max(0.0, 2.0 - 2.0 * least)) + SLACK
    away = distances(rows, rows[np.flatnonzero(home)[:1]])[:, 0] if home.any() else np.zeros(len(ids))
    order = np.argsort(away, kind="stable")
    across = len(np.unique(sides)) > 1
    linked, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
    by_id = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[by_id] = np.arange(len(ids))
    sorted_away = away[order]
    for at in range(0, len(ids), 512):
        mine = order[at : at + 512]
        stop = int(np.searchsorted(sorted_away, sorted_away[min(at + 511, len(ids) - 1)] + radius, "right"))
        theirs = order[at:stop]
        near = rows[mine] @ rows[theirs].T >= least
        near &= np.arange(len(theirs)) > np.arange(len(mine))[:, None]
        near &= home[mine][:, None] | home[theirs]
        if across:
            near &= sides[mine][:, None] != sides[theirs]
        linked[mine] += near @ weights[theirs]
        linked[theirs] += weights[mine] @ near
        for row in np.flatnonzero(near.any(axis=1)):
            forest.link(place[mine[row]], place[theirs[near[row]]])
    return linked, forest.edges(ids[by_id])


def _pivots(classes: DataFrame, cell: int) -> dict:
    """label -> pivot rows, for labels of more than one cell; a bounded set, chosen by hash at a rate that fits the label's size."""
    counts = classes.groupBy("label", "dim").count().filter(F.col("count") > cell).orderBy(F.desc("count"), "label", "dim")
    found = {}
    large = counts.limit(MAX_LABELS).collect()
    wanted = sum(r["count"] // cell + 1 for r in large)
    room = max(1, MAX_PIVOT_BYTES // (8 * max((r["dim"] for r in large), default=1)))
    rates = {(r["label"], r["dim"]): min(1.0, (r["count"] // cell + 1) / r["count"] * min(1.0, room / wanted)) for r in large}
    if not rates:
        return found
    schema = f"label {classes.schema['label'].dataType.simpleString()}, dim int, rate double"
    rate = classes.sparkSession.createDataFrame([(a, b, c) for (a, b), c in rates.items()], schema)
    chance = F.pmod(F.xxhash64(F.lit("pivot"), "h1", "h2"), F.lit(1 << 30)) / float(1 << 30)
    chosen = classes.join(F.broadcast(rate), ["label", "dim"]).filter(chance < F.col("rate"))
    for r in chosen.orderBy("h1", "h2").limit(room).select("label", "dim", "embedding").collect():
        found.setdefault((r["label"], r["dim"]), []).append(r["embedding"])
    return {k: unit_rows(pd.Series(v)) for k, v in found.items()}


def embedding_groups(vectors: DataFrame, least: float = 0.93, cell: int = CELL) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of the same label and length link where their cosine, in double
    precision, is at least ``least`` (0 < least <= 1). Equal vectors of a
    label are compared as one and counted by number. On the unit sphere the
    cosine bound is a distance bound r: each label's vectors go to their
    nearest pivot's cell, and as guests to the cells of a lower number that
    the triangle inequality doesn't rule out; cells are then independent.
    n_links counts the other rows linked directly, component_id is the
    least vec_id reachable. Rows whose vector or label is null, or whose vector is empty, zero
    or holds null or non-finite components, link with nothing and are their own
    component. Rows of one vec_id are separate vectors of one component
    name. A row without vec_id links too, counts for others and shares its component if any row there has an id, else null.
    An empty table gives no row; other columns are ignored.
    """
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    source = vectors.select("vec_id", "embedding", "label").withColumn("usable", usable)
    hashes = [F.xxhash64(F.lit(k), "label", "embedding").alias(f"h{k}") for k in (1, 2)]
    rows = source.select("vec_id", "usable", *hashes)
    classes = cut(
        source.filter("usable").select("vec_id", "label", "embedding", *hashes)
        .groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .withColumn("dim", F.size("embedding"))
        .withColumn("node", F.coalesce("rep", F.xxhash64("h1", "h2")))
    )
    pivots = vectors.sparkSession.sparkContext.broadcast(_pivots(classes, cell))
    radius = math.sqrt(max(0.0, 2.0 - 2.0 * least)) + SLACK
    label_type = classes.schema["label"].dataType.simpleString()

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (label, dim), part in batch.groupby(["label", "dim"], sort=False):
                centres = pivots.value.get((label, dim))
                if centres is None:
                    yield part.assign(cell=0, home=True)
                    continue
                away = distances(unit_rows(part["embedding"]), centres)
                nearest = away.argmin(axis=1)
                yield part.assign(cell=nearest, home=True)
                guest = away <= away.min(axis=1)[:, None] + 2 * radius
                guest &= np.arange(len(centres)) < nearest[:, None]
                for k in np.flatnonzero(guest.any(axis=0)):
                    yield part[guest[:, k]].assign(cell=int(k), home=False)

    fields = f"node long, n long, label {label_type}, dim int, embedding {classes.schema['embedding'].dataType.simpleString()}"
    members = classes.select("node", "n", "label", "dim", "embedding").mapInPandas(placed, f"{fields}, cell long, home boolean")
    members = cut(members)
    tasks = block_tasks(members, ["label", "dim", "cell"], "node", cell)

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["node"].to_numpy(np.int64)
        linked, (a, b) = cell_links(
            ids, group["n"].to_numpy(np.int64), unit_rows(group["embedding"]),
            group["home"].to_numpy(bool), group["block"].to_numpy(), least,
        )
        some = np.flatnonzero(linked)
        return pd.DataFrame({
            "a": np.concatenate([ids[some], a]),
            "b": pd.array([None] * len(some) + b.tolist(), "Int64"),
            "links": np.concatenate([linked[some], np.zeros(len(a), np.int64)]),
        })

    found = cut(tasks.groupBy("label", "dim", "cell", "block_a", "block_b").applyInPandas(compared, "a long, b long, links long"))
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    groups = connected_components(found.filter("b is not null").select("a", "b"))
    named = classes.filter("rep is not null").select("node", "rep")
    # a hub that only has rows without an id is no name: the least id of its group is
    names = groups.join(named, "node").groupBy("component").agg(F.min("rep").alias("least"))
    groups = groups.join(names, "component", "left").select("node", "least")
    known = cut(
        classes.select("h1", "h2", "node", "rep", "n").join(links, "node", "left").join(groups, "node", "left")
        .select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    )
    linked = rows.filter("usable").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"),
        F.col("component_id").cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
