"""Connected components of an edge list, by alternating large and small stars.

Each round is two aggregations and joins by node, both with map-side combining, so a node of very
high degree costs no single task more than its share after skew splitting. Rounds grow with the
logarithm of a component's diameter. Each round's edges are written to the shared folder and the
round before is deleted: lineage stays flat and an executor may be lost at any time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.runtime import Cut


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
    out = e.join(low, F.col("u") == F.col("c"))
    moved = out.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.union(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame, rounds: int = 60) -> Cut:
    """``edges`` (u long, v long; self-loops and nulls are ignored) to a written table (u, v): v is the
    least node of u's component, for every node but the least itself. Drop the returned table when done."""
    now = Cut(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    mark = _mark(now.df)
    for _ in range(rounds):
        if not mark[0]:
            return now
        nxt = Cut(_small(_large(now.df)), "edges")
        now.drop()
        now, before, mark = nxt, mark, _mark(nxt.df)
        if mark == before:
            return now
    raise RuntimeError("components did not settle")


def stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In one task: pairs of positions (a, b) over ``ids`` to (node, least node of its component)."""
    nodes, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = inv[: len(a)], inv[len(a) :]
    order = np.argsort(ids[nodes], kind="stable")
    rank = np.empty(len(nodes), dtype=np.int64)
    rank[order] = np.arange(len(nodes))
    lab, a, b = np.arange(len(nodes)), rank[a], rank[b]
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    sorted_ids = ids[nodes][order]
    keep = lab != np.arange(len(nodes))
    return sorted_ids[keep], sorted_ids[lab[keep]]
