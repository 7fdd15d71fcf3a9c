"""Transitive closure of an edge table: connected components by smallest label."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import discard, materialise

#: Edges up to which one task closes the graph in memory (16 bytes an edge).
ONE_TASK = 100_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of an edge list, by vectorised hooking and pointer jumping."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    low = np.arange(len(nodes))
    while True:
        before = low.copy()
        np.minimum.at(low, low[x], low[y])
        np.minimum.at(low, low[y], low[x])
        low = np.minimum(low, low[low])
        low = low[low]
        if (low == before).all():
            return nodes, nodes[low]


def _in_one_task(batches):
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        nodes, roots = union_find(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "component"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: a node's greater neighbours (or its smaller ones and itself) are hung below its smallest neighbour."""
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    hung = both.join(low.hint("merge"), "a")  # compressed tables look small: no round may broadcast its nodes
    if large:
        out = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return out.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for each node that an edge touches; component is the smallest node reachable.

    A graph of at most `one_task` edges is closed by one task; a larger one by alternating large-star and
    small-star rounds over tables in the shared checkpoint folder. Rounds grow with the logarithm of a
    component's width, no neighbour list is ever built, minima are combined before each shuffle, and nothing is
    broadcast. Nulls and loops are dropped; an empty table gives no rows.
    """
    pair = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
    now = materialise(pair.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where((F.col("a") != F.col("b")) & F.col("a").isNotNull()).distinct())
    if now.count() <= one_task:
        return now.repartition(1).mapInArrow(_in_one_task, "node long, component long")
    seen = _state(now)
    while True:
        after = materialise(_star(_star(now, large=True), large=False))
        discard(now)
        now, before, seen = after, seen, _state(after)
        if seen == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
