"""Seam contacts of tiles that arrive as a stream, kept by stateful operators.

The state's key is a stretch of a seam line (SPAN places), its value the two labels at each of its places: 16 KB, however long
the line. A batch's rows meet their own stretches only. A pixel that arrives again replaces what was there, and what
leaves the operator are changes: by how much the count of each pair of labels has grown or fallen. A table of
changes adds up to the contacts at any time. State that nothing has touched for `ttl_ms` is dropped; its counts stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

SPAN = 1024
CHANGES = "axis string, line int, a bigint, b bigint, change bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def seam_rows(pixels: DataFrame, tile: int, order: str | None = None) -> DataFrame:
    """(axis, line, span, at, side, label, seq) of the pixels beside seams, no others; side 0 lies before the line."""
    if tile < 2:
        raise ValueError("a tile has two pixels a side at least")
    label = F.coalesce(F.col("label").cast("long"), F.lit(0).cast("long"))
    seq = F.col(order).cast("long") if order else F.lit(0).cast("long")

    def side(axis: str, along: str, across: str) -> DataFrame:
        k = F.col(across)
        beside = pixels.where(((k % tile == 0) & (k > 0)) | (k % tile == tile - 1))
        line, at = F.when(k % tile == 0, k).otherwise(k + 1).cast("int"), F.col(along).cast("int")
        return beside.select(F.lit(axis).alias("axis"), line.alias("line"), F.floor(at / SPAN).cast("int").alias("span"), (at % SPAN).cast("int").alias("at"), (k % tile == 0).cast("int").alias("side"), label.alias("label"), seq.alias("seq"))

    return side("v", "y", "x").unionByName(side("h", "x", "y"))


def counted(labels: np.ndarray) -> dict[tuple[int, int], int]:
    """How often two labels meet along a stretch (2 x SPAN); background and equal labels don't count."""
    a, b = labels
    met = (a > 0) & (b > 0) & (a != b)
    pairs, n = np.unique(labels[:, met], axis=1, return_counts=True)
    return {(int(p), int(q)): int(k) for p, q, k in zip(*pairs, n, strict=True)}


class Stretch(StatefulProcessor):
    """The labels on both sides of one stretch of a seam line."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.labels = handle.getValueState("labels", "labels binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.labels.get() if self.labels.exists() else None
        labels = np.zeros((2, SPAN), dtype=np.int64) if held is None else np.frombuffer(held[0], dtype=np.int64).reshape(2, SPAN).copy()
        before = counted(labels)
        given = pd.concat(rows)
        # of a place that comes twice in a batch the highest seq stands, then the highest label
        given = given.sort_values(["seq", "label"])
        labels[given["side"].to_numpy(), given["at"].to_numpy()] = given["label"].to_numpy()
        self.labels.update((labels.tobytes(),))
        now = counted(labels)
        changed = [(*pair, d) for pair in sorted(before.keys() | now.keys()) if (d := now.get(pair, 0) - before.get(pair, 0))]
        axis, line, _ = key
        if changed:
            a, b, change = zip(*changed, strict=True)
            yield pd.DataFrame({"axis": axis, "line": np.int32(line), "a": a, "b": b, "change": change})

    def close(self) -> None:
        pass


def contact_changes(pixels: DataFrame, tile: int, order: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The stream of changes (CHANGES) that a stream of pixels (x, y, label) makes; `order` names a column by which later pixels of one batch stand."""
    pixels.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    grouped = seam_rows(pixels, tile, order).groupBy("axis", "line", "span")
    return grouped.transformWithStateInPandas(Stretch(ttl_ms), CHANGES, "Update", "ProcessingTime" if ttl_ms else "None")


class ChangeStore:
    """A table of changes in a folder that all executors share, written by batch; a batch that runs again replaces its own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, changes: DataFrame, number: int) -> None:
        changes.write.mode("overwrite").parquet(f"{self.root}/changes/batch={number}")

    def contacts(self) -> DataFrame:
        """(axis, line, a, b, cnt) as of the last batch."""
        try:
            all_ = self.spark.read.schema(CHANGES + ", batch bigint").parquet(f"{self.root}/changes")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            all_ = self.spark.createDataFrame([], CHANGES)
        return all_.groupBy("axis", "line", "a", "b").agg(F.sum("change").alias("cnt")).where("cnt > 0")

    def follow(self, changes: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """A query that writes a stream of changes here; with `once` it ends when what is there now has been read."""
        query = changes.writeStream.outputMode("update").foreachBatch(self.write).option("checkpointLocation", checkpoint)
        return (query.trigger(availableNow=True) if once else query).start()
