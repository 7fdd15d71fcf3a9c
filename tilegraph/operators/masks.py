"""Mask proposals given as bit arrays: measures, overlaps, rasterising, suppression. What looks at whole masks does so by their runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import runs


def area(bits: Column) -> Column:
    """Number of set pixels of a bit array."""
    return runs.area(runs.encode(bits))


def bbox(bits: Column, width: int) -> Column:
    """STRUCT(x_min, y_min, x_max, y_max), ends included; all 0 for an empty mask."""
    return runs.bbox(runs.encode(bits), width)


def with_runs(masks: DataFrame) -> DataFrame:
    """masks with `runs` in place of `bits`, whatever expression the bits are; pass few other columns."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("bits")
            made = runs.encode_array(batch.column(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns) if k != at), made], names=[*(n for n in batch.schema.names if n != "bits"), "runs"])

    others = [f for f in masks.schema.fields if f.name != "bits"]
    return masks.mapInArrow(run, StructType([*others, StructField("runs", ArrayType(LongType()))]))


def mask_pixels(masks: DataFrame, width: int, *keep: str) -> DataFrame:
    """(keep..., x, y) of the set pixels of each mask."""
    out = masks.select(*keep, F.posexplode("bits").alias("d", "bit")).where("bit <> 0")
    return out.select(*keep, (F.col("d") % width).alias("x"), F.floor(F.col("d") / width).cast("int").alias("y"))


def iou_pairs(masks: DataFrame, threshold: float = 0.5, group: str = "tile_id") -> DataFrame:
    """(group, mask_a, mask_b, iou) of the pairs of a tile whose IoU reaches the threshold; empty pairs have none. See runs.iou_pairs()."""
    return runs.iou_pairs(with_runs(masks.select(group, "mask_id", "bits")), threshold, group)


def union_pixels(masks: DataFrame, width: int, *by: str) -> DataFrame:
    """(by, x, y) of pixels that any mask sets."""
    return runs.pixels(runs.union(with_runs(masks.select(*by, "bits")), *by), width, *by)


def overlap_with(masks: DataFrame, covered: DataFrame, by: str = "tile_id") -> DataFrame:
    """(by, mask_id, shared): set pixels of each mask that the masks in `covered` cover already; masks without any aren't listed."""
    done = runs.union(with_runs(covered.select(by, "bits")), by)
    return runs.overlap(with_runs(masks.select(by, "mask_id", "bits")), done, by)


def rasterise(masks: DataFrame, width: int, by: str = "tile_id", order: str = "ord", first_label: int = 1, last_wins: bool = True) -> DataFrame:
    """(by, x, y, label): masks painted in order, label = first_label + order; later ones win, or the earliest does."""
    painted = mask_pixels(masks, width, by, order).groupBy(by, "x", "y")
    return painted.agg(((F.max(order) if last_wins else F.min(order)) + first_label).cast("long").alias("label"))


def by_area(masks: DataFrame) -> DataFrame:
    """masks with place, their rank within the tile from small to large, ties in their own order."""
    from pyspark.sql import Window as W

    return masks.withColumn("area", area(F.col("bits"))).withColumn("place", F.row_number().over(W.partitionBy("tile_id").orderBy("area", "ord")) - 1)


def suppress(boxes: np.ndarray, scores: np.ndarray, threshold: float) -> np.ndarray:
    """Indices kept by greedy suppression: best score first (ties in order), dropping boxes whose IoU with a kept one exceeds the threshold.

    Boxes are (x0, y0, x1, y1) with ends excluded: a box of one pixel has an area of 1, an empty one of 0.
    """
    order = np.argsort(-scores, kind="stable")
    x0, y0, x1, y1 = boxes.T.astype(float)
    size = (x1 - x0) * (y1 - y0)
    kept = []
    while len(order):
        i, order = order[0], order[1:]
        kept.append(i)
        w = np.clip(np.minimum(x1[i], x1[order]) - np.maximum(x0[i], x0[order]), 0, None)
        h = np.clip(np.minimum(y1[i], y1[order]) - np.maximum(y0[i], y0[order]), 0, None)
        union = size[i] + size[order] - w * h
        order = order[~(np.divide(w * h, union, out=np.zeros(len(order)), where=union > 0) > threshold)]
    return np.asarray(kept, dtype=np.int64)


def box_nms(masks: DataFrame, width: int, threshold: float = 0.7, group: str = "tile_id") -> DataFrame:
    """masks that greedy box suppression keeps in each tile, ties of score by mask_id; a threshold of 1 keeps all."""
    if threshold >= 1.0:
        return masks
    boxed = masks.withColumn("__box", bbox(F.col("bits"), width)).withColumn("__some", (area(F.col("bits")) > 0).cast("int"))

    def run(_key, table):
        table = table.sort_by("mask_id")
        box = np.column_stack([pa.compute.struct_field(table.column("__box").combine_chunks(), i).to_numpy() for i in range(4)])
        box[:, 2:] += table.column("__some").to_numpy()[:, None]  # ends included so far; an empty mask has no box
        kept = suppress(box, table.column("score").to_numpy(), threshold)
        return table.take(pa.array(np.sort(kept))).drop_columns(["__box", "__some"])

    import pyarrow.compute  # noqa: F401

    return boxed.groupBy(group).applyInArrow(run, masks.schema)
