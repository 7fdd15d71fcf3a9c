"""Removing small regions and merging enclosed ones.

`foreground` connectivity takes a region to be a blob of touching labels of any value, `per_label` one of
a single label. In foreground mode a small blob's neighbours are background only, so nothing is ever
enclosed; enclosed_merge then returns its input, as it must. In per_label mode enclosed regions are found on the region
adjacency graph (adjacency.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import join_by_key, materialise
from .adjacency import contract, enclosed, paint, region_graph
from .blocks import BLOCK
from .components import sizes, with_components

MODES = ("foreground", "per_label")


def regions(pixels: DataFrame, mode: str = "foreground", width: int = 1 << 31, block: int = BLOCK) -> DataFrame:
    """(x, y, label) with comp (null on background) and area of their region.

    Areas are summed by component before the shuffle and come back by a join that deals large regions out.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    source = pixels.withColumn("__v", F.col("label") if mode == "per_label" else (F.col("label") > 0).cast("int"))
    comps = materialise(with_components(source, "__v", width, block, "label"))
    on = comps.where("comp is not null")
    sized = join_by_key(on, materialise(sizes(on)), "comp", "area")
    return sized.select("x", "y", "label", "comp", "area").unionByName(comps.where("comp is null").withColumn("area", F.lit(None).cast("long")))


def drop_small(pixels: DataFrame, min_area: int = 100, mode: str = "foreground", width: int = 1 << 31, block: int = BLOCK) -> DataFrame:
    """(x, y, label) with label 0 where the region has fewer than min_area pixels."""
    found = regions(pixels, mode, width, block)
    return found.select("x", "y", F.when(F.col("area") < min_area, F.lit(0).cast("long")).otherwise(F.col("label")).alias("label"))


def drop_small_by_ratio(pixels: DataFrame, reference_area: float, min_ratio: float = 0.01, mode: str = "foreground", width: int = 1 << 31, block: int = BLOCK) -> DataFrame:
    """drop_small with a least area of reference_area * min_ratio, cut to an integer."""
    return drop_small(pixels, int(reference_area * min_ratio), mode, width, block)


def enclosed_merge(pixels: DataFrame, max_area: int = 500, mode: str = "foreground", width: int = 1 << 31, block: int = BLOCK) -> DataFrame:
    """pixels with enclosed small regions given their only neighbouring label; the input itself in foreground mode."""
    if mode == "foreground":
        return pixels
    graph = region_graph(pixels, width, block)
    return paint(graph, enclosed(graph, max_area).withColumnRenamed("target", "label"))


def enclosed_merge_until_stable(pixels: DataFrame, max_area: int = 500, max_rounds: int = 10, mode: str = "per_label", width: int = 1 << 31, block: int = BLOCK) -> DataFrame:
    """enclosed_merge again and again, until the number of labels stays or max_rounds are over; rounds see regions and contacts only."""
    if mode == "foreground":
        return pixels
    graph = region_graph(pixels, width, block)
    before = graph.regions.select("label").distinct().count()
    for _ in range(max_rounds):
        targets = materialise(enclosed(graph, max_area))
        if targets.isEmpty():
            break
        graph = contract(graph, targets)
        now = graph.regions.select("label").distinct().count()
        if now == before:
            break
        before = now
    return paint(graph)


def enclosed_merge_and_drop_small(pixels: DataFrame, max_area: int = 500, min_area: int = 100, mode: str = "foreground", width: int = 1 << 31, block: int = BLOCK) -> DataFrame:
    """Enclosed regions first, then regions below min_area that weren't merged go to background; regions are found once."""
    if mode == "foreground":
        return drop_small(pixels, min_area, mode, width, block)
    graph = region_graph(pixels, width, block)
    told = graph.regions.where(F.col("area") <= max(max_area, min_area)).join(enclosed(graph, max_area), "comp", "left")
    label = F.when(F.col("target").isNotNull(), F.col("target")).when(F.col("area") < min_area, F.lit(0).cast("long")).otherwise(F.col("label"))
    return paint(graph, told.select("comp", label.alias("label")))
