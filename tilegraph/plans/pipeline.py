"""From an image to a reconciled label raster, its statistics and its outlines.

plan() describes everything as DataFrames; run() materialises labels once, then writes what the options ask
for. The raster is a relation of blocks or pixels throughout and never one array on the driver.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.storage import keep, materialise
from ..operators import cleanup, grid, multipass, seams, vector, zonal
from ..sources import raster_source, vector_files
from ..sources.tiff import Header, read_header


@dataclass
class Plan:
    """Relations of a segmentation: tiles as segmented, pixels before and after cleaning and merging."""

    header: Header
    grid: tuple[int, int, int]
    tiles: DataFrame
    offsets: DataFrame
    assembled: DataFrame


@dataclass
class Result:
    labels_path: str | None
    before_path: str | None
    shapefile_path: str | None
    geopackage_path: str | None
    stats_path: str | None
    n_segments: int
    coverage: float
    t_compute: float
    t_total: float
    stats: dict
    preview_path: str | None = None


def assemble(tiles: DataFrame, offsets: DataFrame, tile: int) -> DataFrame:
    """(x, y, label) of segmented tiles, labels numbered through in row-major order of tiles, background kept."""
    px = tiles.join(offsets.select("tile_row", "tile_col", "offset"), ["tile_row", "tile_col"]).select("tile_row", "tile_col", "offset", "useful_w", F.posexplode("labels").alias("k", "local"))
    x = F.col("tile_col") * tile + F.col("k") % F.col("useful_w")
    y = F.col("tile_row") * tile + F.floor(F.col("k") / F.col("useful_w"))
    return px.select(x.cast("int").alias("x"), y.cast("int").alias("y"), F.when(F.col("local") > 0, F.col("local") + F.col("offset")).otherwise(F.lit(0)).cast("long").alias("label"))


class Pipeline:
    """A configured segmentation. The proposer is any object of multipass.Proposer; the stand-in serves by default."""

    def __init__(self, config: Config | None = None, proposer: multipass.Proposer | None = None):
        self.config = (config or Config()).validate()
        self.proposer = proposer or multipass.make_proposer(self.config.checkpoint, self.config.segmentation, self.config.merge.min_mask_area)

    def plan(self, spark: SparkSession, path: str) -> Plan:
        c = self.config
        header = read_header(path)
        size = grid.grid_size(header.width, header.height, c.tile.size, c.tile.edge)
        source = raster_source.read_tiles(spark, path, c.tile.size, c.tile.padding, edge=c.tile.edge)
        blocks = raster_source.to_rgb_blocks(source)
        tiles = multipass.segment_tiles(blocks, self.proposer, c.segmentation, c.threshold, c.tile.size, c.merge.min_mask_area)
        ragged = F.least(F.lit(c.tile.size), F.lit(header.width) - F.col("tile_col") * c.tile.size)
        tiles = materialise(tiles.withColumn("useful_w", ragged if c.tile.edge == "cover" else F.lit(c.tile.size)))  # the kernel runs once
        offsets = grid.label_offsets(tiles.select("tile_row", "tile_col", "max_label"))
        return Plan(header, size, tiles, offsets, assemble(tiles, offsets, c.tile.size))

    def clean(self, pixels: DataFrame, width: int) -> DataFrame:
        m = self.config.merge
        if m.merge_strategy == "none":
            return pixels
        return cleanup.enclosed_merge_and_drop_small(pixels, m.merge_enclosed_max_area, m.min_mask_area, m.connectivity, width)

    def run(self, spark: SparkSession, path: str, out: str) -> Result:
        began = time.time()
        c = self.config
        os.makedirs(out, exist_ok=True)
        plan = self.plan(spark, path)
        size = 16 * plan.header.width * plan.header.height  # bytes of (x, y, label)
        before = keep(self.clean(plan.assembled, plan.header.width), c.output.streaming_mode, size)
        merged = keep(seams.merge_seams(before, c.tile.size, c.merge.merge_strategy, c.merge.min_contact_pixels), c.output.streaming_mode, size)
        stats = self.statistics(plan, before, merged, path)
        stats["summary"]["processing_time_seconds"] = round(time.time() - began, 2)
        t_compute = time.time() - began
        h, name = plan.header, os.path.splitext(os.path.basename(path))[0]
        place = lambda suffix: os.path.join(out, f"{name}_{suffix}")
        labels_path = before_path = shapefile_path = geopackage_path = stats_path = preview_path = None
        if c.output.save_labels:
            before_path = raster_source.write_labels(before, place("labels_before_merge.tif"), h.width, h.height, h.crs, h.transform)
            labels_path = raster_source.write_labels(merged, place("labels.tif"), h.width, h.height, h.crs, h.transform)
        if c.output.save_shapefile or c.output.save_geopackage:
            features = materialise(vector.polygons(merged, h.transform or vector.IDENTITY, c.output.simplify_tolerance, h.width))
            if c.output.save_shapefile and vector_files.save_shapefile(features, place("segments.shp"), h.crs):
                shapefile_path = place("segments.shp")
            if c.output.save_geopackage and vector_files.save_geopackage(features, place("segments.gpkg"), h.crs):
                geopackage_path = place("segments.gpkg")
        if c.output.save_preview:
            source = raster_source.to_rgb_blocks(raster_source.read_tiles(spark, path, c.tile.size, c.tile.padding, edge=c.tile.edge))
            preview_path = raster_source.write_preview(source, merged, place("preview.png"), h.width, h.height, c.tile.size)
        if c.output.save_stats:
            stats_path = place("stats.json")
            with open(stats_path, "w", encoding="utf-8") as f:
                json.dump(stats, f, indent=2)
        summary = stats["summary"]
        return Result(labels_path, before_path, shapefile_path, geopackage_path, stats_path, summary["total_segments"], summary["total_coverage"], t_compute, time.time() - began, stats, preview_path)

    def statistics(self, plan: Plan, before: DataFrame, merged: DataFrame, path: str) -> dict:
        """The nested statistics document: a few rows of aggregates, and a row a tile."""
        c = self.config
        cols, rows, total = plan.grid
        sizes = zonal.segment_sizes(merged).first().asDict()
        covered = merged.where("label > 0").count()
        merge = seams.merge_stats(before, c.tile.size, c.merge.merge_strategy, c.merge.min_contact_pixels).first().asDict()
        histogram = {str(r["threshold"]): r["tiles"] for r in zonal.threshold_histogram(plan.tiles).orderBy("threshold").collect()}
        tile_rows = plan.tiles.drop("labels", "useful_w", "max_label").orderBy("tile_row", "tile_col").toLocalIterator()
        pixels = plan.header.width * plan.header.height
        return {
            "summary": {
                "input_path": path, "image_width": plan.header.width, "image_height": plan.header.height, "tile_size": c.tile.size, "n_cols": cols, "n_rows": rows, "total_tiles": total,
                "total_segments": merge["segments_after_merge"], "total_coverage": round(100.0 * covered / pixels, 2),
            },
            "segment_sizes": sizes,
            "threshold_distribution": histogram,
            "config": asdict(c),
            "merge_stats": merge,
            "tiles": [r.asDict() for r in tile_rows],
        }
