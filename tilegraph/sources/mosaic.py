"""A mosaic of label blocks, kept in memory, on disk, or in memory with spilling.

Blocks are rows keyed by (tile_row, tile_col). A mosaic is never copied to the driver; copying it is free, as
its relation does not change. Later writes of a tile replace earlier ones.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "tile_row int, tile_col int, labels array<bigint>"
LEVELS = {"ram": StorageLevel.MEMORY_ONLY, "disk": StorageLevel.DISK_ONLY, "auto": StorageLevel.MEMORY_AND_DISK}


class Mosaic:
    """Blocks of tile x tile labels over a raster of width x height; pixels without a block are background."""

    def __init__(self, spark: SparkSession, width: int, height: int, tile: int, streaming_mode: str = "auto"):
        if streaming_mode not in LEVELS:
            raise ValueError(f"streaming_mode must be one of {', '.join(LEVELS)}")
        self.spark, self.width, self.height, self.tile = spark, width, height, tile
        self.level = LEVELS[streaming_mode]
        self._blocks = spark.createDataFrame([], BLOCK)

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    def write_tiles(self, blocks: DataFrame) -> None:
        """Put blocks in the mosaic; a tile that is there already gives way."""
        new = blocks.select("tile_row", "tile_col", "labels")
        kept = self._blocks.join(new.select("tile_row", "tile_col").distinct(), ["tile_row", "tile_col"], "left_anti")
        before, self._blocks = self._blocks, kept.unionByName(new).persist(self.level)
        self._blocks.count()
        before.unpersist()

    def blocks(self) -> DataFrame:
        return self._blocks

    def read(self) -> DataFrame:
        """(x, y, label) of the mosaic's pixels within the raster, where a block was written."""
        px = self._blocks.select("tile_row", "tile_col", F.posexplode("labels").alias("k", "label"))
        x, y = F.col("tile_col") * self.tile + F.col("k") % self.tile, F.col("tile_row") * self.tile + F.floor(F.col("k") / self.tile)
        return px.select(x.cast("int").alias("x"), y.cast("int").alias("y"), "label").where((F.col("x") < self.width) & (F.col("y") < self.height))

    def copy(self) -> Mosaic:
        other = Mosaic(self.spark, self.width, self.height, self.tile)
        other.level, other._blocks = self.level, self._blocks
        return other

    def update(self, pixels: DataFrame) -> None:
        """Replace the mosaic by a relabelled raster (x, y, label); each block is built where its pixels meet."""
        t = self.tile
        row, col = F.floor(F.col("y") / t).cast("int"), F.floor(F.col("x") / t).cast("int")
        placed = F.struct(((F.col("y") % t) * t + F.col("x") % t).alias("k"), F.col("label").cast("long").alias("label"))
        grouped = pixels.groupBy(row.alias("tile_row"), col.alias("tile_col")).agg(F.map_from_entries(F.collect_list(placed)).alias("m"))
        self.write_tiles(grouped.select("tile_row", "tile_col", F.transform(F.sequence(F.lit(0), F.lit(t * t - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long"))).alias("labels")))

    def close(self) -> None:
        self._blocks.unpersist()
        self._blocks = self.spark.createDataFrame([], BLOCK)
