"""Tile grids and padded read windows, as generated dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EDGES = ("whole", "cover")


def grid_size(width: int, height: int, tile: int, edge: str = "whole") -> tuple[int, int, int]:
    """(columns, rows, tiles). `whole` keeps whole tiles only; `cover` adds a ragged last column and row."""
    if tile <= 0 or edge not in EDGES:
        raise ValueError(f"tile must be positive and edge one of {EDGES}")
    count = (lambda n: n // tile) if edge == "whole" else (lambda n: -(-n // tile))
    cols, rows = count(width), count(height)
    return cols, rows, cols * rows


def tiles(spark: SparkSession, width: int, height: int, tile: int, edge: str = "whole") -> DataFrame:
    """(tile_row, tile_col) in row-major order; a raster smaller than one tile is an error."""
    cols, _, total = grid_size(width, height, tile, edge)
    if total == 0:
        raise ValueError(f"a raster of {width} x {height} has no tile of {tile}")
    return spark.range(total).select(F.expr(f"cast(id div {cols} as int)").alias("tile_row"), (F.col("id") % cols).cast("int").alias("tile_col"))


def tiles_of(images: DataFrame, tile: int, edge: str = "whole") -> DataFrame:
    """images (width, height, whatever names them) with a row for each tile: n_cols, n_rows, tile_row, tile_col. An image smaller than one whole tile has none."""
    if tile <= 0 or edge not in EDGES:
        raise ValueError(f"tile must be positive and edge one of {EDGES}")
    count = lambda c: (F.floor(F.col(c) / tile) if edge == "whole" else F.ceil(F.col(c) / tile)).cast("int")
    sized = images.withColumns({"n_cols": count("width"), "n_rows": count("height")}).where("n_cols > 0 and n_rows > 0")
    rows = sized.withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
    return rows.withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))


def axis_window(k: Column, n: Column | int, size: Column | int, tile: int, padding: int, edge: str = "whole") -> tuple[Column, Column]:
    """(read origin, crop offset) of tile k of n along one axis of `size` pixels.

    The first tile begins at 0; the last one reads the last tile + 2 * padding pixels, so its useful area
    begins 2 * padding in; others are padded on both sides. With one tile the first rule holds. `cover`
    instead clips each window to the raster, so that no pixel is lost or shifted.
    """
    if edge == "cover":
        start = F.greatest(k * tile - padding, F.lit(0))
        return start.cast("int"), (k * tile - start).cast("int")
    reach = tile + 2 * padding
    start = F.when(k == 0, 0).when(k == n - 1, size - reach).otherwise(k * tile - padding)
    crop = F.when(k == 0, 0).when(k == n - 1, 2 * padding).otherwise(padding)
    return start.cast("int"), crop.cast("int")


def _windowed(out: DataFrame, cols: Column | int, rows: Column | int, width: Column | int, height: Column | int, tile: int, padding: int, edge: str) -> DataFrame:
    rx, cx = axis_window(F.col("tile_col"), cols, width, tile, padding, edge)
    ry, cy = axis_window(F.col("tile_row"), rows, height, tile, padding, edge)
    out = out.withColumns({"read_x": rx, "read_y": ry, "crop_x": cx, "crop_y": cy})

    def length(at: str, crop: str, n: Column | int) -> Column:
        reach = F.lit(tile + 2 * padding) if edge == "whole" else F.col(crop) + tile + padding
        return F.least(reach, n - F.col(at)).cast("int")

    return out.withColumns({"read_w": length("read_x", "crop_x", width), "read_h": length("read_y", "crop_y", height), "write_x": (F.col("tile_col") * tile).cast("int"), "write_y": (F.col("tile_row") * tile).cast("int")})


def windows(spark: SparkSession, width: int, height: int, tile: int, padding: int, edge: str = "whole") -> DataFrame:
    """tiles() with read_x, read_y, crop_x, crop_y, the read size, and write_x, write_y of the useful area."""
    cols, rows, _ = grid_size(width, height, tile, edge)
    return _windowed(tiles(spark, width, height, tile, edge), cols, rows, width, height, tile, padding, edge)


def windows_of(images: DataFrame, tile: int, padding: int, edge: str = "whole") -> DataFrame:
    """windows() of a table of images (width, height, ...), as tiles_of() gives their tiles."""
    return _windowed(tiles_of(images, tile, edge), F.col("n_cols"), F.col("n_rows"), F.col("width"), F.col("height"), tile, padding, edge)


def label_offsets(per_tile: DataFrame, order: tuple[str, ...] = ("tile_row", "tile_col"), group: tuple[str, ...] = ()) -> DataFrame:
    """per_tile (with max_label, the largest label of a tile's own numbering) plus `offset`, what came before it.

    Adding the offset to each tile's labels equals numbering the tiles one after the other: a tile of
    background only leaves the numbering as it is. Offsets are summed in two phases, over tile rows and
    then within them, so no task sees more than a row of tiles or one number of each row.
    """
    row, *rest = order
    totals = per_tile.groupBy(*group, row).agg(F.sum("max_label").alias("__row_total"))
    before = W.partitionBy(*group).orderBy(row).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__row_total").over(before), F.lit(0)))
    within = W.partitionBy(*group, row).orderBy(*rest).rowsBetween(W.unboundedPreceding, -1)
    joined = per_tile.join(totals.select(*group, row, "__before"), [*group, row])
    return joined.withColumn("offset", (F.coalesce(F.sum("max_label").over(within), F.lit(0)) + F.col("__before")).cast("long")).drop("__before")
