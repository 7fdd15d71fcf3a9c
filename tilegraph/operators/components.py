"""4-connected components of a raster in two levels: within blocks, then across their seams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import numbered
from ..functions.storage import bounded_broadcast, join_by_key, materialise
from .blocks import BLOCK
from .closure import components as closure
from .closure import union_find


def label_block(values: np.ndarray) -> np.ndarray:
    """For each pixel of a block the smallest flat index of its component (equal values, 4-connected); -1 where the value is 0."""
    h, w = values.shape
    flat = np.arange(h * w).reshape(h, w)
    on = values != 0
    right = on[:, :-1] & (values[:, :-1] == values[:, 1:])
    down = on[:-1] & (values[:-1] == values[1:])
    # runs along rows first: they halve the graph at no cost
    start = np.where(on, flat, -1)
    start[:, 1:][right] = -1
    run = np.maximum.accumulate(start, axis=1)
    run[~on] = -1
    a, b = run[:-1][down], run[1:][down]
    out = run.copy()
    if len(a):
        nodes, roots = union_find(a.ravel(), b.ravel())
        table = np.arange(h * w)
        table[nodes] = roots
        out[on] = table[run[on]]
    return out


def _close_block(width_of_key: int):
    def run(key, table):
        x, y, v = (table.column(c).to_numpy() for c in ("x", "y", "v"))
        label = table.column("label")
        x0, y0 = x.min(), y.min()
        grid = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1), dtype=np.int64)
        grid[y - y0, x - x0] = v
        local = label_block(grid)[y - y0, x - x0]
        w = grid.shape[1]
        comp = ((local // w + y0).astype(np.int64) * width_of_key) + local % w + x0
        return pa.table({"x": x, "y": y, "v": v, "label": label, "comp": comp})

    return run


def connected(pixels: DataFrame, value: str = "fg", width: int = 1 << 31, block: int = BLOCK) -> DataFrame:
    """(x, y, comp) of the pixels whose value is not 0; comp is y * width + x of the component's first pixel.

    Pass a 0/1 column for components of the foreground, a label column for components of each label.
    """
    return with_components(pixels.where(F.col(value) != 0), value, width, block).select("x", "y", "comp")


def with_components(pixels: DataFrame, value: str = "fg", width: int = 1 << 31, block: int = BLOCK, label: str | None = None) -> DataFrame:
    """(x, y, label, comp) of all pixels: the component of equal values that a pixel is of, null where the value is 0.

    `label` is a column that comes along, so that it need not be joined again; the value by default.
    """
    all_ = pixels.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col(value).cast("long").alias("v"), F.col(label or value).cast("long").alias("label"))
    keyed = all_.withColumns({"by": F.floor(F.col("y") / block), "bx": F.floor(F.col("x") / block)})
    local = materialise(keyed.groupBy("by", "bx").applyInArrow(_close_block(width), "x int, y int, v long, label long, comp long"))

    def side(along: str, across: str, axis: int) -> DataFrame:
        k = F.col(across)
        beside = local.where((F.col("v") != 0) & (((k % block == 0) & (k > 0)) | (k % block == block - 1)))
        line = F.when(k % block == 0, k).otherwise(k + 1)
        mine = F.struct("v", "comp")
        return beside.select(F.lit(axis).alias("axis"), line.alias("line"), F.col(along).alias("at"), F.when(k % block != 0, mine).alias("p"), F.when(k % block == 0, mine).alias("q"))

    met = side("y", "x", 0).unionByName(side("x", "y", 1)).groupBy("axis", "line", "at").agg(F.max("p").alias("p"), F.max("q").alias("q"))
    edges = met.where(F.col("p.v") == F.col("q.v")).select(F.col("p.comp").alias("a"), F.col("q.comp").alias("b")).distinct()
    roots = bounded_broadcast(materialise(closure(edges))).select(F.col("node").alias("__node"), F.col("component").alias("__root"))
    # a component of a block has block * block pixels at most, so no key of this join is hot; background takes no part
    on = local.where("v <> 0").join(roots, F.col("comp") == F.col("__node"), "left").select("x", "y", "label", F.coalesce("__root", "comp").alias("comp"))
    return on.unionByName(local.where("v = 0").select("x", "y", "label", F.lit(None).cast("long").alias("comp")))


def sizes(comps: DataFrame) -> DataFrame:
    """(comp, area)."""
    return comps.groupBy("comp").agg(F.count("*").alias("area"))


def ordinals(pixels: DataFrame, value: str = "fg", width: int = 1 << 31, block: int = BLOCK) -> DataFrame:
    """(x, y, comp, ordinal): components numbered 1 to n by their first pixels in raster order, over the whole raster.

    A component's number is the place of its first pixel among all first pixels, found by ranges of the raster and the
    counts before them; numbers come to the pixels by a join that deals large components out.
    """
    found = materialise(connected(pixels, value, width, block))
    first = found.where(F.col("y").cast("long") * width + F.col("x") == F.col("comp")).select("comp")
    table = materialise(sizes(found).join(numbered(first, F.asc("comp"), name="ordinal"), "comp"))
    return join_by_key(found, table, "comp", "area").select("x", "y", "comp", "ordinal")


def tile_ordinals(pixels: DataFrame, tile: int, value: str = "fg") -> DataFrame:
    """(tile_row, tile_col, x, y, ordinal): each tile's own components, numbered 1 to n in its raster order; what touches across a seam is apart."""

    def run(key, table):
        x, y, v = (table.column(c).to_numpy() for c in ("x", "y", "v"))
        ty, tx = key[0].as_py(), key[1].as_py()
        grid = np.zeros((tile, tile), dtype=np.int64)
        grid[y - ty * tile, x - tx * tile] = v
        local = label_block(grid)[y - ty * tile, x - tx * tile]
        _, place = np.unique(local, return_inverse=True)  # a component is known by its first pixel, so they ascend in raster order
        n = len(x)
        return pa.table({"tile_row": pa.array(np.full(n, ty, dtype=np.int32)), "tile_col": pa.array(np.full(n, tx, dtype=np.int32)), "x": x, "y": y, "ordinal": place + 1})

    px = pixels.where(F.col(value) != 0).select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col(value).cast("long").alias("v"))
    keyed = px.withColumns({"tile_row": F.floor(F.col("y") / tile).cast("int"), "tile_col": F.floor(F.col("x") / tile).cast("int")})
    return keyed.groupBy("tile_row", "tile_col").applyInArrow(run, "tile_row int, tile_col int, x int, y int, ordinal long")
