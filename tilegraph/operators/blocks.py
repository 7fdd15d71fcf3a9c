"""Kernels over blocks of a long raster, with a halo where they look beyond the block's edge."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of a block: 1024 x 1024 pixels, some tens of MB in a kernel.
BLOCK = 1024


def in_blocks(pixels: DataFrame, value: Column, block: int = BLOCK, halo: int = 0) -> DataFrame:
    """(by, bx, x, y, v, own): each pixel in its own block and, if it lies within `halo` of others, in these too.

    Only pixels near a block's edge stand more than once; one shuffle by (by, bx) serves any kernel.
    """
    x, y = F.col("x").cast("int"), F.col("y").cast("int")
    px = pixels.select(x.alias("x"), y.alias("y"), value.cast("long").alias("v"))
    at = lambda c: F.floor(c / block).cast("int")
    own = px.select(at(F.col("y")).alias("by"), at(F.col("x")).alias("bx"), "x", "y", "v", F.lit(True).alias("own"))
    if halo <= 0:
        return own
    if halo > block:
        raise ValueError("a halo reaches into neighbours only")
    near = lambda c: (F.pmod(F.col(c), F.lit(block)) < halo) | (F.pmod(F.col(c), F.lit(block)) >= block - halo)
    span = lambda c: F.sequence(at(F.col(c) - halo), at(F.col(c) + halo))
    beside = px.where(near("x") | near("y")).select(F.explode(span("y")).alias("by"), "x", "y", "v").select("by", F.explode(span("x")).alias("bx"), "x", "y", "v")
    beside = beside.where((F.col("by") != at(F.col("y"))) | (F.col("bx") != at(F.col("x"))))
    return own.unionByName(beside.withColumn("own", F.lit(False)))


class Grid:
    """The pixels of one block as an array with a margin of zeros, from a table of (x, y, v, own)."""

    def __init__(self, table, margin: int = 1):
        x, y, v = (table.column(c).to_numpy() for c in ("x", "y", "v"))
        mine = table.column("own").to_numpy(zero_copy_only=False)
        self.any = bool(mine.any())
        self.x0, self.y0 = int(x.min()) - margin, int(y.min()) - margin
        shape = int(y.max()) - self.y0 + margin + 1, int(x.max()) - self.x0 + margin + 1
        self.values = np.zeros(shape, dtype=np.int64)
        self.values[y - self.y0, x - self.x0] = v
        self.own = np.zeros(shape, dtype=bool)
        self.own[y[mine] - self.y0, x[mine] - self.x0] = True

    def near(self, dx: int, dy: int) -> np.ndarray:
        """For each place the value dx and dy further; 0 beyond the array."""
        out = np.zeros_like(self.values)
        h, w = out.shape
        out[max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)] = self.values[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)]
        return out
