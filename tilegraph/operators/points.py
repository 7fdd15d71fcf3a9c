"""Prompt points: grids, residual points, clustering and filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK, Grid, in_blocks


def spaced(k: Column, n: int, start: Column | float, stop: Column | float) -> Column:
    """Point k of n from start to stop, both included, cut to an integer; the last one is stop itself."""
    start, stop = ((c if isinstance(c, Column) else F.lit(float(c))).cast("double") for c in (start, stop))
    if n == 1:
        return start.cast("int")
    return F.when(k == n - 1, stop).otherwise(start + k * ((stop - start) / (n - 1))).cast("int")


def uniform_grid(spark: SparkSession, height: int, width: int, n: int, margin: int = 0) -> DataFrame:
    """(point_id, x, y) of n x n points, x fastest."""
    return grid_in_region(spark, margin, margin, width - 1 - margin, height - 1 - margin, n)


def grid_in_region(spark: SparkSession, x0: float, y0: float, x1: float, y1: float, n: int) -> DataFrame:
    """(point_id, x, y) of n x n points over a box, ends included."""
    k = spark.range(n * n).select(F.col("id").alias("point_id"), (F.col("id") % n).alias("i"), F.expr(f"id div {n}").alias("j"))
    return k.select("point_id", spaced(F.col("i"), n, x0, x1).alias("x"), spaced(F.col("j"), n, y0, y1).alias("y"))


def grids_over(regions: DataFrame, n: int, margin: int = 0) -> DataFrame:
    """regions (x0, y0, x1, y1, whatever names them) with the n x n points of each: point_id, x, y; ends included, `margin` pixels inside the box."""
    if n < 1:
        raise ValueError("a grid has a point a side at least")
    each = regions.withColumn("point_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n * n - 1).cast("long"))))
    i, j = F.col("point_id") % n, F.floor(F.col("point_id") / n)
    return each.withColumns({"x": spaced(i, n, F.col("x0") + margin, F.col("x1") - margin), "y": spaced(j, n, F.col("y0") + margin, F.col("y1") - margin)})


def in_regions(points: DataFrame, regions: DataFrame, *by: str) -> DataFrame:
    """Points (by..., x, y) in the box (by..., x0, y0, x1, y1) of their own region, ends included; points without a region go."""
    box = regions.select(*by, *(F.col(c).alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")))
    met = points.join(box, [*by])
    return met.where(F.col("x").between(F.col("__x0"), F.col("__x1")) & F.col("y").between(F.col("__y0"), F.col("__y1"))).select(points.columns)


def outside_mask(points: DataFrame, mask: DataFrame, width: int, height: int) -> DataFrame:
    """Points within the raster whose pixel isn't set; mask has the set pixels (x, y)."""
    inside = points.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    return inside.join(mask.select("x", "y"), ["x", "y"], "left_anti")


def in_region(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Points of a box, ends included."""
    return points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def eroded(valid: DataFrame, rounds: int, block: int = BLOCK) -> DataFrame:
    """(x, y) of the pixels all of whose neighbours up to `rounds` steps away (in 4-steps) are valid; what is outside is not.

    A kernel on blocks with a halo of `rounds` pixels; a radius beyond a block's side takes larger blocks.
    """
    if rounds <= 0:
        return valid.select("x", "y")

    def run(_key, table):
        grid = Grid(table)
        inner = grid.values != 0
        for _ in range(rounds):
            p = np.pad(inner, 1)
            inner = inner & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
        y, x = np.nonzero(inner & grid.own)
        return pa.table({"x": (x + grid.x0).astype(np.int32), "y": (y + grid.y0).astype(np.int32)})

    return in_blocks(valid, F.lit(1), max(block, rounds), rounds).groupBy("by", "bx").applyInArrow(run, "x int, y int")


def dense_residual(spark: SparkSession, unsegmented: DataFrame, height: int, width: int, n: int = 64, rounds: int = 5) -> DataFrame:
    """Grid points that stand on the eroded unsegmented area."""
    return uniform_grid(spark, height, width, n).join(eroded(unsegmented, rounds), ["x", "y"], "left_semi").select("point_id", "x", "y")


def sampled(valid: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most n of the valid pixels, by a hash of their place: all if there are no more, without replacement."""
    return valid.select("x", "y").orderBy(F.xxhash64(F.lit(seed), "x", "y"), "y", "x").limit(n)


def nearest(samples: DataFrame, centres: DataFrame) -> DataFrame:
    """(centre_id, x, y): each centre's nearest sample, ties to the first in row order. Centres are as few as the points asked for."""
    near = samples.crossJoin(F.broadcast(centres.select("centre_id", F.col("x").alias("cx"), F.col("y").alias("cy"))))
    distance = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    return near.groupBy("centre_id").agg(F.min(F.struct(distance.alias("d"), "y", "x")).alias("best")).select("centre_id", F.col("best.x").alias("x"), F.col("best.y").alias("y"))


def kmeans_points(valid: DataFrame, n: int = 64, rounds: int = 5, most: int = 10_000, seed: int = 42) -> DataFrame:
    """(x, y) of at most n valid pixels that spread like the centres of n clusters of the eroded area.

    No valid pixel: no point; n or fewer: all of them; else a sample of at most `most` is clustered and each
    centre gives way to its nearest sample. `most` is a parameter of the method, not a cap on pixels.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    inner = eroded(valid, rounds)
    few = sampled(inner, most, seed)
    if few.limit(n + 1).count() <= n:
        return few
    rows = VectorAssembler(inputCols=["y", "x"], outputCol="features").transform(few)
    centres = KMeans(k=n, seed=seed, maxIter=20).fit(rows).clusterCenters()
    table = valid.sparkSession.createDataFrame([(i, float(c[1]), float(c[0])) for i, c in enumerate(centres)], "centre_id int, x double, y double")
    return nearest(few, table).select("x", "y")


def residual_kmeans(pixels: DataFrame, n: int = 64, rounds: int = 5, most: int = 10_000, seed: int = 42) -> DataFrame:
    """kmeans_points() of the pixels without a label."""
    return kmeans_points(pixels.where("label = 0"), n, rounds, most, seed)
