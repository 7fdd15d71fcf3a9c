"""Rasters, masks and series derived from the driver's tables, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, TILE = 100, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (x, y, tr, tc, label, fg) of a raster 100 wide, one pixel an event, in tiles of 10 x 10."""
    x, y = F.expr("cast(event_id % 100 as int)"), F.expr("cast(event_id div 100 as int)")
    px = table(spark, sf_dir, "events").select("event_type", x.alias("x"), y.alias("y"))
    px = px.withColumns({"tr": F.expr("cast(y div 10 as int)"), "tc": F.expr("cast(x div 10 as int)")})
    label = F.expr("cast(case when event_type = 'error' then 0 else 1 + (tr * 10 + tc) * 9 + 3 * (((y % 10 + 3 * tc) % 10) div 4) + (((x % 10 + 3 * tr) % 10) div 4) end as bigint)")
    return px.select("x", "y", "tr", "tc", label.alias("label"), F.expr("cast(event_type in ('click', 'view') as int)").alias("fg"))


LABEL_RASTER_SQL = """f1 AS (
  SELECT x, y, tr, tc, fg, CAST(CASE WHEN event_type = 'error' THEN 0
    ELSE 1 + (tr * 10 + tc) * 9 + 3 * (((y % 10 + 3 * tc) % 10) // 4) + (((x % 10 + 3 * tr) % 10) // 4) END AS BIGINT) AS label
  FROM (SELECT *, y // 10 AS tr, x // 10 AS tc FROM (
    SELECT event_type, CAST(event_id % 100 AS INT) AS x, CAST(event_id // 100 AS INT) AS y,
           CAST(event_type IN ('click', 'view') AS INT) AS fg FROM events)))"""


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of 8 x 8 pixels: (mask_id, tile_id, ord, pass, score, bits)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("mask_id"),
        F.expr("vec_id div 10").alias("tile_id"),
        F.expr("cast(vec_id % 10 as int)").alias("ord"),
        F.expr("cast((vec_id % 10) div 3 as int)").alias("pass"),
        ((F.col("label") + 1) / 10.0).cast("double").alias("score"),
        F.expr("transform(embedding, v -> cast(v > 0 as tinyint))").alias("bits"),
    )


MASKS_SQL = """f2 AS (
  SELECT vec_id AS mask_id, vec_id // 10 AS tile_id, CAST(vec_id % 10 AS INT) AS ord, CAST((vec_id % 10) // 3 AS INT) AS pass,
         (label + 1) / 10.0 AS score, list_transform(embedding, lambda v: CAST(v > 0 AS TINYINT)) AS bits
  FROM embeddings
), mask_px AS (
  SELECT mask_id, tile_id, ord, pass, d % 8 AS x, d // 8 AS y FROM (
    SELECT mask_id, tile_id, ord, pass, bits, unnest(range(0, 64)) AS d FROM f2) WHERE bits[d + 1] = 1
)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, width, height) of a catalogue of images, one a part, of 200 to 1,399 pixels a side."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("image_id"), (200 + F.col("p_partkey") * 37 % 1200).cast("int").alias("width"), (200 + (F.col("p_partkey") * 91 + F.col("p_size") * 7) % 1200).cast("int").alias("height"))


IMAGES_SQL = "images AS (SELECT p_partkey AS image_id, CAST(200 + p_partkey * 37 % 1200 AS INT) AS width, CAST(200 + (p_partkey * 91 + p_size * 7) % 1200 AS INT) AS height FROM part)"


def broken_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label_id, wkb) of a polygon a part: bow ties of w x h for even keys, squares with two holes that overlap for odd ones."""
    import numpy as np
    import pyarrow as pa

    from ..operators.vector import wkb_polygon

    def box(x, y, w, h):
        return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], dtype=float)

    def run(batches):
        for batch in batches:
            made = []
            for key, size in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                w, h = size + 2, key % 7 + 1
                tie = [np.array([(0, 0), (w, h), (w, 0), (0, h), (0, 0)], dtype=float)]
                made.append(wkb_polygon(tie if key % 2 == 0 else [box(0, 0, w + 9, w + 9), box(1, 1, 4, 4), box(3, 3, 4, 4)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, type=pa.binary())], names=["label_id", "wkb"])

    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label_id"), F.col("p_size").cast("long").alias("size")).mapInArrow(run, "label_id long, wkb binary")


def coverage_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene, pass, coverage): foreground of the label raster gathered tile by tile along each row of tiles, in per cent."""
    return label_raster(spark, sf_dir).groupBy(F.col("tr").alias("scene"), F.col("tc").alias("pass")).agg((F.avg("fg") * 100.0).alias("coverage"))


COVERAGE_SERIES_SQL = "f3 AS (SELECT tr AS scene, tc AS pass, avg(fg) * 100.0 AS coverage FROM f1 GROUP BY tr, tc)"
