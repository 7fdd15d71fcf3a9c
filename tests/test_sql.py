"""Functions under SQL names, against the operators that they stand for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilegraph import sql
from tilegraph.functions import raster
from tilegraph.operators import clusters, components


@pytest.fixture(scope="module")
def pixels(spark):
    sql.register(spark)
    rng = np.random.default_rng(3)
    rows = [(x, y, int(v)) for (y, x), v in np.ndenumerate(rng.integers(0, 3, (25, 34)))]
    px = spark.createDataFrame(rows, "x int, y int, label bigint").repartition(5)
    px.createOrReplaceTempView("px")
    return px


def test_values(spark, pixels):
    got = spark.sql("SELECT label, tg_colour(label) AS c, tg_black_mask(x, cast(label AS INT)) AS b, tg_float_to_uint8(x / 20.0) AS f, tg_uint16_to_uint8(x * 40, 1360) AS u, tg_map_x(x, y, array(2D, 0D, 5D, 0D, -2D, 9D)) AS mx, tg_map_y(x, y, array(2D, 0D, 5D, 0D, -2D, 9D)) AS my, x, y, tg_tile(x - 3, 7) AS t FROM px")
    want = pixels.select(
        "label", raster.colour(F.col("label")).alias("c"), raster.black_mask(F.col("x").cast("double"), F.col("label")).alias("b"), raster.to_uint8(F.col("x") / 20.0, "float64").alias("f"),
        raster.to_uint8(F.col("x") * 40, "uint16", F.lit(1360)).alias("u"), *(c.cast("double").alias(n) for c, n in zip(raster.affine(F.col("x"), F.col("y"), (2, 0, 5, 0, -2, 9)), ("mx", "my"), strict=True)), "x", "y", F.floor((F.col("x") - 3) / 7).cast("int").alias("t"),
    )
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert key(got) == key(want)
    assert "PythonUDF" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_tables(spark, pixels):
    by_tile = "SELECT *, tg_tile(y, 10) AS tile_row, tg_tile(x, 10) AS tile_col FROM px"
    got = spark.sql(f"SELECT * FROM tg_tile_components(TABLE({by_tile}) PARTITION BY (tile_row, tile_col))")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, components.tile_ordinals(pixels, 10, "label").collect()))
    points = spark.sql(f"SELECT * FROM tg_cluster_points(TABLE({by_tile} WHERE label = 0) PARTITION BY (tile_row, tile_col), 4, 0)").collect()
    free = {(r["x"], r["y"]) for r in pixels.where("label = 0").collect()}
    want = clusters.tile_points(pixels.where("label = 0"), 10, 4, 0).groupBy("tile_row", "tile_col").count().collect()
    counts = {}
    for p in points:
        assert (p["x"], p["y"]) in free and (p["y"] // 10, p["x"] // 10) == (p["tile_row"], p["tile_col"])
        counts[p["tile_row"], p["tile_col"]] = counts.get((p["tile_row"], p["tile_col"]), 0) + 1
    assert counts == {(r["tile_row"], r["tile_col"]): r["count"] for r in want}
    assert spark.sql(f"SELECT * FROM tg_cluster_points(TABLE({by_tile} WHERE label > 9) PARTITION BY (tile_row, tile_col), 4, 0)").count() == 0
