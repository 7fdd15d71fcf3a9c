"""The raster source prunes what it reads; the sink's tasks write parts that a commit lays out."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import as_pixels
from tilegraph.operators import grid
from tilegraph.sources import raster_source, tiff, tiff_sink

T = tiff.TILE


def image_blocks(image):
    """(by, bx, data) of an (h, w, bands) image, edge blocks filled up."""
    h, w, n = image.shape
    out = []
    for by in range(-(-h // T)):
        for bx in range(-(-w // T)):
            full = np.zeros((T, T, n), dtype=image.dtype)
            part = image[by * T : (by + 1) * T, bx * T : (bx + 1) * T]
            full[: part.shape[0], : part.shape[1]] = part
            out.append((by, bx, bytearray(full.tobytes())))
    return out


def sink(df, path, image, **options):
    raster_source.register(df.sparkSession)
    h, w, n = image.shape
    given = {"width": w, "height": h, "bands": n, "dtype": image.dtype.name} | options
    df.write.format("tilegraph_tiff").options(**given).mode(given.pop("mode", "overwrite")).save(str(path))


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(3).integers(0, 6, (300, 700, 3), dtype=np.uint16)


@pytest.mark.parametrize(("compression", "bigtiff"), [("lzw", "auto"), ("deflate", "yes"), ("deflate", "auto")])
def test_round_trip(spark, tmp_path, image, compression, bigtiff):
    blocks = spark.createDataFrame(image_blocks(image), tiff_sink.BLOCK_SCHEMA).repartition(4)
    sink(blocks, tmp_path / "a.tif", image, compression=compression, bigtiff=bigtiff, crs=32723, transform="2,0,100,0,-2,900", nodata="none")
    h = tiff.read_header(str(tmp_path / "a.tif"))
    assert (h.width, h.height, h.bands, h.dtype, h.crs, h.transform, h.nodata) == (700, 300, 3, "uint16", 32723, (2.0, 0.0, 100.0, 0.0, -2.0, 900.0), None)
    with open(tmp_path / "a.tif", "rb") as f:
        assert f.read(4)[2] == (43 if bigtiff == "yes" else 42)
    assert (tiff.read_window(f"file:{tmp_path}/a.tif", 0, 0, 700, 300) == image).all()
    assert os.listdir(tmp_path) == ["a.tif"]


def test_blocks_that_do_not_come_are_zero(spark, tmp_path, image):
    blocks = spark.createDataFrame(image_blocks(image), tiff_sink.BLOCK_SCHEMA)
    sink(blocks.where("bx <> 1"), tmp_path / "a.tif", image)
    want = image.copy()
    want[:, T : 2 * T] = 0
    assert (tiff.read_window(str(tmp_path / "a.tif"), 0, 0, 700, 300) == want).all()
    sink(blocks.limit(0), tmp_path / "none.tif", image)
    assert not tiff.read_window(str(tmp_path / "none.tif"), 0, 0, 700, 300).any()
    labels = raster_source.write_labels(as_pixels(spark, [[1, 2]]).limit(0), str(tmp_path / "l.tif"), 20, 10)
    assert not tiff.read_window(labels, 0, 0, 20, 10).any()


def test_a_failure_leaves_nothing_behind(spark, tmp_path, image):
    blocks = spark.createDataFrame(image_blocks(image), tiff_sink.BLOCK_SCHEMA)
    sink(blocks, tmp_path / "a.tif", image)
    before = (tmp_path / "a.tif").read_bytes()

    def fail(batches):
        for batch in batches:
            yield batch
        raise RuntimeError("this task is lost")

    lost = blocks.where("bx = 2").mapInArrow(fail, tiff_sink.BLOCK_SCHEMA)
    twice = blocks.unionByName(blocks.limit(1))
    outside = blocks.withColumn("bx", F.col("bx") + 1)
    short = blocks.withColumn("data", F.substring("data", 1, 100))
    for bad in (blocks.where("bx < 2").unionByName(lost), twice, outside, short, blocks.drop("by")):
        with pytest.raises(Exception, match="lost|twice|outside|bytes|no by"):
            sink(bad, tmp_path / "a.tif", image)
        assert os.listdir(tmp_path) == ["a.tif"] and (tmp_path / "a.tif").read_bytes() == before
    with pytest.raises(Exception, match="overwrite"):
        sink(blocks, tmp_path / "a.tif", image, mode="append")
    with pytest.raises(Exception, match="shared mount"):
        sink(blocks, "hdfs://host/a.tif", image)
    assert os.listdir(tmp_path) == ["a.tif"]


def test_attempts_that_no_message_names_do_not_count(spark, tmp_path, image):
    """A lost executor's attempt and a speculative one leave parts; only the committed one is in the image."""
    import pyarrow as pa

    schema = spark.createDataFrame([], tiff_sink.BLOCK_SCHEMA).schema
    options = {"path": str(tmp_path / "a.tif"), "width": "700", "height": "300", "bands": "3", "dtype": "uint16"}
    writer = tiff_sink.TiffWriter(options, schema, True)
    rows = image_blocks(image)
    batch = lambda some: [pa.RecordBatch.from_pylist([{"by": a, "bx": b, "data": bytes(d)} for a, b, d in some])]
    writer.write(iter(batch([(a, b, bytes(len(d))) for a, b, d in rows])))
    kept = [writer.write(iter(batch(rows[:2]))), writer.write(iter(batch(rows[2:]))), writer.write(iter([])), None]
    writer.commit(kept)
    assert (tiff.read_window(str(tmp_path / "a.tif"), 0, 0, 700, 300) == image).all() and os.listdir(tmp_path) == ["a.tif"]
    again = tiff_sink.TiffWriter(options, schema, True)
    again.write(iter(batch(rows)))
    again.abort([None])
    assert os.listdir(tmp_path) == ["a.tif"]


def test_filters_drop_tiles(spark, tmp_path, image):
    sink(spark.createDataFrame(image_blocks(image), tiff_sink.BLOCK_SCHEMA), tmp_path / "a.tif", image)
    read = lambda where=None: raster_source.read_tiles(spark, str(tmp_path / "a.tif"), 100, 7, edge="cover", where=where)
    tiles = read()
    assert tiles.rdd.getNumPartitions() == 21
    full = {(r["tile_row"], r["tile_col"]): r for r in tiles.collect()}
    for condition, n in [
        ("tile_row = 1", 7), ("tile_row = 1 AND tile_col IN (0, 6, 9)", 2), ("x0 < 250 AND x1 > 110 AND y0 < 100", 2), ("NOT tile_col = 3", 18), ("tile_row <=> 2 AND read_x >= 93", 6),
        ("tile_row > 5", 0), ("tile_row IS NOT NULL AND crop_x = 0", 3), ("tile_row IS NULL", 0), ("width < 114 AND height = 114", 2), ("dtype = 'uint16' AND tile_col <> 0", 18),
    ]:
        some = read(condition)
        assert some.rdd.getNumPartitions() == max(n, 1), condition
        got = {(r["tile_row"], r["tile_col"]): r for r in some.collect()}
        assert len(got) == n and got == {(r["tile_row"], r["tile_col"]): r for r in tiles.where(condition).collect()}, condition
    either = read("tile_row = 0 OR tile_col = 0")  # not a conjunction: Spark filters
    assert {(r["tile_row"], r["tile_col"]) for r in either.collect()} == {k for k in full if 0 in k}


def test_a_pruned_relation_can_be_filtered_on(spark, tmp_path, image):
    """Two filters on one DataFrame, in one query and one after the other, see what each asks for."""
    sink(spark.createDataFrame(image_blocks(image), tiff_sink.BLOCK_SCHEMA), tmp_path / "a.tif", image)
    for tiles in (raster_source.read_tiles(spark, str(tmp_path / "a.tif"), 100, edge="cover", where=w) for w in (None, "tile_row >= 0", "tile_col < 5")):
        rows = tiles.count()
        a, b = tiles.where("tile_row = 0"), tiles.where("tile_row = 1")
        assert sorted(r["tile_row"] for r in a.union(b).collect()) == [0] * (rows // 3) + [1] * (rows // 3)
        assert a.count() == rows // 3 and tiles.count() == rows
        assert a.join(b, "tile_col").count() == rows // 3


def test_columns_decide_which_bands_are_read(spark, tmp_path, image):
    sink(spark.createDataFrame(image_blocks(image), tiff_sink.BLOCK_SCHEMA), tmp_path / "a.tif", image, compression="deflate")
    path = str(tmp_path / "a.tif")
    columns = "band_3 binary, tile_col int, band_1 binary, height int, width int, tile_row int"
    r = raster_source.read_tiles(spark, path, 100, edge="cover", columns=columns, where="tile_row = 1 AND tile_col = 2").first()
    plane = lambda c: np.frombuffer(r[c], dtype=np.uint16).reshape(r["height"], r["width"])
    assert (plane("band_3") == image[100:200, 200:300, 2]).all() and (plane("band_1") == image[100:200, 200:300, 0]).all()
    with open(path, "r+b") as f:  # blocks that can't be decoded
        f.seek(tiff.HEAD)
        f.write(b"\0" * 100)
    places = raster_source.read_tiles(spark, path, 100, edge="cover", columns="tile_row int, x0 int")
    assert places.agg(F.sum("x0")).first()[0] == 3 * 2100
    with pytest.raises(Exception, match="decompress|zlib"):
        raster_source.read_tiles(spark, path, 100, edge="cover", columns=columns, where="tile_row = 0 AND tile_col = 0").collect()
    with pytest.raises(Exception, match="no column"):
        raster_source.read_tiles(spark, path, 100, columns="nothing int").collect()


@pytest.mark.parametrize("edge", ["cover", "whole"])
@pytest.mark.parametrize("padding", [0, 3])
def test_small_tiles_share_partitions(spark, tmp_path, image, edge, padding):
    """Thousands of tiles are some dozens of partitions, and each tile is what read_window() gives for its own place."""
    sink(spark.createDataFrame(image_blocks(image), tiff_sink.BLOCK_SCHEMA), tmp_path / "a.tif", image, compression="deflate")
    path = str(tmp_path / "a.tif")
    read = lambda where=None: raster_source.read_tiles(spark, path, 9, padding, edge=edge, where=where)
    tiles = read()
    rows = tiles.collect()
    cols, down, total = grid.grid_size(image.shape[1], image.shape[0], 9, edge)
    assert sorted((r["tile_row"], r["tile_col"]) for r in rows) == [(i, j) for i in range(down) for j in range(cols)] and total > 1000
    assert 32 <= tiles.rdd.getNumPartitions() <= 100
    for r in rows:
        there = image[r["read_y"] : r["read_y"] + r["height"], r["read_x"] : r["read_x"] + r["width"]]
        assert bytes(r["data"]) == np.ascontiguousarray(there).tobytes()
    some = read("x1 <= 48 AND tile_row <> 5")
    assert {(r["tile_row"], r["tile_col"]) for r in some.collect()} == {(r["tile_row"], r["tile_col"]) for r in rows if r["x1"] <= 48 and r["tile_row"] != 5}
    assert some.rdd.getNumPartitions() < 60


def test_rectangles_cover_the_grid_once():
    for rows, cols, most in (([0, 1, 2, 5, 6, 9], [1, 2, 3], 4), (range(50), range(3), 20), (range(2), range(90), 30), (range(7), range(7), 1), ([], range(4), 9)):
        parts = raster_source.rectangles(rows, cols, most)
        assert sorted((r, c) for down, across in parts for r in down for c in across) == [(r, c) for r in rows for c in cols]
        assert all(len(down) * len(across) <= most for down, across in parts)
