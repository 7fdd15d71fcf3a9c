"""Codecs, files, configuration, the command line and the whole raster pipeline."""

import json
import os
import sqlite3
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import as_pixels
from tilegraph import cli, config
from tilegraph.api import segment, segment_with
from tilegraph.operators import vector
from tilegraph.sources import raster_source, tiff, vector_files


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_lzw_round_trip(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_long():
    data = np.random.default_rng(0).integers(0, 4, 200_000, dtype=np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def write_image(path, image, crs=None, transform=None):
    h, w, n = image.shape
    out = tiff.Writer(str(path), w, h, image.dtype.name, n, crs, transform, None)
    for by in range(0, -(-h // tiff.TILE)):
        for bx in range(0, -(-w // tiff.TILE)):
            out.write(bx, by, image[by * tiff.TILE : (by + 1) * tiff.TILE, bx * tiff.TILE : (bx + 1) * tiff.TILE])
    out.close()


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "uint32", "float32", "float64"])
def test_tiff_round_trip(tmp_path, dtype):
    image = (np.random.default_rng(1).random((300, 520, 3)) * 250).astype(dtype)
    write_image(tmp_path / "a.tif", image, 32723, (2.0, 0.0, 100.0, 0.0, -2.0, 900.0))
    h = tiff.read_header(str(tmp_path / "a.tif"))
    assert (h.width, h.height, h.bands, h.dtype, h.crs, h.transform) == (520, 300, 3, dtype, 32723, (2.0, 0.0, 100.0, 0.0, -2.0, 900.0))
    assert (tiff.read_window(str(tmp_path / "a.tif"), 0, 0, 520, 300) == image).all()
    assert (tiff.read_window(str(tmp_path / "a.tif"), 250, 100, 100, 180, [3, 1]) == image[100:280, 250:350][:, :, [2, 0]]).all()
    with pytest.raises(FileNotFoundError):
        tiff.read_header(str(tmp_path / "none.tif"))


def test_source_reads_windows(spark, tmp_path):
    image = np.random.default_rng(2).integers(0, 255, (200, 105, 3), dtype=np.uint8)
    write_image(tmp_path / "a.tif", image)
    rows = {(r["tile_row"], r["tile_col"]): r for r in raster_source.read_tiles(spark, str(tmp_path / "a.tif"), 50, 5).collect()}
    assert len(rows) == 8
    r = rows[1, 1]
    data = np.frombuffer(r["data"], dtype=np.uint8).reshape(r["height"], r["width"], 3)
    assert (r["read_x"], r["crop_x"], r["read_y"], r["crop_y"]) == (45, 10, 45, 5)
    assert (data == image[45:105, 45:105]).all()
    one = raster_source.read_tiles(spark, str(tmp_path / "a.tif"), 50, 5, [2]).where("tile_row = 0 and tile_col = 0").first()
    assert one["bands"] == 1


def test_uint8_and_rgb():
    assert raster_source.uint8(np.array([[255, 3]], dtype=np.uint16)).tolist() == [[255, 3]]
    assert raster_source.uint8(np.array([[256, 65535]], dtype=np.uint16)).tolist() == [[1, 255]]
    assert raster_source.uint8(np.array([[-1.0, 0.5, 2.0]])).tolist() == [[0, 127, 255]]
    with pytest.raises(ValueError):
        raster_source.uint8(np.array([[1]], dtype=np.int64))
    assert raster_source.rgb(np.zeros((2, 2), dtype=np.uint8)).shape == (2, 2, 3)
    assert raster_source.rgb(np.zeros((2, 2, 5), dtype=np.uint8)).shape == (2, 2, 3)
    with pytest.raises(ValueError):
        raster_source.rgb(np.zeros((2, 2, 2), dtype=np.uint8))


@pytest.mark.parametrize(("top", "dtype"), [(7, "uint8"), (300, "uint16"), (70_000, "uint32")])
def test_labels_take_the_smallest_type(spark, tmp_path, top, dtype):
    rows = [[0, 1, 2], [top, 0, 3]]
    path = raster_source.write_labels(as_pixels(spark, rows), str(tmp_path / "l.tif"), 3, 2)
    assert tiff.read_header(path).dtype == dtype
    assert tiff.read_window(path, 0, 0, 3, 2)[..., 0].tolist() == rows
    mask = raster_source.write_mask(as_pixels(spark, rows), str(tmp_path / "m.tif"), 3, 2)
    assert tiff.read_window(mask, 0, 0, 3, 2)[..., 0].tolist() == [[0, 1, 1], [1, 0, 1]]


RING = [[1, 1, 1], [1, 0, 1], [1, 1, 1]]


def test_vector_files(spark, tmp_path):
    features = vector.polygons(as_pixels(spark, RING), tolerance=0.0)
    for ext in (".shp", ".gpkg", ".geojson"):
        assert vector_files.save_features(features, str(tmp_path / f"a{ext}"), 32723) == 1
        assert vector_files.save_features(features.where("label_id < 0"), str(tmp_path / f"none{ext}")) == 0
        assert not os.path.exists(tmp_path / f"none{ext}")
    with pytest.raises(ValueError):
        vector_files.save_features(features, str(tmp_path / "a.kml"))
    shape = json.load(open(tmp_path / "a.geojson"))["features"][0]
    assert len(shape["geometry"]["coordinates"]) == 2 and shape["properties"] == {"label_id": 1, "area_m2": 8.0, "perimeter_m": 16.0}
    db = sqlite3.connect(tmp_path / "a.gpkg")
    (blob, label) = db.execute("SELECT geom, label_id FROM segments").fetchone()
    assert label == 1 and blob[:2] == b"GP" and len(vector.read_wkb(blob[8:])) == 2
    data = open(tmp_path / "a.shp", "rb").read()
    assert struct.unpack(">i", data[:4])[0] == 9994 and struct.unpack(">i", data[24:28])[0] * 2 == len(data)
    assert os.path.getsize(tmp_path / "a.dbf") == 32 + 96 + 1 + 67 + 1


def test_simplify_keeps_rings():
    stairs = np.array([(0, 0), *[(k + d, k) for k in range(1, 20) for d in (0, 1)], (20, 25), (0, 25), (0, 0)], dtype=float)
    out = vector.simplify(stairs, 1.0)
    assert len(out) < len(stairs) / 3 and (out[0] == out[-1]).all() and vector.simplify(stairs, 0) is stairs


def test_config(tmp_path):
    c = config.Config().validate()
    assert c.tile.padded_size == 1100
    path = str(tmp_path / "c.yaml")
    config.save(c.with_overrides(tile_size=256, max_passes=3, box_nms_thresh=0.5, streaming_mode="disk"), path)
    again = config.load(path)
    assert (again.tile.size, again.segmentation.max_passes, again.segmentation.box_nms_thresh, again.output.streaming_mode) == (256, 3, 0.5, "disk")
    assert again.with_overrides(max_passes=None).segmentation.max_passes is None
    assert again.with_overrides(max_passes=config.UNSET) == again
    (tmp_path / "empty.yaml").write_text("")
    assert config.load(str(tmp_path / "empty.yaml")) == config.Config()
    with pytest.raises(ValueError):
        c.with_overrides(no_such=1)
    with pytest.raises(ValueError):
        config.from_dict({"tile": {"sise": 3}})
    for bad in ({"tile_size": 0}, {"padding": -1}, {"iou_start": 1.5}, {"stability_end": 0}, {"point_strategy": "x"}, {"merge_strategy": "x"}, {"target_coverage": 101}, {"max_passes": 0}):
        with pytest.raises(ValueError):
            c.with_overrides(**bad).validate()


def scene():
    rng = np.random.default_rng(5)
    return np.kron(rng.integers(20, 255, (6, 9, 3)), np.ones((16, 16, 1))).astype(np.uint8)


OPTIONS = {"tile_size": 48, "padding": 8, "points_per_side": 12, "min_mask_area": 20, "simplify_tolerance": 0.0, "save_geopackage": True}


@pytest.mark.parametrize("edge", ["whole", "cover"])
def test_pipeline(spark, tmp_path, edge):
    write_image(tmp_path / "s.tif", scene(), 32723, (1.0, 0.0, 0.0, 0.0, -1.0, 96.0))
    result = segment_with(spark, str(tmp_path / "s.tif"), str(tmp_path / "out"), **OPTIONS, tile_edge=edge)
    assert result.n_segments > 10 and result.coverage > 95
    labels = tiff.read_window(result.labels_path, 0, 0, 144, 96)[..., 0]
    assert len(np.unique(labels[labels > 0])) == result.n_segments
    stats = json.load(open(result.stats_path))
    assert stats["summary"]["total_tiles"] == len(stats["tiles"]) == 6
    merge = stats["merge_stats"]
    assert merge["segments_before_merge"] - merge["segments_after_merge"] == merge["labels_merged"]
    assert os.path.exists(result.shapefile_path) and os.path.exists(result.geopackage_path) and os.path.exists(result.before_path)
    # one colour, one segment: flat blocks of the scene that touch a seam are one again
    first = labels[:16, :16]
    assert len(np.unique(first)) == 1


def test_numbering_equals_serial_processing(spark, tmp_path):
    from tilegraph.operators import multipass
    from tilegraph.plans.pipeline import Pipeline

    write_image(tmp_path / "s.tif", scene())
    c = config.Config().with_overrides(**OPTIONS)
    plan = Pipeline(c).plan(spark, str(tmp_path / "s.tif"))
    got = {(r["x"], r["y"]): r["label"] for r in plan.assembled.collect()}
    proposer, offset = multipass.FloodProposer(min_area=20), 0
    for row in range(2):
        for col in range(3):
            x, cx, w = raster_source.axis(col, 3, 144, 48, 8, "whole")
            y, cy, h = raster_source.axis(row, 2, 96, 48, 8, "whole")
            labels, _ = multipass.run_tile(scene()[y : y + h, x : x + w], proposer, c.segmentation, c.threshold, 20)
            useful = labels[cy : cy + 48, cx : cx + 48]
            assert all(got[col * 48 + i, row * 48 + j] == (v + offset if v else 0) for (j, i), v in np.ndenumerate(useful))
            offset += useful.max()


def test_strategy_none_skips_cleaning(spark, tmp_path):
    write_image(tmp_path / "s.tif", scene())
    result = segment(spark, str(tmp_path / "s.tif"), str(tmp_path / "out"), config.Config().with_overrides(**OPTIONS, merge_strategy="none", save_shapefile=False))
    assert result.stats["merge_stats"]["labels_merged"] == 0 and result.shapefile_path is None


def test_command_line(spark, tmp_path, capsys):
    write_image(tmp_path / "s.tif", scene())
    code = cli.main([str(tmp_path / "s.tif"), str(tmp_path / "out"), "--tile-size", "48", "--padding", "8", "--points-per-side", "12", "--no-save-shapefile", "--max-passes", "2"])
    assert code == 0 and "segments" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "none.tif"), str(tmp_path / "out")]) == 1
    assert "error" in capsys.readouterr().err


def test_previews(spark, tmp_path):
    write_image(tmp_path / "s.tif", scene())
    from pyspark.sql import functions as F

    blocks = raster_source.to_rgb_blocks(raster_source.read_tiles(spark, str(tmp_path / "s.tif"), 48))
    tiles = blocks.withColumn("labels", F.array_repeat(F.lit(3).cast("long"), 48 * 48))
    rows = raster_source.tile_previews(tiles).collect()
    assert len(rows) == 6 and all(bytes(r["png"][:4]) == b"\x89PNG" for r in rows)


def test_arrivals(spark, tmp_path):
    from tests.test_goldens import FOUR
    from tilegraph.operators import seams
    from tilegraph.streaming.arrivals import PIXELS, SeamStore, merge_arrivals

    px = as_pixels(spark, FOUR)
    source = str(tmp_path / "in")
    store = SeamStore(spark, str(tmp_path / "store"), 2)
    for k, rule in enumerate(("x < 2 and y < 2", "x >= 2 and y < 2", "y >= 2")):
        px.where(rule).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PIXELS).parquet(source)
        q = merge_arrivals(stream, store, str(tmp_path / "ck"))
        q.processAllAvailable()
        q.stop()
        assert store.pixels().count() == px.where(" or ".join(f"({r})" for r in ("x < 2 and y < 2", "x >= 2 and y < 2", "y >= 2")[: k + 1])).count()
    want = {tuple(r) for r in seams.relabel_table(seams.chosen(px, 2)).collect()}
    assert {tuple(r) for r in store.relabel_table().collect()} == want
    # a tile that arrives again: its latest pixels stand, and only its lines are counted anew
    store.add(px.where("x >= 2 and y >= 2").selectExpr("x", "y", "9L - label AS label"), 3)
    now = px.selectExpr("x", "y", "CASE WHEN x >= 2 AND y >= 2 THEN 9 - label ELSE label END AS label")
    key = lambda df: {tuple(r) for r in df.select("axis", "line", "a", "b", "cnt").collect()}
    assert key(store.contacts()) == key(seams.contacts(now, 2)) and store.pixels().count() == now.count()
    assert {tuple(r) for r in store.pixels().collect()} == {tuple(r) for r in now.collect()}


@pytest.mark.parametrize("mode", ["ram", "disk", "auto"])
def test_mosaic(spark, mode):
    from tilegraph.sources.mosaic import BLOCK, Mosaic

    m = Mosaic(spark, 4, 2, 2, mode)
    m.write_tiles(spark.createDataFrame([(0, 0, [1, 1, 1, 0]), (0, 1, [2, 2, 0, 3])], BLOCK))
    before = m.copy()
    m.write_tiles(spark.createDataFrame([(0, 1, [5, 5, 5, 5])], BLOCK))
    assert m.shape == (2, 4) and m.blocks().count() == 2
    got = {(r["x"], r["y"]): r["label"] for r in m.read().collect()}
    assert got == {(0, 0): 1, (1, 0): 1, (0, 1): 1, (1, 1): 0, (2, 0): 5, (3, 0): 5, (2, 1): 5, (3, 1): 5}
    assert {r["label"] for r in before.read().where("x >= 2").collect()} == {0, 2, 3}
    m.update(spark.createDataFrame([(x, y, 9 if x else 0) for x in range(4) for y in range(2)], "x int, y int, label long"))
    assert {r["label"] for r in m.read().where("x > 0").collect()} == {9}
    m.close()
    assert m.blocks().count() == 0
    with pytest.raises(ValueError):
        Mosaic(spark, 4, 2, 2, "tape")


# ---------------------------------------------------------------- proposers, previews, presets


class Shaky:
    """Fails on the first tile that it sees after it was opened for the first time."""

    def __init__(self, flag, always=False):
        self.flag, self.always, self.inner, self.opened = flag, always, None, 0

    def open(self):
        from tilegraph.operators.multipass import FloodProposer

        self.inner, self.opened = FloodProposer(min_area=20), self.opened + 1

    def close(self):
        self.inner = None

    def propose(self, image, points, iou, stability):
        if self.always or self.opened == 1:
            open(self.flag, "a").write("x")
            raise RuntimeError("out of memory")
        return self.inner.propose(image, points, iou, stability)


def made_elsewhere(config, min_area):
    from tilegraph.operators.multipass import FloodProposer

    return FloodProposer(levels=4, min_area=min_area)


def test_a_failing_proposer_is_opened_anew(spark, tmp_path):
    write_image(tmp_path / "s.tif", scene())
    flag = tmp_path / "failed"
    good = segment_with(spark, str(tmp_path / "s.tif"), str(tmp_path / "a"), **OPTIONS, save_shapefile=False)
    again = segment_with(spark, str(tmp_path / "s.tif"), str(tmp_path / "b"), proposer=Shaky(str(flag)), **OPTIONS, save_shapefile=False)
    assert flag.read_text() and again.n_segments == good.n_segments
    with pytest.raises(Exception, match="out of memory"):
        segment_with(spark, str(tmp_path / "s.tif"), str(tmp_path / "c"), proposer=Shaky(str(flag), True), **OPTIONS, save_shapefile=False)


def test_proposers_by_name():
    from tilegraph.config import Segmentation
    from tilegraph.operators import multipass

    assert isinstance(multipass.make_proposer(None, Segmentation()), multipass.FloodProposer)
    assert multipass.make_proposer("tests.test_io:made_elsewhere", Segmentation(), 7).min_area == 7
    with pytest.raises(ValueError, match="no proposer named"):
        multipass.make_proposer("weights.pt", Segmentation())
    cropped = multipass.make_proposer("flood", Segmentation(crop_n_layers=1), 20)
    image = scene()
    points = multipass.uniform_points(*image.shape[:2], 12)
    cropped.open()
    whole = cropped.inner.propose(image, points, 0.5, 0.5)
    both = cropped.propose(image, points, 0.5, 0.5)
    assert len(both) > len(whole) and all(p.mask.shape == image.shape[:2] and p.mask.any() for p in both)


def read_png(path):
    import zlib

    data, at, body = open(path, "rb").read(), 8, b""
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h = struct.unpack(">II", part[:8])
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(h, 1 + 3 * w)[:, 1:].reshape(h, w, 3)


@pytest.mark.parametrize("edge", ["whole", "cover"])
def test_preview_of_the_whole_image(spark, tmp_path, edge):
    image = scene()
    write_image(tmp_path / "s.tif", image)
    blocks = raster_source.to_rgb_blocks(raster_source.read_tiles(spark, str(tmp_path / "s.tif"), 48, 8, edge=edge))
    rows = (np.arange(96)[:, None] // 16 * 9 + np.arange(144) // 16) % 5
    px = as_pixels(spark, rows.tolist())
    for most, step in ((1024, 1), (50, 3)):
        out = raster_source.write_preview(blocks, px, str(tmp_path / "p.png"), 144, 96, 48, 0.5, most)
        seen = image[::step, ::step]
        if edge == "cover":
            want = (seen * 0.5 + raster_source.colours(rows[::step, ::step]) * 0.5).astype(np.uint8)
            assert (read_png(out) == want).all()
        assert read_png(out).shape == seen.shape
    assert raster_source.colours(np.array([0])).tolist() == [[0, 0, 0]]
    result = segment_with(spark, str(tmp_path / "s.tif"), str(tmp_path / "out"), **OPTIONS, save_shapefile=False, save_preview=True, streaming_mode="ram")
    assert read_png(result.preview_path).shape == (96, 144, 3)


def test_presets():
    one = config.preset("single_pass").validate()
    assert (one.segmentation.max_passes, one.segmentation.points_per_side, one.tile.padding, one.merge.merge_strategy) == (1, 32, 0, "none")
    with pytest.raises(ValueError):
        config.preset("none")
    assert cli.parser().parse_args(["a", "b", "--preset", "single_pass"]).preset == "single_pass"


def test_well_known_text():
    south = vector_files.wkt(32723)
    assert south.startswith('PROJCS["WGS 84 / UTM zone 23S"') and 'PARAMETER["central_meridian",-45]' in south and 'PARAMETER["false_northing",10000000]' in south
    assert vector_files.wkt().startswith('GEOGCS["WGS 84"') and 'central_meridian",9]' in vector_files.wkt(25832)
    assert vector_files.wkt(31983).startswith('PROJCS["SIRGAS 2000 / UTM zone 23S"') and vector_files.wkt(2154) == 'LOCAL_CS["EPSG:2154",UNIT["metre",1],AUTHORITY["EPSG","2154"]]'
    for code in (4326, 3857, 32601, 32760, 25828, 26901, 31965, 31985, 9999):
        text = vector_files.wkt(code)
        assert text.count("[") == text.count("]") and text.endswith(f'"{code}"]]')


@pytest.mark.parametrize("mode", ["ram", "disk", "auto"])
def test_tables_are_kept(spark, mode):
    from tilegraph.functions import storage

    df = spark.range(100)
    assert storage.keep(df, mode, 10**15).count() == 100
    with pytest.raises(ValueError):
        storage.keep(df, "tape")
