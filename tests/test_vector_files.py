"""Vector files written in parts by tasks and read by ranges."""

import json
import os
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilegraph.operators import vector
from tilegraph.sources import vector_files


def square(x, y, size, hole=False):
    ring = lambda a, b, s: np.array([(a, b), (a + s, b), (a + s, b + s), (a, b + s), (a, b)], dtype=float)
    return vector.wkb_polygon([ring(x, y, size), ring(x + 1, y + 1, size / 4)[::-1]] if hole else [ring(x, y, size)])


@pytest.fixture(scope="module")
def features(spark):
    rows = [(k, k * 0, square(k * 10, k % 7, 5 + k % 3, k % 4 == 0), float((5 + k % 3) ** 2), 4.0 * (5 + k % 3), 1) for k in range(137)]
    return spark.createDataFrame([(a, b, bytearray(w), c, d, e) for a, b, w, c, d, e in rows], vector.FEATURE).repartition(6)


def rings_of(wkb):
    """Rings as sets of edges, whichever way and from wherever they run."""
    return {frozenset(frozenset(map(tuple, e)) for e in zip(r.tolist(), r[1:].tolist(), strict=False)) for r in vector.read_wkb(bytes(wkb))}


@pytest.mark.parametrize("kind", [".shp", ".gpkg", ".geojson"])
def test_round_trip_in_parts(spark, tmp_path, monkeypatch, features, kind):
    monkeypatch.setattr(vector_files, "RENUMBERED", 500)
    path = str(tmp_path / f"a{kind}")
    assert vector_files.save_features(features, path, 32723) == 137
    want = {r["label_id"]: (r["area_m2"], r["perimeter_m"], rings_of(r["wkb"])) for r in features.collect()}
    for records in (100_000, 10):
        found = vector_files.read_features(spark, path, records)
        rows = found.collect()
        assert len(rows) == 137 and {r["label_id"]: (r["area_m2"], r["perimeter_m"], rings_of(r["wkb"])) for r in rows} == want
    assert found.rdd.getNumPartitions() >= 3
    drawn = {r["label_id"]: r["drawn"] for r in vector.drawn_areas(found).collect()}
    assert drawn[0] == 25 - 25 / 16 and drawn[1] == 36
    assert sorted(os.listdir(tmp_path)) == sorted(f"a{e}" for e in ([".shp", ".shx", ".dbf", ".prj"] if kind == ".shp" else [kind]))
    # again, over what is there; and nothing from nothing
    assert vector_files.save_features(features.where("label_id < 3"), path) == 3 and vector_files.read_features(spark, path).count() == 3
    none = str(tmp_path / f"none{kind}")
    assert vector_files.save_features(features.limit(0), none) == 0 and not os.path.exists(none)


def test_files_are_whole(tmp_path, features):
    vector_files.save_features(features, str(tmp_path / "a.shp"))
    shp, shx, dbf = ((tmp_path / f"a.{e}").read_bytes() for e in ("shp", "shx", "dbf"))
    assert struct.unpack(">i", shp[24:28])[0] * 2 == len(shp) and struct.unpack(">i", shx[24:28])[0] * 2 == len(shx) == 100 + 8 * 137
    at = 100
    for k in range(137):  # records follow each other, numbered from 1, where the index says
        number, words = struct.unpack_from(">ii", shp, at)
        assert number == k + 1 and struct.unpack_from(">ii", shx, 100 + 8 * k) == (at // 2, words)
        at += 8 + 2 * words
    assert at == len(shp) and len(dbf) == 32 + 96 + 1 + 67 * 137 + 1 and dbf[-1] == 0x1A
    assert struct.unpack_from("<4d", shp, 36) == (0.0, 0.0, 1360 + 6.0, 6 + 7.0)
    vector_files.save_features(features, str(tmp_path / "a.geojson"))
    found = json.loads((tmp_path / "a.geojson").read_text())["features"]
    assert len(found) == 137 and all(vector.signed_area(np.array(f["geometry"]["coordinates"][0])) > 0 for f in found)
    vector_files.save_features(features, str(tmp_path / "a.gpkg"))
    db = sqlite3.connect(tmp_path / "a.gpkg")
    assert db.execute("SELECT count(*), min(fid), max(fid) FROM segments").fetchone() == (137, 1, 137)
    assert db.execute("SELECT min_x, min_y, max_x, max_y FROM gpkg_contents").fetchone() == (0.0, 0.0, 1366.0, 13.0)
    assert db.execute("PRAGMA integrity_check").fetchone() == ("ok",)


@pytest.mark.parametrize("kind", [".shp", ".gpkg", ".geojson"])
def test_a_failed_task_leaves_nothing(tmp_path, features, kind):
    bad = features.withColumn("wkb", F.when(F.col("label_id") == 99, F.lit(b"\x01")).otherwise(F.col("wkb")))
    with pytest.raises(Exception):
        vector_files.save_features(bad, str(tmp_path / f"a{kind}"))
    assert os.listdir(tmp_path) == []


def test_unknown_formats(spark, tmp_path, features):
    for act in (lambda: vector_files.save_features(features, str(tmp_path / "a.kml")), lambda: vector_files.save_features(features, "s3a://bucket/a.shp"), lambda: vector_files.read_features(spark, str(tmp_path / "a.kml")).count()):
        with pytest.raises(Exception, match="no vector format|shared mount"):
            act()
