"""A mosaic of versions: writes touch their own tiles, readers open what they ask for, old versions stay."""

import os

import pytest

from tilegraph.sources import mosaic_table
from tilegraph.sources.mosaic import BLOCK
from tilegraph.sources.mosaic_table import MosaicTable


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def labels_of(df):
    return {(r["x"], r["y"]): r["label"] for r in df.collect()}


def test_versions(spark, tmp_path):
    m = MosaicTable(spark, str(tmp_path / "m"), 6, 4, 2)
    assert m.versions() == [] and m.read().count() == 0
    assert m.write_tiles(spark.createDataFrame([(0, 0, [1, 1, 1, 0]), (0, 1, [2, 2, 0, 3]), (1, 2, [8, 8, 8, 8])], BLOCK)) == 1
    before = files(tmp_path)
    assert m.write_tiles(spark.createDataFrame([(0, 1, [5, 5, 5, 5])], BLOCK)) == 2
    assert before <= files(tmp_path)  # what was there is as it was
    assert m.update(spark.createDataFrame([(0, 0, 7), (4, 3, None), (5, 0, 4)], "x int, y int, label long")) == 3
    one = {(0, 0): 1, (1, 0): 1, (0, 1): 1, (1, 1): 0, (2, 0): 2, (3, 0): 2, (2, 1): 0, (3, 1): 3, (4, 2): 8, (5, 2): 8, (4, 3): 8, (5, 3): 8}
    two = one | dict.fromkeys([(2, 0), (3, 0), (2, 1), (3, 1)], 5)
    three = two | {(0, 0): 7, (4, 3): 0, (4, 0): 0, (5, 0): 4, (4, 1): 0, (5, 1): 0}
    assert [labels_of(m.read(v)) for v in (1, 2, 3)] == [one, two, three] and labels_of(m.read()) == three and m.versions() == [1, 2, 3]
    assert labels_of(m.read(2, "tile_row = 0 AND tile_col = 1")) == {k: 5 for k in two if two[k] == 5}
    with pytest.raises(ValueError, match="no version"):
        m.read(9)
    m.vacuum(2)
    assert m.versions() == [2, 3]
    assert labels_of(m.read(2)) == two and labels_of(m.read()) == three
    m.write_tiles(spark.createDataFrame([(1, 0, [6, 6, 6, 6])], BLOCK))
    assert m.vacuum(4) > 0
    assert m.versions() == [4] and labels_of(m.read()) == three | dict.fromkeys([(0, 2), (1, 2), (0, 3), (1, 3)], 6)


def test_one_of_ten_thousand_tiles(spark, tmp_path, monkeypatch):
    """Writing a tile writes one file; reading one opens one."""
    monkeypatch.setattr(mosaic_table, "TILES_PER_FILE", 500)
    m = MosaicTable(spark, str(tmp_path / "m"), 200, 200, 2)
    m.write_tiles(spark.range(10_000).selectExpr("cast(id div 100 as int) AS tile_row", "cast(id % 100 as int) AS tile_col", "array(id, id, id, id) AS labels"))
    data = files(tmp_path / "m" / "data")
    assert len(data) >= 20
    opened = lambda df: [f for f in df.inputFiles() if "/data/" in f]
    assert len(opened(m.blocks(where="tile_row = 31 AND tile_col = 7"))) == 1
    assert m.blocks(where="tile_row = 31 AND tile_col = 7").first()["labels"] == [3107] * 4
    m.write_tiles(spark.createDataFrame([(31, 7, [1, 2, 3, 4])], BLOCK))
    assert len(files(tmp_path / "m" / "data") - data) == 1
    some = m.blocks(where="tile_row = 31 AND tile_col BETWEEN 6 AND 8")
    assert {r["tile_col"]: r["labels"] for r in some.collect()} == {6: [3106] * 4, 7: [1, 2, 3, 4], 8: [3108] * 4} and len(opened(some)) <= 3
    assert m.blocks().count() == 10_000 and m.blocks(1, "tile_row = 31 AND tile_col = 7").first()["labels"] == [3107] * 4


def test_a_version_is_whole_or_not_there(spark, tmp_path, monkeypatch):
    m = MosaicTable(spark, f"file:{tmp_path}/m", 4, 4, 2)
    m.write_tiles(spark.createDataFrame([(0, 0, [1, 1, 1, 1])], BLOCK))
    before = files(tmp_path)
    with pytest.raises(ValueError, match="twice"):
        m.write_tiles(spark.createDataFrame([(0, 1, [1, 1, 1, 1]), (0, 1, [2, 2, 2, 2])], BLOCK))
    # another writer has taken the number meanwhile
    monkeypatch.setattr(MosaicTable, "versions", lambda self: [])
    with pytest.raises(Exception, match="[Ee]xist"):
        m.write_tiles(spark.createDataFrame([(0, 0, [9, 9, 9, 9])], BLOCK))
    monkeypatch.undo()
    assert files(tmp_path) == before and m.versions() == [1] and labels_of(m.read()) == {(x, y): 1 for x in (0, 1) for y in (0, 1)}
