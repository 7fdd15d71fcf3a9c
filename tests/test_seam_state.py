"""Seam contacts of a stream of tiles, kept by state, against counting all pixels at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilegraph.operators import seams
from tilegraph.streaming import seam_state
from tilegraph.streaming.seam_state import ChangeStore, Stretch, contact_changes, counted, seam_rows

SCHEMA = "x int, y int, label bigint, sent bigint"


class Held:
    """A value state in memory, which counts its uses."""

    def __init__(self):
        self.value, self.reads = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        self.reads += 1
        return self.value

    def update(self, v):
        self.value = v


def rows(rng, tiles, tile, labels=5, sent=0):
    return [(tx * tile + x, ty * tile + y, int(rng.integers(0, labels)), sent) for tx, ty in tiles for x in range(tile) for y in range(tile)]


def latest(given):
    out = {}
    for x, y, label, sent in given:
        if (x, y) not in out or out[x, y][0] <= sent:
            out[x, y] = (sent, label)
    return [(x, y, v[1]) for (x, y), v in out.items()]


def contacts_of(df):
    return {(r["axis"], r["line"], r["a"], r["b"], r["cnt"]) for r in df.collect()}


def test_a_stream_of_tiles(spark, tmp_path, monkeypatch):
    """After each batch the changes add up to the contacts of what is there, also when tiles are sent again."""
    monkeypatch.setattr(seam_state, "SPAN", 1024)
    rng, tile, given = np.random.default_rng(1), 4, []
    store = ChangeStore(spark, str(tmp_path / "store"))
    assert store.contacts().count() == 0
    batches = [[(0, 0), (1, 1)], [(1, 0), (0, 1), (2, 0)], [(1, 0)], [(2, 1), (0, 0)]]
    written = []
    for k, tiles in enumerate(batches):
        new = rows(rng, tiles, tile, sent=k)
        given += new
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = store.follow(contact_changes(stream, tile, "sent"), str(tmp_path / "checkpoint"))
        q.processAllAvailable()
        progress = q.lastProgress
        q.stop()
        assert progress["numInputRows"] == 2 * len(new)  # a batch reads its own rows: once for each axis
        now = spark.createDataFrame(latest(given), "x int, y int, label bigint")
        assert contacts_of(store.contacts()) == contacts_of(seams.contacts(now, tile))
        written.append(store.spark.read.parquet(str(tmp_path / "store" / "changes")).count())
    assert written == sorted(written)


def test_a_stretch(monkeypatch):
    """Changes of one stretch: repeated pixels, replaced ones, background, and a state that has been dropped."""
    import pandas as pd

    s = Stretch()
    s.labels = Held()
    frame = lambda *r: iter([pd.DataFrame(r, columns=["at", "side", "label", "seq"])])
    out = lambda *r: [tuple(x)[2:] for f in s.handleInputRows(("v", 4, 0), frame(*r), None) for x in f.itertuples(index=False)]
    assert out((0, 0, 1, 0), (1, 0, 1, 0)) == []  # one side only
    assert out((0, 1, 2, 0), (1, 1, 2, 0), (2, 1, 9, 0)) == [(1, 2, 2)]
    assert out((0, 1, 2, 0)) == []  # the same again
    assert out((0, 1, 3, 1), (0, 1, 2, 0)) == [(1, 2, -1), (1, 3, 1)]  # the later of two
    assert out((1, 0, 0, 0)) == [(1, 2, -1)] and out((0, 0, 3, 0)) == [(1, 3, -1)]
    s.labels = Held()  # dropped: what comes is counted, what was counted stays
    assert out((5, 0, 7, 0), (5, 1, 8, 0)) == [(7, 8, 1)] and s.labels.reads == 0
    assert counted(np.zeros((2, 8), dtype=np.int64)) == {}


def test_rows_beside_seams(spark):
    px = spark.createDataFrame([(x, y, None if x == 3 else 1) for x in range(9) for y in (0, 2000)], "x int, y int, label bigint")
    got = {(r["axis"], r["line"], r["span"], r["at"], r["side"], r["label"]) for r in seam_rows(px, 4).where("axis = 'v'").collect()}
    assert got == {("v", line, y // 1024, y % 1024, side, 0 if (line, side) == (4, 0) else 1) for line in (4, 8) for side in (0, 1) for y in (0, 2000)}
    assert seam_rows(px, 4).where("axis = 'h'").agg(F.max("line")).first()[0] == 2000
    with pytest.raises(ValueError):
        seam_rows(px, 1)
