"""A model's life on executors, proved by a stand-in that records what happens to it."""

import collections
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilegraph.config import Segmentation, Threshold
from tilegraph.operators import models, multipass
from tilegraph.operators.multipass import FloodProposer


class Recorded:
    """A stand-in that writes down, by process, when it is opened, used and closed; it fails where it is told to."""

    def __init__(self, folder, weights, fail=False):
        self.folder, self.weights, self.fail, self.inner = folder, weights, fail, FloodProposer(min_area=10)

    def note(self, what):
        with open(f"{self.folder}/{os.getpid()}", "a") as f:
            f.write(what + "\n")

    def open(self):
        self.note("open " + open(self.weights).read() if self.weights else "open")

    def close(self):
        self.note("close")

    def propose(self, image, points, iou, stability):
        flag = f"{self.folder}/failed"
        if self.fail and not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("out of memory")
        return self.inner.propose(image, points, iou, stability)


def notes(folder):
    return {f: open(f"{folder}/{f}").read().split("\n")[:-1] for f in os.listdir(folder) if f.isdigit()}


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(12):
        image = np.kron(rng.integers(1, 5, (4, 4, 3)), np.ones((8, 8, 1), dtype=int)).astype(np.uint8) * 50
        rows.append((k // 4, k % 4, 0, 0, 32, 32, bytearray(image.tobytes())))
    return spark.createDataFrame(rows, "tile_row int, tile_col int, crop_x int, crop_y int, width int, height int, rgb binary").repartition(6)


def run(blocks, proposer):
    return multipass.segment_tiles(blocks, proposer, Segmentation(points_per_side=6, max_passes=2), Threshold(), 32, 10).select("tile_row", "tile_col", F.xxhash64("labels").alias("h")).collect()


def test_one_load_a_worker(spark, tmp_path, blocks):
    (tmp_path / "notes").mkdir()
    (tmp_path / "weights.bin").write_text("seven")
    name, folder = models.ship(spark, str(tmp_path / "weights.bin")), str(tmp_path / "notes")
    proposer = models.Resident(lambda w: Recorded(folder, w), f"model {tmp_path}", name)
    first, again = run(blocks, proposer), run(blocks, proposer)
    assert len(first) == 12 and sorted(first) == sorted(again) == sorted(run(blocks, FloodProposer(min_area=10)))
    told = notes(folder)
    assert all(lines == ["open seven"] for lines in told.values()) and 1 <= len(told) <= 8  # tasks were more


def test_resets_after_tiles(spark, tmp_path, blocks):
    folder = str(tmp_path)
    run(blocks.coalesce(1), models.Resident(lambda w: Recorded(folder, w), f"model {tmp_path}", reset_tiles=5))
    (lines,) = notes(folder).values()
    assert collections.Counter(lines) == {"open": 3, "close": 2} and lines[:3] == ["open", "close", "open"]
    with pytest.raises(ValueError):
        models.Resident(Recorded, "x", reset_tiles=-1)


def test_a_model_that_fails_is_opened_anew(spark, tmp_path, blocks):
    folder = str(tmp_path)
    got = run(blocks.coalesce(1), models.Resident(lambda w: Recorded(folder, w, fail=True), f"model {tmp_path}"))
    (lines,) = notes(folder).values()
    assert lines == ["open", "close", "open"] and sorted(got) == sorted(run(blocks, FloodProposer(min_area=10)))
