"""Points by mini-batch k-means in all tiles, against full k-means and against what they have to be."""

import numpy as np
import pytest

from tilegraph.operators import clusters


def full(points, centres, rounds=60):
    """Lloyd's iteration from given centres."""
    for _ in range(rounds):
        at, _ = clusters._closest(points, centres)
        centres = np.array([points[at == k].mean(axis=0) if (at == k).any() else centres[k] for k in range(len(centres))])
    return clusters.inertia(points, centres)


@pytest.mark.parametrize("shape", ["square", "ring", "islands"])
def test_inertia_is_near_that_of_full_clustering(shape):
    y, x = np.indices((300, 300))
    r = np.hypot(y - 150, x - 150)
    valid = {"square": r >= 0, "ring": (r > 90) & (r < 120), "islands": ((y // 30 + x // 30) % 4 == 0)}[shape]
    rng = np.random.default_rng(1)
    points = clusters.sample(valid, 6000, rng).astype(float)
    best = min(full(points, clusters.spread(points, 32, np.random.default_rng(s))) for s in range(3))
    got = clusters.inertia(points, clusters.cluster(points, 32, rng))
    assert got <= 1.05 * best
    one = [clusters.inertia(points, clusters.minibatch(points, 32, np.random.default_rng(s))) for s in range(4)]
    assert clusters.inertia(points, clusters.cluster(points, 32, np.random.default_rng(0), 4)) <= max(one)


def test_samples():
    rng = np.random.default_rng(2)
    valid = np.zeros((200, 200), dtype=bool)
    valid[50:60, 20:120] = True
    got = clusters.sample(valid, 500, rng)
    assert len(got) == 500 and valid[got[:, 0], got[:, 1]].all() and len(np.unique(got, axis=0)) < 500  # with replacement
    columns = np.bincount(clusters.sample(valid, 999, rng)[:, 1] // 20, minlength=6)[1:]
    assert columns.min() > 140  # evenly over the valid pixels
    assert (clusters.sample(valid, 1000, rng) == np.argwhere(valid)).all()
    one = np.zeros((1000, 1000), dtype=bool)
    one[3, 4:8] = True
    assert len(clusters.sample(one, 2, rng)) == 2
    assert len(clusters.sample(np.zeros((5, 5), dtype=bool), 3, rng)) == 0


def test_all_tiles_in_one_job(spark):
    rng = np.random.default_rng(3)
    grid = rng.random((70, 90)) < 0.6
    grid[:40, :40] = False
    grid[5, 5:8] = True
    rows = [(int(x), int(y)) for y, x in np.argwhere(grid)]
    df = spark.createDataFrame(rows, "x int, y int")
    got = clusters.tile_points(df, 40, 6, 0, 300).collect()
    by = {}
    for r in got:
        assert grid[r["y"], r["x"]] and (r["y"] // 40, r["x"] // 40) == (r["tile_row"], r["tile_col"])
        by.setdefault((r["tile_row"], r["tile_col"]), []).append((r["x"], r["y"]))
    assert {k: len(v) for k, v in by.items()} == {(0, 0): 3, (0, 1): 6, (0, 2): 6, (1, 0): 6, (1, 1): 6, (1, 2): 6} and sorted(by[0, 0]) == [(5, 5), (6, 5), (7, 5)]
    again = clusters.tile_points(df.repartition(7).where("y >= 40"), 40, 6, 0, 300).collect()
    assert sorted(again) == sorted(r for r in got if r["tile_row"] == 1)  # whatever else there is, and however it is dealt out
    inner = clusters.tile_points(spark.createDataFrame([(x, y) for x in range(9) for y in range(9)], "x int, y int"), 9, 4, 3, 50).collect()
    assert all(3 <= r["x"] <= 5 and 3 <= r["y"] <= 5 for r in inner) and inner
    assert clusters.tile_points(df.limit(0), 40).count() == 0
    labels = spark.createDataFrame([(0, 0, 0), (1, 0, 5), (2, 0, 0)], "x int, y int, label long")
    assert sorted((r["x"], r["y"]) for r in clusters.residual_points(labels, 4, 8, 0).collect()) == [(0, 0), (2, 0)]
