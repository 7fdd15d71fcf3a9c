"""Small rasters worked out by hand."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import as_pixels, as_rows
from tilegraph.config import Segmentation, Threshold
from tilegraph.operators import cleanup, components, grid, multipass, points, seams, vector, zonal
from tilegraph.operators.closure import components as closure

FOUR = [[1, 1, 3, 3], [1, 1, 3, 3], [2, 2, 3, 3], [2, 2, 4, 4]]


def test_small_regions_by_mode(spark):
    rows = [[1, 1, 2], [1, 1, 0], [0, 0, 0]]
    px = as_pixels(spark, rows)
    assert as_rows(cleanup.drop_small(px, 3, "foreground")) == rows
    assert as_rows(cleanup.drop_small(px, 3, "per_label")) == [[1, 1, 0], [1, 1, 0], [0, 0, 0]]


@pytest.mark.parametrize(
    ("strategy", "least", "want", "found", "after"),
    [
        ("best_match", 20, [[1] * 4] * 4, 4, 4),
        ("mutual_best", 20, [[1] * 4, [1] * 4, [1] * 4, [1, 1, 4, 4]], 4, 2),
        ("min_contact", 2, [[1] * 4, [1] * 4, [1] * 4, [1, 1, 4, 4]], 4, 2),
        ("none", 20, FOUR, 4, None),
    ],
)
def test_seams(spark, strategy, least, want, found, after):
    px = as_pixels(spark, FOUR)
    assert as_rows(seams.merge_seams(px, 2, strategy, least)) == want
    stats = seams.merge_stats(px, 2, strategy, least).first()
    assert (stats["pairs_found"], stats["pairs_after_filter"]) == (found, after)
    assert stats["segments_reduced"] == 4 - len({v for row in want for v in row})


def test_transposing_swaps_seam_axes(spark):
    flipped = [list(r) for r in zip(*FOUR, strict=True)]
    key = lambda df, swap: {(("h" if r["axis"] == "v" else "v") if swap else r["axis"], r["line"], r["a"], r["b"], r["cnt"]) for r in df.collect()}
    assert key(seams.contacts(as_pixels(spark, FOUR), 2), False) == key(seams.contacts(as_pixels(spark, flipped), 2), True)


def test_enclosed(spark):
    rows = [[1] * 5 for _ in range(5)]
    rows[2][2] = 2
    px = as_pixels(spark, rows)
    assert as_rows(cleanup.enclosed_merge(px, 10, "foreground")) == rows
    assert as_rows(cleanup.enclosed_merge(px, 10, "per_label")) == [[1] * 5] * 5
    assert as_rows(cleanup.enclosed_merge(px, 500, "per_label")) == [[1] * 5] * 5  # no swap
    assert as_rows(cleanup.enclosed_merge_and_drop_small(px, 500, 100, "foreground")) == [[0] * 5] * 5


def test_windows(spark):
    rows = {(r["tile_row"], r["tile_col"]): r for r in grid.windows(spark, 1050, 2000, 500, 50).collect()}
    assert len(rows) == 8
    assert (rows[0, 1]["read_x"], rows[0, 1]["crop_x"], rows[0, 1]["write_x"]) == (450, 100, 500)
    with pytest.raises(ValueError):
        grid.tiles(spark, 99, 99, 100)
    cover = grid.windows(spark, 1050, 2000, 500, 50, "cover").collect()
    assert len(cover) == 12 and max(r["read_x"] + r["read_w"] for r in cover) == 1050


def test_decay():
    t = Threshold()
    steps = multipass.decay([50.0] + [50.0] * 40, t, 99.0)
    falls = [s[0] for s in steps]
    assert steps[-1][2] and falls[-1] == 0.6 and len(set(falls)) - 1 == 33
    assert multipass.decay([99.5], t, 99.0) == [(0.93, 0.93, True)]
    assert t.for_pass(0) == (0.93, 0.93) and t.for_pass(100) == (0.6, 0.6)


def test_points(spark):
    pts = spark.createDataFrame([(10, 10), (50, 50), (100, 100)], "x int, y int")
    mask = spark.createDataFrame([(x, y) for x in range(40, 60) for y in range(40, 60)], "x int, y int")
    assert points.outside_mask(pts, mask, 200, 200).count() == 2
    full = points.uniform_grid(spark, 1000, 1000, 64).orderBy("point_id").collect()
    assert len(full) == 4096 and (full[0]["x"], full[0]["y"]) == (0, 0) and (full[-1]["x"], full[-1]["y"]) == (999, 999)
    assert points.uniform_grid(spark, 10, 10, 1).collect()[0]["x"] == 0
    few = spark.createDataFrame([(1, 2), (3, 4)], "x int, y int")
    assert points.kmeans_points(few, 5, 0).count() == 2
    assert points.kmeans_points(few.where("x < 0"), 5, 0).count() == 0


@pytest.mark.parametrize("width", [70, 100, 1100, 1299])
def test_grid_agrees_with_linspace(spark, width):
    want = np.linspace(0, width - 1, 64).astype(int).tolist()
    got = points.uniform_grid(spark, width, width, 64).where("y = 0").orderBy("point_id").collect()
    assert [r["x"] for r in got] == want
    assert multipass.uniform_points(width, width, 64)[:64, 0].tolist() == want


def test_area_statistics_of_nothing(spark):
    row = zonal.area_statistics(as_pixels(spark, [[0, 0]])).first()
    assert [row[c] for c in row.asDict()] == [0, 0, 0, 0.0, 0.0, 0]


def _brute_components(rows):
    h, w = len(rows), len(rows[0])
    comp = {}
    for y in range(h):
        for x in range(w):
            if rows[y][x] and (x, y) not in comp:
                todo = [(x, y)]
                comp[x, y] = y * w + x
                while todo:
                    a, b = todo.pop()
                    for n in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= n[0] < w and 0 <= n[1] < h and rows[n[1]][n[0]] == rows[y][x] and n not in comp:
                            comp[n] = y * w + x
                            todo.append(n)
    return comp


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.randoms(use_true_random=False))
def test_block_components(h, w, rnd):
    rows = [[rnd.choice([0, 1, 1, 2]) for _ in range(w)] for _ in range(h)]
    got = components.label_block(np.asarray(rows))
    want = _brute_components(rows)
    assert all(got[y, x] == want.get((x, y), -1) for y in range(h) for x in range(w))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.randoms(use_true_random=False))
def test_traced_rings_measure_their_pixels(h, w, rnd):
    rows = [[rnd.choice([0, 1, 1]) for _ in range(w)] for _ in range(h)]
    comp = _brute_components(rows)
    for c in set(comp.values()):
        mine = [(x, y) for (x, y), k in comp.items() if k == c]
        x, y = (np.asarray(v) for v in zip(*mine, strict=True))
        rings = vector.trace(x, y)
        area = abs(vector.signed_area(rings[0])) - sum(abs(vector.signed_area(r)) for r in rings[1:])
        assert area == len(mine)
        bare = sum((a + dx, b + dy) not in set(mine) for a, b in mine for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        assert sum(map(vector.ring_length, rings)) == bare
        assert all((r[0] == r[-1]).all() for r in rings)


def test_components_across_blocks(spark):
    rnd = np.random.default_rng(3)
    rows = (rnd.random((23, 31)) < 0.6).astype(int).tolist()
    want = _brute_components(rows)
    got = {(r["x"], r["y"]): r["comp"] for r in components.connected(as_pixels(spark, rows, "fg"), "fg", 31, 5).collect()}
    assert got == want


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_closure(spark, one_task):
    chain = [(i, i + 1) for i in range(60)] + [(100, 90), (95, 100), (7, 7)]
    df = spark.createDataFrame([*chain, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in closure(df, one_task=one_task).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 90: 90, 95: 90, 100: 90}
    assert closure(df.where("a < -5"), one_task=one_task).count() == 0


def test_greedy_acceptance():
    done = multipass.Accepted(np.zeros((4, 6), dtype=np.int64), min_area=2)
    one = np.zeros((4, 6), dtype=bool)
    one[:2, :3] = True
    one[3, 5] = True  # a second component, too small
    assert done.offer(one) == 1 and done.counts == {"overlap": 0, "small": 1}
    half = np.zeros((4, 6), dtype=bool)
    half[:2, 2:4] = True  # half covered: not below half
    assert done.offer(half) == 0 and done.counts["overlap"] == 1
    less = np.zeros((4, 6), dtype=bool)
    less[:2, 2:5] = True
    assert done.offer(less) == 1
    assert done.labels[0].tolist() == [1, 1, 1, 2, 2, 0]
    assert done.offer(np.zeros((4, 6), dtype=bool)) == 0


def test_multipass_runs_to_its_target():
    rng = np.random.default_rng(1)
    image = np.kron(rng.integers(1, 255, (4, 4, 3)), np.ones((16, 16, 1))).astype(np.uint8)
    labels, stats = multipass.run_tile(image, multipass.FloodProposer(min_area=10), Segmentation(points_per_side=16), Threshold(), 10)
    assert stats["coverage_per_pass"][-1] >= 99 and stats["final_iou"] <= 0.93
    assert stats["coverage_per_pass"] == sorted(stats["coverage_per_pass"])
    assert len(np.unique(labels[labels > 0])) == labels.max()
    once, _ = multipass.run_tile(image, multipass.FloodProposer(min_area=10), Segmentation(points_per_side=16, max_passes=1), Threshold(), 10)
    assert once.any()


def test_merging_keeps_support_and_is_idempotent(spark):
    px = as_pixels(spark, FOUR)
    merged = seams.merge_seams(px, 2)
    assert merged.where("label > 0").count() == px.where("label > 0").count()
    table = seams.relabel_table(seams.chosen(px, 2))
    assert as_rows(seams.apply_relabel(merged, table)) == as_rows(merged)


def test_pixel_functions(spark):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from tilegraph.functions import raster

    one = spark.createDataFrame([([7], [1, 2, 3, 4], [9, 8], [0, 1])], "a array<int>, b array<int>, v array<int>, m array<int>")
    row = one.select(raster.to_rgb(F.col("a")).alias("a"), raster.to_rgb(F.col("b")).alias("b"), raster.black_mask_array(F.col("v"), F.col("m")).alias("v")).first()
    assert (row["a"], row["b"], row["v"]) == ([7, 7, 7], [1, 2, 3], [9, 0])
    with pytest.raises(PySparkException):
        one.select(raster.to_rgb(F.col("v"))).collect()
    with pytest.raises(ValueError):
        raster.to_uint8(F.col("v"), "int64")
    with pytest.raises(ValueError):
        raster.to_uint8(F.col("v"), "uint16")
    mixed = spark.range(3).select(raster.colour(F.col("id")).alias("c"), raster.blended(F.array(F.lit(100), F.lit(50), F.lit(0)), F.col("id")).alias("b")).collect()
    assert mixed[0]["c"] == [0, 0, 0] and mixed[0]["b"] == [50, 25, 0]
    assert mixed[1]["c"] != mixed[2]["c"] and all(0 <= v <= 255 for r in mixed for v in r["c"])


def test_thresholds_of_recorded_series(spark):
    series = [31.8, 35.8, 36.9, 37.0, 37.05, 39.8, 99.2]
    steps = multipass.decay(series, Threshold(), 99.0)
    assert [round(s[0], 2) for s in steps] == [0.93, 0.93, 0.93, 0.93, 0.92, 0.92, 0.92] and steps[-1][2]
    assert multipass.decay([50.0, 50.0], Threshold(), 99.0, adaptive=False) == [(0.93, 0.93, False)] * 2
    assert multipass.decay([50.0, 60.0], Threshold(), 99.0, added=[1, 0])[1][0] == pytest.approx(0.92)
    rows = spark.createDataFrame([(0.93,), (0.925,), (0.6,), (0.6,)], "final_iou double")
    assert zonal.threshold_map(rows).first()[0][0.6] == 2


def test_growth_needs_samples(spark):
    rows = spark.createDataFrame([(t, 100.0 + (5000.0 if t > 15 else 0.0)) for t in range(20)], "t int, used double")
    row = zonal.growth_check(rows).first()
    assert (row["growth"], row["warn"]) == (5000.0, True)
    assert zonal.growth_check(rows.where("t < 10")).first()["growth"] is None


def test_clustered_points_stay_valid():
    rng = np.random.default_rng(2)
    valid = rng.random((40, 50)) < 0.3
    pts = multipass.spread_points(valid, 16, 42)
    assert len(pts) == 16 and valid[pts[:, 1], pts[:, 0]].all()
    assert (pts == multipass.spread_points(valid, 16, 42)).all()
    assert len(multipass.spread_points(valid & False, 16, 42)) == 0
    assert multipass.erode(np.ones((5, 5), dtype=bool), 2).sum() == 1


def _lattice_rings(rows):
    """Rings of each component worked out pixel by pixel: holes by flooding the rest with corners, corners where an outline meets itself."""
    comp = _brute_components(rows)
    h, w = len(rows), len(rows[0])
    out = {}
    for c in set(comp.values()):
        own = {p for p, k in comp.items() if k == c}
        free = {(x, y) for x in range(-1, w + 1) for y in range(-1, h + 1)} - own
        pieces = 0
        while free:
            pieces += 1
            todo = [free.pop()]
            while todo:
                x, y = todo.pop()
                for n in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if n in free:
                        free.remove(n)
                        todo.append(n)
        pinches = sum((((x, y) in own) == ((x + 1, y + 1) in own)) and (((x + 1, y) in own) == ((x, y + 1) in own)) and (((x, y) in own) != ((x + 1, y) in own)) for x in range(-1, w) for y in range(-1, h))
        out[c] = (len(own), pieces + pinches)
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 11), st.integers(1, 11), st.randoms(use_true_random=False), st.sampled_from([3, 64]))
def test_polygons_of_any_raster(spark, h, w, rnd, block):
    rows = [[rnd.choice([0, 1, 1, 2]) for _ in range(w)] for _ in range(h)]
    if not any(map(any, rows)):
        return
    got = {r["part_id"]: r for r in vector.polygons(as_pixels(spark, rows), tolerance=0.0, width=w, block=block).collect()}
    want = _lattice_rings(rows)
    assert {k: (r["area_m2"], r["n_rings"]) for k, r in got.items()} == want
    for r in got.values():
        rings = vector.read_wkb(r["wkb"])
        assert not vector.conflicts(rings)
        assert all(len({tuple(p) for p in ring.tolist()}) == len(ring) - 1 for ring in rings)  # no ring meets itself


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 16), st.integers(3, 16), st.randoms(use_true_random=False), st.sampled_from([0.8, 1.5, 3.0]))
def test_simplified_rings_stay_apart(h, w, rnd, tolerance):
    grid = np.array([[rnd.random() < 0.75 for _ in range(w)] for _ in range(h)])
    comp = components.label_block(grid.astype(int))
    if comp.max() < 0:
        return
    root = np.bincount(comp[comp >= 0]).argmax()
    y, x = np.nonzero(comp == root)
    rings = vector.trace(x, y)
    out = vector.simplified(rings, tolerance)
    assert len(out) == len(rings) and not vector.conflicts(out)
    assert all(len(r) >= 4 and (r[0] == r[-1]).all() for r in out)


@pytest.mark.parametrize(("rounds", "block"), [(1, 4), (2, 4), (3, 64), (5, 4)])
def test_erosion_across_blocks(spark, rounds, block):
    valid = np.random.default_rng(rounds).random((20, 23)) < 0.93
    y, x = np.nonzero(valid)
    px = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y, strict=True)], "x int, y int")
    got = {(r["x"], r["y"]) for r in points.eroded(px, rounds, block).collect()}
    y, x = np.nonzero(multipass.erode(valid, rounds))
    assert got == set(zip(x.tolist(), y.tolist(), strict=True))


@pytest.mark.parametrize(("h", "w"), [(9, 9), (1, 65), (150, 1), (1100, 1100)])
def test_masks_of_any_size(spark, h, w):
    from tilegraph.operators import masks

    rng = np.random.default_rng(h * w)
    bits = rng.random((3 if h > 1000 else 6, h * w)) < 0.5
    bits[1] = bits[0]
    bits[1][: h * w // 10] = 0
    df = spark.createDataFrame([(0, k, row.astype(int).tolist()) for k, row in enumerate(bits)], "tile_id long, mask_id long, bits array<tinyint>")
    got = {(r["mask_a"], r["mask_b"]): r["iou"] for r in masks.iou_pairs(df, 0.01).collect()}
    want = {(a, b): (bits[a] & bits[b]).sum() / (bits[a] | bits[b]).sum() for a in range(len(bits)) for b in range(a + 1, len(bits))}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.01})


def test_relabelling_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(seams, "BROADCAST_ROWS", 0)
    rows = [[0, 1, 2, 2], [3, 3, 2, 2]]
    table = spark.createDataFrame([(2, 1), (3, 1)], "label long, root long")
    assert as_rows(seams.apply_relabel(as_pixels(spark, rows), table)) == [[0, 1, 1, 1], [1, 1, 1, 1]]


def test_residual_points_lie_on_free_pixels(spark):
    rng = np.random.default_rng(3)
    rows = (rng.random((24, 30)) < 0.4).astype(int)
    px = as_pixels(spark, rows.tolist())
    got = [(r["x"], r["y"]) for r in points.residual_kmeans(px, 9, 0).collect()]
    assert 0 < len(got) <= 9 and all(rows[y][x] == 0 for x, y in got)
    assert sorted(got) == sorted((r["x"], r["y"]) for r in points.residual_kmeans(px, 9, 0).collect())
    assert points.residual_kmeans(as_pixels(spark, [[1, 1], [1, 1]]), 9, 0).count() == 0
    spread = np.asarray(got)
    assert np.ptp(spread[:, 0]) > 10 and np.ptp(spread[:, 1]) > 8


@pytest.mark.parametrize("hot", [1000, 3, 0])
def test_join_by_key(spark, monkeypatch, hot):
    from pyspark.sql import functions as F

    from tilegraph.functions import storage

    monkeypatch.setattr(storage, "HOT_ROWS", hot)
    big = spark.createDataFrame([(k % 7 if k % 5 else 0, k) for k in range(60)] + [(None, -1)], "key int, v int")
    small = big.where("key is not null and key <> 6").groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    rows = lambda df: sorted(tuple(r) for r in df.select("key", "v", "n", "top").collect())
    assert rows(storage.join_by_key(big, small, "key", "n")) == rows(big.join(small, "key"))
    assert (storage.hot_limit(small, "n") is None) == (hot == 1000)
    none = small.where("n < 0")
    assert storage.join_by_key(big, none, "key", "n").count() == 0 and storage.hot_limit(none, "n") is None


@pytest.mark.parametrize("edge", grid.EDGES)
def test_windows_of_many_images(spark, edge):
    """A catalogue's windows are those of each image by itself; images below a tile have none."""
    sizes = [(1, 1050, 2000), (2, 500, 500), (3, 499, 700), (4, 1, 1), (5, 1600, 501)]
    images = spark.createDataFrame(sizes, "image_id long, width int, height int")
    names = ["tile_row", "tile_col", "read_x", "read_y", "crop_x", "crop_y", "read_w", "read_h", "write_x", "write_y"]
    got = grid.windows_of(images, 500, 50, edge).select("image_id", *names).collect()
    for k, w, h in sizes:
        whole = edge == "cover" or (w >= 500 and h >= 500)
        want = {tuple(r) for r in grid.windows(spark, w, h, 500, 50, edge).select(names).collect()} if whole else set()
        assert {tuple(r)[1:] for r in got if r["image_id"] == k} == want
    assert grid.windows_of(images.limit(0), 500, 50, edge).count() == 0


def test_grids_over_many_regions(spark):
    boxes = spark.createDataFrame([("a", 0, 0, 999, 499), ("b", 5, 7, 5, 7), ("c", -4, 2, 9, 9)], "name string, x0 int, y0 int, x1 int, y1 int")
    got = points.grids_over(boxes, 5).collect()
    for name, x0, y0, x1, y1 in [tuple(r) for r in boxes.collect()]:
        want = {tuple(r) for r in points.grid_in_region(spark, x0, y0, x1, y1, 5).select("point_id", "x", "y").collect()}
        assert {(r["point_id"], r["x"], r["y"]) for r in got if r["name"] == name} == want
    inside = points.in_regions(points.grids_over(boxes, 5).select("name", "x", "y"), boxes.selectExpr("name", "0 AS x0", "0 AS y0", "6 AS x1", "8 AS y1").where("name <> 'a'"), "name").collect()
    assert {r["name"] for r in inside} == {"b", "c"} and all(0 <= r["x"] <= 6 and r["y"] <= 8 for r in inside)
    one = points.grids_over(boxes, 1).collect()
    assert {(r["name"], r["x"], r["y"]) for r in one} == {("a", 0, 0), ("b", 5, 7), ("c", -4, 2)}
