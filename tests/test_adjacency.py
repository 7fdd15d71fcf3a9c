"""The region adjacency graph and merging on it, against brute force on whole arrays."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import as_pixels, as_rows
from tilegraph.operators import adjacency, cleanup

WIDTH = 1000


def brute_regions(values, there):
    """({pixel: comp}, {comp: area}) of 4-connected equal labels."""
    h, w = values.shape
    comp = {}
    for y in range(h):
        for x in range(w):
            if there[y, x] and values[y, x] and (y, x) not in comp:
                todo, root = [(y, x)], y * WIDTH + x
                comp[y, x] = root
                while todo:
                    a, b = todo.pop()
                    for p in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= p[0] < h and 0 <= p[1] < w and there[p] and p not in comp and values[p] == values[y, x]:
                            comp[p] = root
                            todo.append(p)
    return comp, Counter(comp.values())


def brute_contacts(values, there, comp):
    """({(a, b): edges}, open regions)."""
    h, w = values.shape
    found, opened = Counter(), set()
    for (y, x), a in comp.items():
        for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if 0 <= p[0] < h and 0 <= p[1] < w and there[p]:
                b = comp.get(p)
                if b is None:
                    opened.add(a)
                elif b != a:
                    found[a, b] += 1
    return found, opened


def brute_merge(values, there, max_area):
    comp, area = brute_regions(values, there)
    found, opened = brute_contacts(values, there, comp)
    label = {c: values[p] for p, c in comp.items()}
    beside = defaultdict(set)
    for a, b in found:
        beside[a].add(b)
    out = values.copy()
    for p, c in comp.items():
        if area[c] <= max_area and c not in opened and len({label[b] for b in beside[c]}) == 1 and max(area[b] for b in beside[c]) > area[c]:
            out[p] = label[next(iter(beside[c]))]
    return out


def raster(seed, h=23, w=31, labels=4, holes=0.0):
    rng = np.random.default_rng(seed)
    values = np.kron(rng.integers(0 if seed % 2 else 1, labels, (-(-h // 3), -(-w // 3))), np.ones((3, 3), dtype=int))[:h, :w]
    specks = rng.random((h, w)) < 0.15
    values[specks] = rng.integers(1, labels, specks.sum())
    return values, rng.random((h, w)) >= holes


def pixels(spark, values, there):
    return spark.createDataFrame([(int(x), int(y), int(values[y, x])) for y, x in zip(*np.nonzero(there), strict=True)], "x int, y int, label long")


def array_of(df, values):
    out = np.zeros_like(values)
    for r in df.collect():
        out[r["y"], r["x"]] = r["label"]
    return out


@pytest.mark.parametrize(("seed", "block", "holes"), [(1, 5, 0.0), (2, 7, 0.1), (3, 64, 0.05), (4, 1, 0.0)])
def test_graph(spark, seed, block, holes):
    """Regions, contacts and openness don't depend on how the raster is cut into blocks."""
    values, there = raster(seed, holes=holes)
    graph = adjacency.region_graph(pixels(spark, values, there), WIDTH, block)
    comp, area = brute_regions(values, there)
    found, opened = brute_contacts(values, there, comp)
    label = {c: int(values[p]) for p, c in comp.items()}
    assert {(r["comp"], r["label"], r["area"], r["open"]) for r in graph.regions.collect()} == {(c, label[c], n, c in opened) for c, n in area.items()}
    rows = graph.contacts.collect()
    assert {(r["a"], r["b"], r["a_label"], r["b_label"], r["length"]) for r in rows} == {(a, b, label[a], label[b], n) for (a, b), n in found.items()} and len(rows) == len(found)
    beside = defaultdict(set)
    for a, b in found:
        beside[a].add(b)
    for r in adjacency.neighbours(graph).collect():
        near = beside[r["comp"]]
        assert (r["n_neighbours"], r["contact"], r["largest"]) == (len(near), sum(found[r["comp"], b] for b in near), max((area[b] for b in near), default=None))
        assert r["one_label"] == (None if not near else int(len({label[b] for b in near}) == 1))
    assert (array_of(adjacency.paint(graph), values) == np.where(there, values, 0)).all()


@pytest.mark.parametrize(("seed", "block"), [(5, 6), (6, 40), (8, 4)])
def test_merges(spark, seed, block):
    values, there = raster(seed, labels=3)
    px = pixels(spark, values, there)
    once = brute_merge(values, there, 12)
    assert (array_of(cleanup.enclosed_merge(px, 12, "per_label", WIDTH, block), values) == once).all()
    comp, area = brute_regions(values, there)
    small = np.array([[comp.get((y, x)) is not None and area[comp[y, x]] < 6 for x in range(values.shape[1])] for y in range(values.shape[0])])
    both = np.where((once == values) & small, 0, once)
    assert (array_of(cleanup.enclosed_merge_and_drop_small(px, 12, 6, "per_label", WIDTH, block), values) == both).all()


@pytest.mark.parametrize(("seed", "block"), [(11, 9), (12, 5)])
def test_rounds_on_the_graph_equal_rounds_on_pixels(spark, seed, block):
    rng = np.random.default_rng(seed)
    values, there = np.ones((24, 24), dtype=int), np.ones((24, 24), dtype=bool)
    for k in range(1, 11):  # rings within rings, so that a merge makes room for the next
        values[k : 24 - k, k : 24 - k] = k % 3 + 1
    for _ in range(25):
        values[tuple(rng.integers(0, 24, 2))] = rng.integers(1, 6)
    want, seen = values, len(np.unique(values))
    for _ in range(10):
        want = brute_merge(want, there, 30)
        if len(np.unique(want)) == seen:
            break
        seen = len(np.unique(want))
    got = cleanup.enclosed_merge_until_stable(pixels(spark, values, there), 30, 10, "per_label", WIDTH, block)
    assert (array_of(got, values) == want).all()
    graph = adjacency.region_graph(pixels(spark, values, there), WIDTH, block)
    for _ in range(3):
        values = brute_merge(values, there, 30)
        graph = adjacency.contract(graph, adjacency.materialise(adjacency.enclosed(graph, 30)))
        comp, area = brute_regions(values, there)
        found, _ = brute_contacts(values, there, comp)
        assert {(r["comp"], r["area"]) for r in graph.regions.collect()} == set(area.items())
        assert {(r["a"], r["b"]): r["length"] for r in graph.contacts.collect()} == dict(found)
        assert (array_of(adjacency.paint(graph), values) == values).all()


def test_the_largest_neighbour_counts(spark):
    """A region all around which lies one label merges, whichever of its neighbours has the highest number."""
    rows = [[7] * 5, [7, 7, 5, 7, 7], [7, 7, 7, 7, 7]]
    rows[2][1], rows[2][3] = 6, 6  # cuts the pixel below off: a lone 7
    assert as_rows(cleanup.enclosed_merge(as_pixels(spark, rows), 10, "per_label"))[1][2] == 7


def test_odd_rasters(spark):
    none = spark.createDataFrame([], "x int, y int, label long")
    assert cleanup.enclosed_merge(none, 5, "per_label").count() == 0 and cleanup.enclosed_merge_until_stable(none, 5).count() == 0
    alone = spark.createDataFrame([(3, 4, 9), (7, 4, None), (2000, 0, 1)], "x int, y int, label long")
    assert {tuple(r) for r in cleanup.enclosed_merge(alone, 5, "per_label", 4000, 16).collect()} == {(3, 4, 9), (7, 4, 0), (2000, 0, 1)}
    clash = as_pixels(spark, [[1, 2], [1, 1]]).selectExpr("*", "1 AS comp", "2 AS b", "3 AS v", "4 AS by")
    assert as_rows(cleanup.enclosed_merge(clash, 5, "per_label")) == [[1, 1], [1, 1]]
