"""Simplification point by point: rings stay apart, in shape, and don't keep their full detail."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilegraph.operators import vector
from tilegraph.operators.blocks import Grid


def rings_of_raster(values):
    """The rings of each label's regions, as the kernel traces them."""
    import pyarrow as pa

    h, w = values.shape
    y, x = np.indices((h, w)).reshape(2, -1)
    grid = Grid(pa.table({"x": x, "y": y, "v": values.ravel(), "own": np.ones(h * w, dtype=bool)}))
    edge, follow, place = vector.edges_of(grid, 1000)
    comp = vector.label_block(grid.values).ravel()[place]
    rings, owner = vector.rings_of(edge, follow, comp, 1000)
    by = {}
    for r, o in zip(rings, owner.tolist(), strict=True):
        by.setdefault(o, []).append(r.astype(float))
    return [sorted(rs, key=lambda r: -abs(vector.signed_area(r))) for rs in by.values()]


def deviation(ring, out):
    """The largest distance of a ring's points to the simplified ring."""
    a, way = out[:-1], np.diff(out, axis=0)
    t = np.clip(((ring[:, None] - a) * way).sum(axis=2) / np.maximum((way**2).sum(axis=1), 1e-12), 0, 1)
    return np.sqrt((((a + t[..., None] * way) - ring[:, None]) ** 2).sum(axis=2)).min(axis=1).max()


def check(rings, tolerance, out):
    assert len(out) == len(rings) and not vector.conflicts(out)
    for before, after in zip(rings, out, strict=True):
        assert len(after) >= 4 and (after[0] == after[-1]).all() and abs(vector.signed_area(after)) > 0
        assert (vector.signed_area(before) > 0) == (vector.signed_area(after) > 0)
        assert deviation(before, after) <= tolerance + 1e-9
        assert {tuple(p) for p in after.tolist()} <= {tuple(p) for p in before.tolist()}


@settings(max_examples=40, deadline=None)
@given(st.integers(4, 22), st.integers(4, 22), st.randoms(use_true_random=False), st.sampled_from([0.6, 1.0, 2.0, 5.0]))
def test_rings_of_any_raster(h, w, rnd, tolerance):
    values = np.array([[rnd.choice([1, 1, 1, 2, 0]) for _ in range(w)] for _ in range(h)])
    for rings in rings_of_raster(values):
        check(rings, tolerance, vector.Thinning(rings).run(tolerance))
        check(rings, tolerance, vector.simplified(rings, tolerance)) if len(rings) > 1 else None


def comb(teeth, gap, bumps, rng):
    """A shape with long thin teeth whose edges are ragged: simplified side by side, they would cross."""
    w, h = teeth * 2 * gap + gap, bumps
    values = np.zeros((h + 4, w + 2), dtype=int)
    values[1:3, 1:-1] = 1
    for t in range(teeth):
        x = 1 + t * 2 * gap
        for y in range(3, h + 3):
            shift = rng.choice([0, 0, 1])
            values[y, x + shift : x + gap + shift] = 1
    return values


@pytest.mark.parametrize("tolerance", [1.0, 1.5, 4.0])
def test_no_ring_keeps_its_full_detail(tolerance):
    rng = random.Random(5)
    for gap in (2, 3):
        for rings in rings_of_raster(comb(6, gap, 60, rng)):
            out = vector.simplified(rings, tolerance)
            check(rings, tolerance, out)
            for before, after in zip(rings, out, strict=True):
                if len(before) > 40:
                    assert len(after) < 0.7 * len(before)


def test_spirals_and_holes():
    n = 61
    values = np.ones((n, n), dtype=int)
    x, y, dx, dy, run = n // 2, n // 2, 1, 0, 1
    while 2 < x < n - 3 and 2 < y < n - 3:  # a spiral of background, one pixel wide, and lone pixels between its arms
        for _ in range(2):
            for _ in range(run):
                values[y, x] = 0
                x, y = x + dx, y + dy
                if not (2 < x < n - 3 and 2 < y < n - 3):
                    break
            dx, dy = -dy, dx
        run += 3
    rng = random.Random(2)
    for _ in range(60):
        a, b = rng.randrange(2, n - 2), rng.randrange(2, n - 2)
        if values[a - 1 : a + 2, b - 1 : b + 2].all():
            values[a, b] = 2
    for rings in rings_of_raster(values):
        out = vector.simplified(rings, 3.0)
        check(rings, 3.0, out)


def test_long_rings_are_done_in_time():
    import time

    rng = np.random.default_rng(1)
    t = np.linspace(0, 2 * np.pi, 40_000, endpoint=False)
    r = 1000 + rng.random(len(t)) * 3
    ring = np.column_stack((r * np.cos(t), r * np.sin(t)))
    ring = np.vstack((ring, ring[:1]))
    began = time.time()
    out = vector.Thinning([ring]).run(4.0)
    assert time.time() - began < 60 and len(out[0]) < 2000 and deviation(ring[::50], out[0]) <= 4.0 and not vector.conflicts(out)
