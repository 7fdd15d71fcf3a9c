"""Polygons made valid: worked cases, and any rings against the even-odd rule at points of the plane."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilegraph.operators import validity, vector
from tilegraph.operators.validity import make_valid, valid_polygons


def ring(*spots):
    return np.array([*spots, spots[0]], dtype=float)


def area(polygons):
    return sum(abs(vector.signed_area(p[0])) - sum(abs(vector.signed_area(h)) for h in p[1:]) for p in polygons)


def odd(rings, spot):
    return sum(vector.contains(np.vstack((r, r[:1])), spot) for r in rings) % 2 == 1


def check(rings, out):
    """Valid by an independent test, and covering what the rings cover."""
    for polygon in out:
        assert not vector.conflicts(polygon)
        assert vector.signed_area(polygon[0]) > 0 and all(vector.signed_area(h) < 0 for h in polygon[1:])
        assert all(len({tuple(s) for s in r.tolist()}) == len(r) - 1 for r in polygon)
    everything = np.vstack(rings)
    low, high = everything.min(axis=0), everything.max(axis=0)
    for spot in low + np.random.default_rng(1).random((60, 2)) * (high - low):
        covering = sum(sum(vector.contains(r, spot) for r in p) % 2 for p in out)
        assert covering == int(odd(rings, spot))  # no two polygons overlap


CASES = {
    "valid": ([ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (1, 2), (2, 2), (2, 1))], 1, 15),
    "bow tie": ([ring((0, 0), (2, 2), (2, 0), (0, 2))], 2, 2),
    "repeated points": ([ring((0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (4, 4), (0, 4))], 1, 16),
    "spike": ([ring((0, 0), (4, 0), (4, 4), (9, 4), (4, 4), (0, 4))], 1, 16),
    "overlapping holes": ([ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((1, 1), (5, 1), (5, 5), (1, 5)), ring((3, 3), (7, 3), (7, 7), (3, 7))], 2, 81 - 2 * 16 + 2 * 4),
    "hole beyond the shell": ([ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((2, 2), (6, 2), (6, 3), (2, 3))], 2, 16),
    "ring that touches itself": ([ring((0, 0), (6, 0), (6, 6), (3, 6), (4, 3), (2, 3), (3, 6), (0, 6))], 1, 33),
    "nested rings": ([ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((1, 1), (8, 1), (8, 8), (1, 8)), ring((2, 2), (7, 2), (7, 7), (2, 7))], 2, 81 - 49 + 25),
    "the same ring twice": ([ring((0, 0), (4, 0), (4, 4))] * 2, 0, 0),
    "a line": ([ring((0, 0), (4, 4), (2, 2))], 0, 0),
    "holes that share an edge": ([ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((1, 1), (3, 1), (3, 3), (1, 3)), ring((3, 1), (5, 1), (5, 3), (3, 3))], 1, 81 - 8),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    rings, n, size = CASES[name]
    out = valid_polygons(rings)
    assert len(out) == n and area(out) == pytest.approx(size)
    check(rings, out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=3, max_size=9), min_size=1, max_size=3))
def test_any_rings(spots):
    rings = [ring(*s) for s in spots]
    check(rings, valid_polygons(rings))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-(10**6), 10**6), st.integers(-(10**4), 10**4)), min_size=4, max_size=12))
def test_any_coordinates(spots):
    """Cut points are rounded: what they bound is still apart."""
    rings = [ring(*((x / 1000, y / 7000) for x, y in spots))]
    out = valid_polygons(rings)
    check(rings, out)
    again = [r for p in out for r in p]
    assert area(valid_polygons(again)) == pytest.approx(area(out))


def test_features(spark):
    rows = [(k, bytearray(vector.wkb_polygon(CASES[name][0])), -1.0, 0) for k, name in enumerate(CASES)] + [(99, None, 1.0, 0)]
    got = make_valid(spark.createDataFrame(rows, "label_id long, wkb binary, area_m2 double, piece_of int").repartition(3)).collect()
    for k, name in enumerate(CASES):
        own = [r for r in got if r["label_id"] == k]
        assert len(own) == CASES[name][1] and sum(r["area_m2"] for r in own) == pytest.approx(CASES[name][2]) and sorted(r["piece"] for r in own) == list(range(len(own)))
    assert not [r for r in got if r["label_id"] == 99]
    assert make_valid(spark.createDataFrame([], "wkb binary")).count() == 0


def test_one_partition_is_dealt_out(spark):
    """A table that comes in one partition is work for many tasks; rows of equal bytes keep their own other columns, null rows vanish."""
    tie = vector.wkb_polygon([np.array([(0, 0), (4, 2), (4, 0), (0, 2), (0, 0)], dtype=float)])
    rows = [(k, bytearray(tie) if k % 5 else None) for k in range(400)]
    valid = make_valid(spark.createDataFrame(rows, "label_id long, wkb binary").coalesce(1))
    assert valid.rdd.getNumPartitions() >= 8
    got = valid.collect()
    assert sorted((r["label_id"], r["piece"]) for r in got) == [(k, piece) for k in range(400) if k % 5 for piece in (0, 1)]
    assert {vector.signed_area(vector.read_wkb(bytes(r["wkb"]))[0]) for r in got} == {2.0}


def test_pairs_of_few_segments_are_those_of_the_sweep(monkeypatch):
    rng = np.random.default_rng(8)
    for n in (2, 7, 48):
        ends = [[tuple(e) for e in s] for s in rng.integers(0, 30, (n, 2, 2)).tolist()]
        listed = [(min(a, b), max(a, b)) for a, b in ends]
        few = {frozenset(pair) for pair in validity._near(listed)}
        monkeypatch.setattr(validity, "FEW", 0)
        assert few == {frozenset(pair) for pair in validity._near(listed)}
        monkeypatch.undo()
