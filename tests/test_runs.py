"""Masks as runs against masks as pixels."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilegraph.operators import masks, runs

BITS = "tile_id long, mask_id long, bits array<tinyint>"


def set_of(r):
    return {p for s, e in zip(r[0::2], r[1::2], strict=True) for p in range(s, e)}


def lists(rows):
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    return np.array([b for r in rows for b in r], dtype=np.int64), offsets


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=12), max_size=8))
def test_runs_are_the_bits(rows):
    got, offsets = runs.encoded(*lists(rows))
    for k, r in enumerate(rows):
        own = got[offsets[k] : offsets[k + 1]].tolist()
        assert set_of(own) == {i for i, b in enumerate(r) if b} and all(a < b for a, b in zip(own, own[1:], strict=False))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), max_size=12), st.lists(st.lists(st.integers(0, 1), max_size=50), min_size=1, max_size=6))
def test_merging_and_sharing(pieces, rows):
    given_ = np.array([x for s, n in pieces for x in (s, s + n)], dtype=np.int64)
    whole = runs.merged(given_)
    want = {p for s, n in pieces for p in range(s, s + n)}
    assert set_of(whole.tolist()) == want and (np.diff(whole) > 0).all()
    values, offsets = runs.encoded(*lists(rows))
    cover = runs.Cover(values, offsets)
    n = cover.shared(whole, np.arange(len(rows)))
    assert n.tolist() == [len(want & {i for i, b in enumerate(r) if b}) for r in rows]


def test_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(1, k, (rng.random(rng.integers(0, 90)) < 0.4).astype(int).tolist()) for k in range(40)] + [(1, 98, []), (1, 99, None), (2, 100, [0] * 9), (2, 101, [1] * 31)]
    df = masks.with_runs(spark.createDataFrame(rows, BITS).repartition(3))
    got = df.select("mask_id", "runs", runs.area(F.col("runs")).alias("n"), runs.bbox(F.col("runs"), 10).alias("b")).collect()
    bits = {r[1]: r[2] or [] for r in rows}
    for r in got:
        on = [i for i, b in enumerate(bits[r["mask_id"]]) if b]
        box = (min(i % 10 for i in on), min(on) // 10, max(i % 10 for i in on), max(on) // 10) if on else (0, 0, 0, 0)
        whole = [r["b"]["x_min"], r["b"]["y_min"], r["b"]["x_max"], r["b"]["y_max"]]
        assert r["n"] == len(on) and set_of(r["runs"]) == set(on) and tuple(whole) == box, r
    back = runs.pixels(df, 10, "mask_id").collect()
    assert sorted((r["mask_id"], r["y"] * 10 + r["x"]) for r in back) == sorted((k, i) for k, b in bits.items() for i, v in enumerate(b) if v)


@pytest.mark.parametrize("block", [None, 4])
def test_pairs_union_and_overlap(spark, block):
    rng = np.random.default_rng(5)
    rows = [(k % 3, k, (rng.random(120) < rng.random()).astype(int).tolist()) for k in range(33)] + [(0, 50, []), (0, 51, [0] * 4), (7, 52, [])]
    rows += [(1, 60, rows[1][2]), (1, 61, rows[1][2])]
    df = masks.with_runs(spark.createDataFrame(rows, BITS))
    sets = {k: {i for i, b in enumerate(bits) if b} for _, k, bits in rows}
    tile = {k: t for t, k, _ in rows}
    want = {(tile[a], a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and tile[a] == tile[b] and sets[a] | sets[b]}
    found = runs.iou_pairs(df, 0.3, block=block).collect()
    assert {(r["tile_id"], r["mask_a"], r["mask_b"]): r["iou"] for r in found} == pytest.approx({k: v for k, v in want.items() if v >= 0.3}) and len(found) == sum(v >= 0.3 for v in want.values())
    both = {r["tile_id"]: set_of(r["runs"]) for r in runs.union(df, "tile_id").collect()}
    assert both == {t: set().union(*(sets[k] for k in sets if tile[k] == t)) for t in set(tile.values())}
    done = runs.union(df.where("mask_id < 9"), "tile_id")
    over = {r["mask_id"]: r["shared"] for r in runs.overlap(df, done).collect()}
    covered = {t: set().union(*(sets[k] for k in sets if tile[k] == t and k < 9)) for t in set(tile.values())}
    assert over == {k: len(s & covered[tile[k]]) for k, s in sets.items() if s & covered[tile[k]]}
    assert runs.iou_pairs(df.limit(0), 0.3).count() == 0 and runs.union(df.limit(0), "tile_id").count() == 0
    with pytest.raises(ValueError):
        runs.iou_pairs(df, 0.0)


def test_many_large_masks(spark):
    """A thousand masks of 1,100 x 1,100 pixels, as runs of a disc's rows."""
    side, n = 1100, 1000
    rng = np.random.default_rng(6)
    centre, radius = rng.integers(100, 1000, (n, 2)), rng.integers(20, 90, n)
    centre[1::2], radius[1::2] = centre[0::2] + 1, radius[0::2]  # pairs that overlap nearly wholly
    rows = []
    for k in range(n):
        y = np.arange(max(centre[k, 0] - radius[k], 0), min(centre[k, 0] + radius[k] + 1, side))
        half = np.sqrt(radius[k] ** 2 - (y - centre[k, 0]) ** 2).astype(int)
        s, e = np.maximum(centre[k, 1] - half, 0) + y * side, np.minimum(centre[k, 1] + half + 1, side) + y * side
        rows.append(np.stack((s, e), axis=1).ravel().tolist())
    table = pa.table({"tile_id": pa.array([0] * n, pa.int64()), "mask_id": pa.array(range(n), pa.int64()), "runs": pa.array(rows, pa.list_(pa.int64()))})
    df = spark.createDataFrame(table)
    pairs = {(r["mask_a"], r["mask_b"]) for r in runs.iou_pairs(df, 0.9).collect()}
    assert {(k, k + 1) for k in range(0, n, 2) if radius[k] > 40} <= pairs
    sets = [set_of(r) for r in rows[:60]]
    for a in range(60):
        for b in range(a + 1, 60):
            assert ((a, b) in pairs) == (len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b]))
