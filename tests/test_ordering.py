"""Numbers in an order over whole tables, and component numbers that follow from them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_adjacency import brute_regions
from tilegraph.functions.ordering import numbered
from tilegraph.operators import components


@pytest.mark.parametrize(("n", "parts"), [(0, 1), (1, 3), (5000, 7)])
def test_numbers(spark, n, parts):
    rng = np.random.default_rng(n)
    rows = [(int(k), int(v), None if v % 17 == 0 else int(v % 100)) for k, v in enumerate(rng.integers(0, 1000, n))]
    df = spark.createDataFrame(rows, "id long, v long, w long").repartition(parts)
    got = {r["id"]: r["place"] for r in numbered(df, F.desc("w"), F.asc("v"), F.asc("id"), name="place").collect()}
    want = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[1], r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(want)}


def test_ties_share_a_range_of_numbers(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("key"), F.lit("x").alias("__at"))
    df = df.select("key", F.col("__at").alias("number_"))
    rows = numbered(df, "key").collect()
    assert sorted(r["number"] for r in rows) == list(range(1, 301))
    assert all((r["number"] - 1) // 100 == r["key"] for r in rows)


def test_no_window_over_all_rows(spark):
    plan = numbered(spark.range(100), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize(("seed", "block"), [(1, 4), (2, 7), (3, 64)])
def test_component_ordinals(spark, seed, block):
    """1 to n in raster order, on the whole raster and on every tile of it."""
    values = (np.random.default_rng(seed).random((19, 27)) < 0.55).astype(int)
    there = np.ones(values.shape, dtype=bool)
    px = spark.createDataFrame([(x, y, int(values[y, x])) for y in range(19) for x in range(27)], "x int, y int, fg int")
    comp, area = brute_regions(values, there)
    place = {c: k + 1 for k, c in enumerate(sorted(area))}
    assert {((r["y"], r["x"]), r["ordinal"]) for r in components.ordinals(px, "fg", 1000, block).collect()} == {(p, place[c]) for p, c in comp.items()}
    rows = components.tile_ordinals(px, block).collect()
    assert len(rows) == values.sum()
    for ty, tx in {(r["tile_row"], r["tile_col"]) for r in rows}:
        part = values[ty * block : (ty + 1) * block, tx * block : (tx + 1) * block]
        own, sizes = brute_regions(part, np.ones(part.shape, dtype=bool))
        rank = {c: k + 1 for k, c in enumerate(sorted(sizes))}
        got = {(r["y"] - ty * block, r["x"] - tx * block): r["ordinal"] for r in rows if (r["tile_row"], r["tile_col"]) == (ty, tx)}
        assert got == {p: rank[c] for p, c in own.items()}
    assert components.ordinals(px.limit(0), "fg", 1000, block).count() == 0 and components.tile_ordinals(px.limit(0), block).count() == 0
