"""Large label graphs and tables: distributed rounds and shuffled joins that broadcast nothing, however small their files look."""

from functools import partial

import numpy as np
import pytest

from tests.conftest import as_pixels, as_rows
from tilegraph.functions.storage import materialise
from tilegraph.operators import closure, seams


@pytest.fixture
def plans(spark):
    """The final plans of all that ran since the test began."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def known():
        bus.waitUntilEmpty()
        found = store.executionsList()
        return {found.apply(k).executionId(): found.apply(k).physicalPlanDescription() for k in range(found.size())}

    before = set(known())
    return lambda: [text for k, text in known().items() if k not in before]


def test_rounds_broadcast_nothing(spark, plans):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 900, (2, 700))
    edges = spark.createDataFrame([*zip(a.tolist(), b.tolist(), strict=True), (1000, 1001), (5, 5), (None, 3)], "a long, b long")
    got = {tuple(r) for r in closure.components(edges, one_task=0).collect()}
    assert got == {tuple(r) for r in closure.components(edges).collect()} and len(got) > 100
    ran = plans()
    assert any("SortMergeJoin" in text for text in ran) and not any("BroadcastHashJoin" in text for text in ran)


def test_large_tables_relabel_by_a_shuffle(spark, plans, monkeypatch):
    """A table beyond the broadcast bound is small as a file; without hot labels none of it is broadcast."""
    rows = np.random.default_rng(3).integers(0, 200, (60, 60)).tolist()
    table = {k: k // 3 + 1 for k in range(3, 200, 2)}
    changes = materialise(spark.createDataFrame(list(table.items()), "label long, root long"))
    monkeypatch.setattr(seams, "BROADCAST_ROWS", 0)
    out = seams.apply_relabel(as_pixels(spark, rows), changes)
    assert as_rows(out) == [[table.get(v, v) for v in row] for row in rows]
    ran = plans()
    assert any("SortMergeJoin" in text for text in ran) and not any("BroadcastHashJoin" in text for text in ran)


def _grid(seed=6):
    """A raster of tiles of 10 x 10 whose labels meet in many ways."""
    rng = np.random.default_rng(seed)
    return (np.kron(rng.integers(0, 4, (16, 16)), np.ones((5, 5), dtype=int)) + 10 * np.kron(np.arange(64).reshape(8, 8), np.ones((10, 10), dtype=int))).tolist()


def test_merge_stats_of_a_large_graph(spark, plans, monkeypatch):
    """Counts by distributed rounds are those of one task, and no round broadcasts."""
    px = materialise(as_pixels(spark, _grid()))
    one = seams.merge_stats(px, 10).first()
    monkeypatch.setattr(seams, "components", partial(closure.components, one_task=0))
    seen = len(plans())
    assert seams.merge_stats(px, 10).first() == one and one["labels_merged"] > 50
    ran = plans()[seen:]
    assert any("SortMergeJoin" in text for text in ran) and not any("BroadcastHashJoin" in text for text in ran)


def test_relabel_table_of_a_large_graph(spark, plans, monkeypatch):
    """The labels that change, by distributed rounds and by one task; the pairs reach no join by a broadcast."""
    pairs = materialise(seams.chosen(as_pixels(spark, _grid(7)), 10))
    one = {tuple(r) for r in seams.relabel_table(pairs).collect()}
    monkeypatch.setattr(seams, "components", partial(closure.components, one_task=0))
    seen = len(plans())
    assert {tuple(r) for r in seams.relabel_table(pairs).collect()} == one and len(one) > 50
    ran = plans()[seen:]
    assert any("SortMergeJoin" in text for text in ran) and not any("BroadcastHashJoin" in text for text in ran)
