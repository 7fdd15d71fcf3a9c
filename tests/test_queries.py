"""Every registered raster query against DuckDB; those beyond SQL by their properties."""

import pytest

from tests.oracle import connect, rows_of, sql_rows
from tilegraph.plans import queries as q


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_matches_sql(spark, sf_dir, duck, name):
    assert rows_of(q.queries()[name](spark, sf_dir)) == sql_rows(duck, q.oracle_sql()[name])


def test_beyond_sql(spark, sf_dir):
    all_ = q.queries()
    assert set(all_) - set(q.oracle_sql()) == {"kmeans_points", "polygons"}
    background = {(r["x"], r["y"]) for r in all_["unmerged_raster"](spark, sf_dir).where("label = 0").collect()}
    points = all_["kmeans_points"](spark, sf_dir).collect()
    assert len(points) == 16 and all((p["x"], p["y"]) in background for p in points)
    assert points == all_["kmeans_points"](spark, sf_dir).collect()
    accepted = all_["greedy_accept"](spark, sf_dir)
    assert accepted.groupBy("tile_id", "x", "y").count().where("count > 1").isEmpty()
    kept = all_["box_nms"](spark, sf_dir)
    assert 0 < kept.count() <= 500
    once = all_["enclosed_merge"](spark, sf_dir).select("label").distinct().count()
    assert all_["enclosed_merge_until_stable"](spark, sf_dir).select("label").distinct().count() <= once
    whole = all_["polygon_areas"](spark, sf_dir).count()
    assert all_["polygons"](spark, sf_dir).where("area_m2 > 0").count() == whole


def test_published_counts(spark, sf_dir):
    """Figures of the smallest derived raster, found by other means before this engine."""
    best = q.queries()["merge_stats_best_match"](spark, sf_dir).first()
    assert (best["pairs_found"], best["pairs_after_filter"], best["labels_merged"], best["segments_after_merge"]) == (43, 34, 34, 56)
    mutual = q.queries()["merge_stats_mutual_best"](spark, sf_dir).first()
    assert (mutual["pairs_after_filter"], mutual["labels_merged"], mutual["segments_after_merge"]) == (16, 16, 74)
    enough = q.queries()["merge_stats_min_contact"](spark, sf_dir).first()
    assert (enough["pairs_after_filter"], enough["labels_merged"], enough["segments_after_merge"]) == (3, 3, 87)
    assert q.queries()["component_sizes"](spark, sf_dir).count() == 113
    assert q.queries()["erode_1"](spark, sf_dir).count() == 276
