"""The registered queries of the raster operators, each with its counterpart in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sql
from ..config import Threshold
from ..functions import raster
from ..functions.storage import checkpoint_root, materialise
from ..operators import adjacency, blocks, cleanup, clusters, components, grid, masks, multipass, points, runs, seams, validity, vector, zonal
from ..sources import fixtures as fx
from ..sources import raster_source, vector_files
from ..sources.mosaic import Mosaic
from ..sources.mosaic_table import MosaicTable
from ..sources.tiff import read_header, shared_path
from ..streaming import seam_state

W, T, BLOCK = fx.WIDTH, fx.TILE, 64
MIN_CONTACT, MIN_AREA, ENCLOSED = 3, 5, 20
F1, F2, F3 = fx.LABEL_RASTER_SQL, fx.MASKS_SQL, fx.COVERAGE_SERIES_SQL

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _r(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


def _height(px: DataFrame) -> int:
    return px.agg(F.max("y")).first()[0] + 1


# ---------------------------------------------------------------- seams

_CONTACTS = f"""WITH RECURSIVE {F1}, met AS (
  SELECT 'v' AS axis, b.x AS line, a.label AS a, b.label AS b FROM f1 a JOIN f1 b ON a.y = b.y AND b.x = a.x + 1 WHERE b.x % {T} = 0
  UNION ALL
  SELECT 'h', b.y, a.label, b.label FROM f1 a JOIN f1 b ON a.x = b.x AND b.y = a.y + 1 WHERE b.y % {T} = 0
), contacts AS (
  SELECT axis, line, a, b, count(*) AS cnt FROM met WHERE a > 0 AND b > 0 AND a <> b GROUP BY ALL
), unordered AS (
  SELECT axis, line, least(a, b) AS a, greatest(a, b) AS b, CAST(sum(cnt) AS BIGINT) AS cnt FROM contacts GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY axis, line, a ORDER BY cnt DESC, b) AS ra, row_number() OVER (PARTITION BY axis, line, b ORDER BY cnt DESC, a) AS rb FROM contacts
), best AS (SELECT axis, line, a, b, cnt FROM ranked WHERE ra = 1 OR rb = 1),
mutual AS (SELECT axis, line, a, b, cnt FROM ranked WHERE ra = 1 AND rb = 1),
enough AS (SELECT * FROM unordered WHERE cnt >= {MIN_CONTACT})"""


def _closure(pairs: str) -> str:
    return f""", edge AS (SELECT a, b FROM {pairs} UNION SELECT b, a FROM {pairs}),
cc(node, comp) USING KEY (node) AS (
  SELECT DISTINCT a, a FROM edge
  UNION
  SELECT e.a, min(cc.comp) FROM cc JOIN edge e ON cc.node = e.b JOIN recurring.cc r ON r.node = e.a WHERE cc.comp < r.comp GROUP BY e.a
), relabel AS (SELECT node AS label, comp AS root FROM cc WHERE node <> comp)"""


@_query(_CONTACTS + " SELECT * FROM contacts")
def seam_contacts(spark, sf_dir):
    return seams.contacts(fx.label_raster(spark, sf_dir), T)


@_query(_CONTACTS + " SELECT * FROM contacts")
def streamed_seam_contacts(spark, sf_dir):
    """The contacts after rows of tiles have arrived as a stream, some of them twice."""
    root = _folder(spark)
    rows = fx.label_raster(spark, sf_dir).select("x", "y", "label", "tr")
    first = rows.where("tr % 3 = 0").withColumn("label", F.col("label") + 1)  # what is sent again later
    for k, part in enumerate((first, rows.where("tr % 2 = 0"), rows.where("tr % 2 = 1"))):
        part.coalesce(1).write.parquet(f"{root}/in/sent={k}")
    arrivals = spark.readStream.schema("x int, y int, label bigint, sent int").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    store = seam_state.ChangeStore(spark, f"{root}/store")
    store.follow(seam_state.contact_changes(arrivals, T, "sent"), f"{root}/checkpoint", once=True).awaitTermination()
    return store.contacts()


@_query(_CONTACTS + " SELECT * FROM unordered")
def seam_contacts_unordered(spark, sf_dir):
    return seams.contacts(fx.label_raster(spark, sf_dir), T, ordered=False)


@_query(_CONTACTS + " SELECT * FROM best")
def seam_best_match(spark, sf_dir):
    return seams.chosen(fx.label_raster(spark, sf_dir), T, "best_match")


@_query(_CONTACTS + " SELECT * FROM mutual")
def seam_mutual_best(spark, sf_dir):
    return seams.chosen(fx.label_raster(spark, sf_dir), T, "mutual_best")


@_query(_CONTACTS + " SELECT * FROM enough")
def seam_min_contact(spark, sf_dir):
    return seams.chosen(fx.label_raster(spark, sf_dir), T, "min_contact", MIN_CONTACT)


@_query(_CONTACTS + _closure("best") + " SELECT * FROM relabel")
def seam_relabel(spark, sf_dir):
    return seams.relabel_table(seams.chosen(fx.label_raster(spark, sf_dir), T))


@_query(_CONTACTS + _closure("best") + " SELECT x, y, coalesce(root, f1.label) AS label FROM f1 LEFT JOIN relabel ON f1.label = relabel.label")
def merged_raster(spark, sf_dir):
    return seams.merge_seams(fx.label_raster(spark, sf_dir).select("x", "y", "label"), T)


@_query(f"WITH {F1} SELECT x, y, label FROM f1")
def unmerged_raster(spark, sf_dir):
    """The strategy that merges nothing."""
    return seams.merge_seams(fx.label_raster(spark, sf_dir).select("x", "y", "label"), T, "none")


def _stats_sql(strategy: str, found: str, kept: str) -> str:
    return (
        _CONTACTS + _closure(kept) + f""" SELECT '{strategy}' AS merge_strategy, (SELECT count(*) FROM {found}) AS pairs_found, (SELECT count(*) FROM {kept}) AS pairs_after_filter,
  (SELECT count(*) FROM (SELECT DISTINCT least(a, b), greatest(a, b) FROM {kept})) AS unique_pairs_to_merge, (SELECT count(*) FROM relabel) AS labels_merged,
  (SELECT count(DISTINCT label) FROM f1 WHERE label > 0) AS segments_before_merge,
  (SELECT count(DISTINCT coalesce(root, f1.label)) FROM f1 LEFT JOIN relabel ON f1.label = relabel.label WHERE f1.label > 0) AS segments_after_merge,
  (SELECT count(*) FROM relabel) AS segments_reduced"""
    )


def _merge_stats(strategy: str):
    return lambda spark, sf_dir: seams.merge_stats(materialise(fx.label_raster(spark, sf_dir).select("x", "y", "label")), T, strategy, MIN_CONTACT)


for _strategy, _found, _kept in (("best_match", "contacts", "best"), ("mutual_best", "contacts", "mutual"), ("min_contact", "unordered", "enough")):
    _QUERIES[f"merge_stats_{_strategy}"] = _merge_stats(_strategy)
    _SQL[f"merge_stats_{_strategy}"] = _stats_sql(_strategy, _found, _kept)


@_query(_CONTACTS + _closure("best") + """, merged AS (SELECT coalesce(root, f1.label) AS label FROM f1 LEFT JOIN relabel ON f1.label = relabel.label),
areas AS (SELECT label, count(*) AS area FROM merged WHERE label > 0 GROUP BY label)
SELECT count(*) AS segments, round(avg(area), 6) AS mean, round(median(area), 6) AS median, round(stddev_pop(area), 6) AS std, min(area) AS min, max(area) AS max,
  round((SELECT avg(CASE WHEN label > 0 THEN 1.0 ELSE 0.0 END) * 100 FROM merged), 6) AS coverage FROM areas""")
def segment_statistics(spark, sf_dir):
    """Flagship: seams merged by best match, then the statistics of what is left."""
    merged = materialise(seams.merge_seams(fx.label_raster(spark, sf_dir).select("x", "y", "label"), T))
    count = zonal.label_areas(merged).agg(F.count("*").alias("segments"))
    return count.crossJoin(zonal.segment_sizes(merged).select(*_r("mean", "median", "std"), "min", "max")).crossJoin(zonal.coverage(merged).select(*_r("coverage")))


# ---------------------------------------------------------------- zonal


@_query(f"WITH {F1} SELECT label, count(*) AS n FROM f1 GROUP BY label")
def label_histogram(spark, sf_dir):
    return zonal.label_counts(fx.label_raster(spark, sf_dir))


@_query(f"WITH {F1} SELECT label, count(*) AS area FROM f1 WHERE label > 0 GROUP BY label")
def label_areas(spark, sf_dir):
    return zonal.label_areas(fx.label_raster(spark, sf_dir))


@_query(f"""WITH {F1}, a AS (SELECT label, count(*) AS area FROM f1 WHERE label > 0 GROUP BY label)
SELECT count(*) AS n_regions, coalesce(min(area), 0) AS min_area, coalesce(max(area), 0) AS max_area, round(coalesce(avg(area), 0), 6) AS mean_area, round(coalesce(median(area), 0), 6) AS median_area, CAST(coalesce(sum(area), 0) AS BIGINT) AS total_area FROM a""")
def area_statistics(spark, sf_dir):
    return zonal.area_statistics(fx.label_raster(spark, sf_dir)).select("n_regions", "min_area", "max_area", *_r("mean_area", "median_area"), "total_area")


@_query(f"""WITH {F1}, a AS (SELECT label, count(*) AS area FROM f1 WHERE label > 0 GROUP BY label)
SELECT round(avg(area), 6) AS mean, round(median(area), 6) AS median, round(stddev_pop(area), 6) AS std, min(area) AS min, max(area) AS max FROM a""")
def segment_sizes(spark, sf_dir):
    return zonal.segment_sizes(fx.label_raster(spark, sf_dir)).select(*_r("mean", "median", "std"), "min", "max")


@_query(f"WITH {F1} SELECT round(avg(CASE WHEN label > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS coverage FROM f1")
def coverage(spark, sf_dir):
    return zonal.coverage(fx.label_raster(spark, sf_dir)).select(*_r("coverage"))


@_query(f"WITH {F1} SELECT tr AS tile_row, tc AS tile_col, round(avg(CASE WHEN label > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS coverage, greatest(count(DISTINCT label) - 1, 0) AS n_labels, max(label) AS max_label FROM f1 GROUP BY tr, tc")
def tile_stats(spark, sf_dir):
    return zonal.tile_summary(fx.label_raster(spark, sf_dir)).select("tile_row", "tile_col", *_r("coverage"), "n_labels", "max_label")


@_query(f"WITH {F1} SELECT tr AS tile_row, tc AS tile_col FROM f1 GROUP BY tr, tc HAVING sum(CASE WHEN label % 9 = 1 THEN fg ELSE 0 END) <> 0")
def nonempty_tiles(spark, sf_dir):
    px = fx.label_raster(spark, sf_dir).withColumn("v", F.when(F.col("label") % 9 == 1, F.col("fg")).otherwise(0))
    return zonal.nonempty_tiles(px, "v")


@_query(f"""WITH {F1}, t AS (SELECT tr, tc, max(CASE WHEN label = 0 THEN 0 ELSE (label - 1) % 9 + 1 END) AS max_label FROM f1 GROUP BY tr, tc)
SELECT tr AS tile_row, tc AS tile_col, max_label, CAST(coalesce(sum(max_label) OVER (ORDER BY tr, tc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM t""")
def label_offsets(spark, sf_dir):
    local = F.expr("case when label = 0 then 0 else (label - 1) % 9 + 1 end").cast("long")
    per_tile = fx.label_raster(spark, sf_dir).groupBy(F.col("tr").alias("tile_row"), F.col("tc").alias("tile_col")).agg(F.max(local).alias("max_label"))
    return grid.label_offsets(per_tile).select("tile_row", "tile_col", "max_label", "offset")


@_query(f"WITH {F1}, {F3} SELECT scene, pass, round(coverage, 6) AS coverage, round(coverage - coalesce(lag(coverage) OVER (PARTITION BY scene ORDER BY pass), 0), 6) AS gain FROM f3")
def coverage_gain(spark, sf_dir):
    return zonal.coverage_gain(fx.coverage_series(spark, sf_dir)).select("scene", "pass", *_r("coverage", "gain"))


@_query(f"WITH {F1}, {F3} SELECT round(0.6 + coverage / 1000, 2) AS threshold, count(*) AS tiles FROM f3 GROUP BY 1")
def threshold_histogram(spark, sf_dir):
    return zonal.threshold_histogram(fx.coverage_series(spark, sf_dir).withColumn("final_iou", F.lit(0.6) + F.col("coverage") / 1000))


@_query(f"WITH {F1}, {F3} SELECT scene, pass, round(CAST(greatest(0.6, 0.93 - pass * 0.04) AS DOUBLE), 6) AS threshold FROM f3")
def threshold_schedule(spark, sf_dir):
    """The threshold of each recorded pass of each scene, falling in equal steps."""
    return zonal.threshold_schedule(fx.coverage_series(spark, sf_dir), "pass", 0.93, 0.6, 0.04).select("scene", "pass", *_r("threshold"))


@_query(f"""WITH {F1}, {F3}, s AS (SELECT scene, coverage AS used, ntile(5) OVER (ORDER BY scene, pass) AS fifth FROM f3)
SELECT round(min(used), 6) AS min, round(max(used), 6) AS max, round(avg(used), 6) AS avg, CASE WHEN count(*) > 10 THEN round(avg(CASE WHEN fifth = 5 THEN used END) - avg(CASE WHEN fifth = 1 THEN used END), 6) END AS growth,
  coalesce(count(*) > 10 AND avg(CASE WHEN fifth = 5 THEN used END) - avg(CASE WHEN fifth = 1 THEN used END) > 1000, FALSE) AS warn FROM s""")
def growth_check(spark, sf_dir):
    """A monitor's series: the extremes and the drift from its first fifth to its last."""
    s = fx.coverage_series(spark, sf_dir).select((F.col("scene") * 1000 + F.col("pass")).alias("t"), F.col("coverage").alias("used"))
    return zonal.growth_check(s).select(*_r("min", "max", "avg", "growth"), "warn")


@_query(f"WITH {F2} SELECT tile_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, min(pass) AS first_pass, CASE WHEN min(pass) < 1 THEN 0 WHEN min(pass) < 3 THEN 1 ELSE 2 END AS bucket FROM mask_px GROUP BY ALL")
def pass_map(spark, sf_dir):
    found = zonal.pass_map(masks.mask_pixels(fx.masks(spark, sf_dir), 8, "tile_id", "pass"), "tile_id")
    return found.withColumn("bucket", zonal.pass_bucket(F.col("first_pass"), [1, 3]))


@_query(f"""WITH {F2}, p AS (SELECT tile_id, pass, count(*) AS generated, count(*) FILTER (score > 0.5) AS added, max(score) AS coverage FROM f2 GROUP BY ALL)
SELECT tile_id AS tile_row, string_agg(CAST(added AS VARCHAR), ',' ORDER BY pass) AS masks_per_pass, string_agg(CAST(generated AS VARCHAR), ',' ORDER BY pass) AS masks_generated_per_pass, CAST(sum(added) AS BIGINT) AS total_masks FROM p GROUP BY tile_id""")
def pass_totals(spark, sf_dir):
    zero = F.lit(0).cast("long")
    p = fx.masks(spark, sf_dir).groupBy(F.col("tile_id").alias("tile_row"), F.lit(0).alias("tile_col"), "pass").agg(F.count("*").alias("generated"), F.count(F.when(F.col("score") > 0.5, 1)).alias("added"), F.max("score").alias("coverage"))
    out = zonal.pass_totals(p.withColumns({"filtered_overlap": zero, "filtered_small": zero}))
    return out.select("tile_row", F.array_join(F.col("masks_per_pass").cast("array<string>"), ",").alias("masks_per_pass"), F.array_join(F.col("masks_generated_per_pass").cast("array<string>"), ",").alias("masks_generated_per_pass"), "total_masks")


@_query(f"""WITH {F1}, c AS (SELECT x, avg(CASE WHEN label < 400 THEN 1.0 ELSE 0.0 END) AS d FROM f1 GROUP BY x HAVING d > 0.3), r AS (SELECT y, avg(CASE WHEN label < 400 THEN 1.0 ELSE 0.0 END) AS d FROM f1 GROUP BY y HAVING d > 0.3)
SELECT (SELECT min(x) FROM c) AS x0, (SELECT max(x) FROM c) AS x1, (SELECT min(y) FROM r) AS y0, (SELECT max(y) FROM r) AS y1""")
def bright_extent(spark, sf_dir):
    return zonal.bright_extent(fx.label_raster(spark, sf_dir), "label", 400, 0.3)


# ---------------------------------------------------------------- components and cleanup


def _cc(value: str, where: str, name: str = "cc") -> str:
    """Components of f1's pixels by brute relaxation over neighbour pairs of equal value."""
    return f"""px AS (SELECT CAST(y * {W} + x AS BIGINT) AS id, x, y, {value} AS v FROM f1 WHERE {where}), nb AS (
  SELECT p.id AS a, q.id AS b FROM px p JOIN px q ON p.v = q.v AND ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x - 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1) OR (q.x = p.x AND q.y = p.y - 1))
), {name}(id, comp) USING KEY (id) AS (
  SELECT id, id FROM px
  UNION
  SELECT nb.a, min({name}.comp) FROM {name} JOIN nb ON {name}.id = nb.b JOIN recurring.{name} r ON r.id = nb.a WHERE {name}.comp < r.comp GROUP BY nb.a
), area AS (SELECT comp, count(*) AS area FROM {name} GROUP BY comp)"""


_FG = f"WITH RECURSIVE {F1}, " + _cc("fg", "fg = 1")
_BLOB = f"WITH RECURSIVE {F1}, " + _cc("1", "label > 0 AND fg = 1")
_PER_LABEL = f"WITH RECURSIVE {F1}, " + _cc("label", "label > 0")


def _cleaned(condition: str, label: str = "f1.label") -> str:
    return f" SELECT f1.x, f1.y, CASE WHEN {condition} THEN 0 ELSE {label} END AS label FROM f1 LEFT JOIN cc ON cc.id = f1.y * {W} + f1.x LEFT JOIN area ON area.comp = cc.comp"


@_query(_FG + f" SELECT CAST(id % {W} AS INT) AS x, CAST(id // {W} AS INT) AS y, comp FROM cc")
def components_fg(spark, sf_dir):
    return components.connected(fx.label_raster(spark, sf_dir), "fg", W, BLOCK)


@_query(_PER_LABEL + f" SELECT CAST(id % {W} AS INT) AS x, CAST(id // {W} AS INT) AS y, comp FROM cc")
def components_per_label(spark, sf_dir):
    return components.connected(fx.label_raster(spark, sf_dir), "label", W, BLOCK)


@_query(_FG + " SELECT comp, area FROM area")
def component_sizes(spark, sf_dir):
    return components.sizes(components.connected(fx.label_raster(spark, sf_dir), "fg", W, BLOCK))


@_query(_FG + f" SELECT CAST(id % {W} AS INT) AS x, CAST(id // {W} AS INT) AS y, comp, dense_rank() OVER (ORDER BY comp) AS ordinal FROM cc")
def component_ordinals(spark, sf_dir):
    return components.ordinals(fx.label_raster(spark, sf_dir), "fg", W, BLOCK)


@_query(_PER_LABEL + f" SELECT CAST(id % {W} AS INT) AS x, CAST(id // {W} AS INT) AS y, comp, dense_rank() OVER (ORDER BY comp) AS ordinal FROM cc")
def component_ordinals_per_label(spark, sf_dir):
    return components.ordinals(fx.label_raster(spark, sf_dir), "label", W, BLOCK)


_TILE_CC = f"WITH RECURSIVE {F1}, " + _cc("1 + tr * 1000 + tc", "fg = 1")


@_query(_TILE_CC + f""" SELECT tr AS tile_row, tc AS tile_col, x, y, dense_rank() OVER (PARTITION BY tr, tc ORDER BY comp) AS ordinal
FROM (SELECT CAST(id % {W} AS INT) AS x, CAST(id // {W} AS INT) AS y, comp, CAST(id // {W} // {T} AS INT) AS tr, CAST(id % {W} // {T} AS INT) AS tc FROM cc)""")
def tile_ordinals(spark, sf_dir):
    return components.tile_ordinals(fx.label_raster(spark, sf_dir), T, "fg")


def _sql_view(spark, sf_dir) -> str:
    sql.register(spark)
    name = f"pixels_{uuid.uuid4().hex}"
    fx.label_raster(spark, sf_dir).createOrReplaceTempView(name)
    return name


@_query(_TILE_CC + f""" SELECT tr AS tile_row, tc AS tile_col, x, y, dense_rank() OVER (PARTITION BY tr, tc ORDER BY comp) AS ordinal
FROM (SELECT CAST(id % {W} AS INT) AS x, CAST(id // {W} AS INT) AS y, comp, CAST(id // {W} // {T} AS INT) AS tr, CAST(id % {W} // {T} AS INT) AS tc FROM cc)""")
def sql_tile_components(spark, sf_dir):
    """tile_ordinals by a table function, as SQL text."""
    return spark.sql(f"SELECT * FROM tg_tile_components(TABLE(SELECT x, y, fg AS label, tg_tile(y, {T}) AS tile_row, tg_tile(x, {T}) AS tile_col FROM {_sql_view(spark, sf_dir)}) PARTITION BY (tile_row, tile_col))")


@_query(f"""WITH {F1}, c AS (SELECT *, (label % 2147483648) * 2654435761 AS h FROM f1)
SELECT x, y, CASE WHEN label = 0 THEN 0 ELSE CAST((h >> 8) & 255 AS INT) END AS red, CASE WHEN label = 0 THEN 0 ELSE CAST((h >> 16) & 255 AS INT) END AS green, CASE WHEN label = 0 THEN 0 ELSE CAST((h >> 24) & 255 AS INT) END AS blue, CAST(2 * x + 100 AS DOUBLE) AS map_x, CAST(900 - 2 * y AS DOUBLE) AS map_y FROM c""")
def sql_colours(spark, sf_dir):
    """Colours and map coordinates of all pixels by functions on values, as SQL text."""
    view = _sql_view(spark, sf_dir)
    return spark.sql(f"SELECT x, y, c[0] AS red, c[1] AS green, c[2] AS blue, tg_map_x(x, y, t) AS map_x, tg_map_y(x, y, t) AS map_y FROM (SELECT x, y, tg_colour(label) AS c, array(2D, 0D, 100D, 0D, -2D, 900D) AS t FROM {view})")


def _pixels(spark, sf_dir):
    return fx.label_raster(spark, sf_dir).select("x", "y", "label")


def _sparse(spark, sf_dir):
    """The label raster without the pixels outside its foreground: many small blobs of several labels."""
    return fx.label_raster(spark, sf_dir).select("x", "y", F.when(F.col("fg") == 1, F.col("label")).otherwise(F.lit(0)).cast("long").alias("label"))


_SPARSE = "CASE WHEN fg = 1 THEN f1.label ELSE 0 END"


@_query(_BLOB + _cleaned(f"area.area < {MIN_AREA}", _SPARSE))
def drop_small_blobs(spark, sf_dir):
    return cleanup.drop_small(_sparse(spark, sf_dir), MIN_AREA, "foreground", W, BLOCK)


@_query(_PER_LABEL + _cleaned(f"area.area < {MIN_AREA}"))
def drop_small_per_label(spark, sf_dir):
    return cleanup.drop_small(_pixels(spark, sf_dir), MIN_AREA, "per_label", W, BLOCK)


@_query(_PER_LABEL + _cleaned("area.area < 8"))
def drop_small_by_ratio(spark, sf_dir):
    return cleanup.drop_small_by_ratio(_pixels(spark, sf_dir), 100, 0.085, "per_label", W, BLOCK)


_ENCLOSED = f""", reg AS (SELECT f1.x, f1.y, f1.label, cc.comp FROM f1 LEFT JOIN cc ON cc.id = f1.y * {W} + f1.x),
beside AS (SELECT p.comp, q.comp AS other, q.label AS other_label FROM reg p JOIN reg q
  ON (q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x - 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1) OR (q.x = p.x AND q.y = p.y - 1)
  WHERE p.comp IS NOT NULL AND p.comp IS DISTINCT FROM q.comp),
target AS (SELECT s.comp, s.target FROM (SELECT beside.comp, count(DISTINCT other_label) AS labels, max(other_label) AS target, bool_or(other IS NULL) AS open, max(o.area) AS largest
    FROM beside LEFT JOIN area o ON o.comp = other GROUP BY beside.comp) s JOIN area a ON a.comp = s.comp WHERE labels = 1 AND NOT open AND a.area <= {ENCLOSED} AND largest > a.area)"""


@_query(_PER_LABEL + _ENCLOSED + " SELECT x, y, coalesce(target, label) AS label FROM reg LEFT JOIN target ON target.comp = reg.comp")
def enclosed_merge(spark, sf_dir):
    return cleanup.enclosed_merge(_pixels(spark, sf_dir), ENCLOSED, "per_label", W, BLOCK)


@_query(f"WITH {F1} SELECT x, y, label FROM f1")
def enclosed_merge_compatible(spark, sf_dir):
    return cleanup.enclosed_merge(_pixels(spark, sf_dir), ENCLOSED, "foreground", W, BLOCK)


@_query(_PER_LABEL + _ENCLOSED + f" SELECT x, y, CASE WHEN target IS NOT NULL THEN target WHEN area < {MIN_AREA} THEN 0 ELSE label END AS label FROM reg LEFT JOIN target ON target.comp = reg.comp LEFT JOIN area ON area.comp = reg.comp")
def enclosed_merge_and_drop_small(spark, sf_dir):
    return cleanup.enclosed_merge_and_drop_small(_pixels(spark, sf_dir), ENCLOSED, MIN_AREA, "per_label", W, BLOCK)


@_query(_BLOB + _cleaned(f"area.area < {MIN_AREA}", _SPARSE))
def enclosed_merge_and_drop_small_compatible(spark, sf_dir):
    return cleanup.enclosed_merge_and_drop_small(_sparse(spark, sf_dir), ENCLOSED, MIN_AREA, "foreground", W, BLOCK)


_REGIONS = _PER_LABEL + _ENCLOSED + ", lab AS (SELECT comp, any_value(label) AS label FROM reg WHERE comp IS NOT NULL GROUP BY comp)"


@_query(_REGIONS + " SELECT comp AS a, other AS b, lp.label AS a_label, lq.label AS b_label, count(*) AS length FROM beside JOIN lab lp USING (comp) JOIN lab lq ON lq.comp = other GROUP BY ALL")
def region_contacts(spark, sf_dir):
    return adjacency.region_graph(_pixels(spark, sf_dir), W, BLOCK).contacts


@_query(_REGIONS + """, told AS (SELECT b.comp, count(DISTINCT other) AS n_neighbours, count(*) AS contact, min(other_label) AS low_label, CAST(min(other_label) = max(other_label) AS INT) AS one_label, max(o.area) AS largest
  FROM beside b JOIN area o ON o.comp = b.other GROUP BY b.comp), opened AS (SELECT DISTINCT comp, true AS open FROM beside WHERE other IS NULL)
SELECT l.comp, l.label, a.area, coalesce(o.open, false) AS open, coalesce(n_neighbours, 0) AS n_neighbours, coalesce(contact, 0) AS contact, one_label, low_label, largest
FROM lab l JOIN area a USING (comp) LEFT JOIN told USING (comp) LEFT JOIN opened o USING (comp)""")
def region_neighbours(spark, sf_dir):
    return adjacency.neighbours(adjacency.region_graph(_pixels(spark, sf_dir), W, BLOCK))


def _stable_sql(rounds: int) -> str:
    """The merge round after round, each with components of its own, and the round that the loop stops at."""
    parts = [f"WITH RECURSIVE {F1}, s0 AS MATERIALIZED (SELECT x, y, label FROM f1)"]
    step = "(q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x - 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1) OR (q.x = p.x AND q.y = p.y - 1)"
    for k in range(1, rounds + 1):
        parts.append(f"""px{k} AS MATERIALIZED (SELECT CAST(y * {W} + x AS BIGINT) AS id, x, y, label AS v FROM s{k - 1} WHERE label > 0), nb{k} AS MATERIALIZED (
  SELECT p.id AS a, q.id AS b FROM px{k} p JOIN px{k} q ON p.v = q.v AND ({step})
), cc{k}(id, comp) USING KEY (id) AS (
  SELECT id, id FROM px{k}
  UNION
  SELECT n.a, min(c.comp) FROM cc{k} c JOIN nb{k} n ON c.id = n.b JOIN recurring.cc{k} r ON r.id = n.a WHERE c.comp < r.comp GROUP BY n.a
), area{k} AS MATERIALIZED (SELECT comp, count(*) AS area FROM cc{k} GROUP BY comp),
reg{k} AS MATERIALIZED (SELECT s.x, s.y, s.label, c.comp FROM s{k - 1} s LEFT JOIN cc{k} c ON c.id = s.y * {W} + s.x),
beside{k} AS (SELECT p.comp, q.comp AS other, q.label AS other_label FROM reg{k} p JOIN reg{k} q ON {step} WHERE p.comp IS NOT NULL AND p.comp IS DISTINCT FROM q.comp),
target{k} AS (SELECT s.comp, s.target FROM (SELECT b.comp, count(DISTINCT other_label) AS labels, max(other_label) AS target, bool_or(other IS NULL) AS open, max(o.area) AS largest
    FROM beside{k} b LEFT JOIN area{k} o ON o.comp = b.other GROUP BY b.comp) s JOIN area{k} a ON a.comp = s.comp WHERE labels = 1 AND NOT open AND a.area <= {ENCLOSED} AND largest > a.area),
s{k} AS MATERIALIZED (SELECT x, y, coalesce(target, label) AS label FROM reg{k} LEFT JOIN target{k} ON target{k}.comp = reg{k}.comp)""")
    counts = " UNION ALL ".join(f"SELECT {k} AS k, count(DISTINCT label) AS n FROM s{k} WHERE label > 0" for k in range(rounds + 1))
    parts.append(f"counts AS ({counts}), stop AS (SELECT coalesce(min(a.k), {rounds}) AS k FROM counts a JOIN counts b ON b.k = a.k - 1 WHERE a.n = b.n)")
    return ",\n".join(parts) + " " + " UNION ALL ".join(f"SELECT x, y, label FROM s{k}, stop WHERE stop.k = {k}" for k in range(1, rounds + 1))


@_query(_stable_sql(10))
def enclosed_merge_until_stable(spark, sf_dir):
    return cleanup.enclosed_merge_until_stable(_pixels(spark, sf_dir), ENCLOSED, 10, "per_label", W, BLOCK)


# ---------------------------------------------------------------- grid and points


_TILES = f"""WITH {fx.IMAGES_SQL}, g AS (SELECT *, {{cols}} AS n_cols, {{rows}} AS n_rows FROM images),
t AS (SELECT image_id, width, height, n_cols, n_rows, r, unnest(range(0, n_cols)) AS c FROM (SELECT *, unnest(range(0, n_rows)) AS r FROM g))"""
_WHOLE, _COVER = _TILES.format(cols="width // 250", rows="height // 250"), _TILES.format(cols="(width + 249) // 250", rows="(height + 249) // 250")


@_query(_COVER + " SELECT image_id, CAST(r AS INT) AS tile_row, CAST(c AS INT) AS tile_col FROM t")
def grid_tiles(spark, sf_dir):
    """The tiles of every image of a catalogue."""
    return grid.tiles_of(fx.images(spark, sf_dir), 250, "cover").select("image_id", "tile_row", "tile_col")


def _windows_sql(start: str, crop: str, length: str) -> str:
    along = lambda template, k, n, size, at: template.format(k=k, n=n, size=size, at=at)
    x, y = ("c", "n_cols", "width", "read_x"), ("r", "n_rows", "height", "read_y")
    return f""", s AS (SELECT *, {along(start, *x)} AS read_x, {along(start, *y)} AS read_y FROM t)
SELECT image_id, CAST(r AS INT) AS tile_row, CAST(c AS INT) AS tile_col, CAST(read_x AS INT) AS read_x, CAST(read_y AS INT) AS read_y, CAST({along(crop, *x)} AS INT) AS crop_x, CAST({along(crop, *y)} AS INT) AS crop_y,
  CAST({along(length, *x)} AS INT) AS read_w, CAST({along(length, *y)} AS INT) AS read_h, CAST(c * 250 AS INT) AS write_x, CAST(r * 250 AS INT) AS write_y FROM s"""


def _windows(spark, sf_dir, edge):
    found = grid.windows_of(fx.images(spark, sf_dir), 250, 40, edge)
    return found.select("image_id", "tile_row", "tile_col", "read_x", "read_y", "crop_x", "crop_y", "read_w", "read_h", "write_x", "write_y")


@_query(_WHOLE + _windows_sql("CASE WHEN {k} = 0 THEN 0 WHEN {k} = {n} - 1 THEN {size} - 330 ELSE {k} * 250 - 40 END", "CASE WHEN {k} = 0 THEN 0 WHEN {k} = {n} - 1 THEN 80 ELSE 40 END", "least(330, {size} - {at})"))
def tile_windows(spark, sf_dir):
    """The padded windows of every image's whole tiles."""
    return _windows(spark, sf_dir, "whole")


@_query(_COVER + _windows_sql("greatest({k} * 250 - 40, 0)", "{k} * 250 - {at}", "least(({k} + 1) * 250 + 40, {size}) - {at}"))
def tile_windows_cover(spark, sf_dir):
    """The windows that cover every image, clipped to it."""
    return _windows(spark, sf_dir, "cover")


def _tile_boxes(spark, sf_dir, where="true"):
    found = fx.label_raster(spark, sf_dir).where(where).groupBy("tr", "tc")
    return found.agg(*(f(c).alias(n) for n, f, c in (("x0", F.min, "x"), ("y0", F.min, "y"), ("x1", F.max, "x"), ("y1", F.max, "y"))))


_BOXES = "SELECT tr, tc, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM f1"
_GRID = f"""WITH {F1}, boxes AS ({_BOXES} GROUP BY tr, tc), k AS (SELECT *, unnest(range(0, 49)) AS point_id FROM boxes), g AS (SELECT tr, tc, point_id,
  CAST(trunc(CASE WHEN point_id % 7 = 6 THEN x1 ELSE x0 + point_id % 7 * ((x1 - x0) / 6.0::DOUBLE) END) AS INT) AS x, CAST(trunc(CASE WHEN point_id // 7 = 6 THEN y1 ELSE y0 + point_id // 7 * ((y1 - y0) / 6.0::DOUBLE) END) AS INT) AS y FROM k)"""


@_query(_GRID + " SELECT * FROM g")
def uniform_grid(spark, sf_dir):
    """A grid of 7 x 7 points over each tile."""
    return points.grids_over(_tile_boxes(spark, sf_dir), 7).select("tr", "tc", "point_id", "x", "y")


@_query(_GRID + f", inner_ AS ({_BOXES} WHERE fg = 1 GROUP BY tr, tc) SELECT g.* FROM g JOIN inner_ b USING (tr, tc) WHERE g.x BETWEEN b.x0 AND b.x1 AND g.y BETWEEN b.y0 AND b.y1")
def points_in_region(spark, sf_dir):
    """Each tile's grid points that lie in the box of its foreground."""
    grid_ = points.grids_over(_tile_boxes(spark, sf_dir), 7).select("tr", "tc", "point_id", "x", "y")
    return points.in_regions(grid_, _tile_boxes(spark, sf_dir, "fg = 1"), "tr", "tc")


@_query(f"WITH {F1}, s AS (SELECT max(y) + 1 AS h FROM f1), g AS (SELECT k AS point_id, CAST(k % 130 - 10 AS INT) AS x, CAST(k // 130 - 3 AS INT) AS y FROM s, range(0, 130 * (h + 6)) t(k)) SELECT g.* FROM g, s WHERE x >= 0 AND x < {W} AND y >= 0 AND y < h AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.x = g.x AND f1.y = g.y AND label > 0)")
def points_outside_mask(spark, sf_dir):
    px = fx.label_raster(spark, sf_dir)
    some = spark.range(130 * (_height(px) + 6)).select(F.col("id").alias("point_id"), F.expr("cast(id % 130 - 10 as int)").alias("x"), F.expr("cast(id div 130 - 3 as int)").alias("y"))
    return points.outside_mask(some, px.where("label > 0"), W, _height(px)).select("point_id", "x", "y")


def _eroded_sql(rounds: int, valid: str = "label > 0") -> str:
    return f"""WITH {F1}, v AS (SELECT x, y FROM f1 WHERE {valid}), step AS (SELECT i - {rounds} AS dx, j - {rounds} AS dy FROM range(0, {2 * rounds + 1}) a(i), range(0, {2 * rounds + 1}) b(j) WHERE abs(i - {rounds}) + abs(j - {rounds}) <= {rounds}),
er AS (SELECT p.x, p.y FROM v p, step JOIN v q ON q.x = p.x + dx AND q.y = p.y + dy GROUP BY p.x, p.y HAVING count(*) = {2 * rounds * (rounds + 1) + 1})"""


@_query(_eroded_sql(1) + " SELECT * FROM er")
def erode_1(spark, sf_dir):
    return points.eroded(fx.label_raster(spark, sf_dir).where("label > 0"), 1)


@_query(_eroded_sql(2) + " SELECT * FROM er")
def erode_2(spark, sf_dir):
    return points.eroded(fx.label_raster(spark, sf_dir).where("label > 0"), 2)


@_query(_eroded_sql(1, "fg = 0") + f", s AS (SELECT max(y) + 1 AS h FROM f1), g AS (SELECT k, k % 40 AS i, k // 40 AS j FROM range(0, 1600) t(k)), p AS (SELECT k AS point_id, CAST(trunc(CASE WHEN i = 39 THEN {W} - 1 ELSE i * (({W} - 1) / 39.0::DOUBLE) END) AS INT) AS x, CAST(trunc(CASE WHEN j = 39 THEN h - 1 ELSE j * ((h - 1) / 39.0::DOUBLE) END) AS INT) AS y FROM g, s) SELECT p.* FROM p JOIN er USING (x, y)")
def dense_grid_points(spark, sf_dir):
    px = fx.label_raster(spark, sf_dir)
    return points.dense_residual(spark, px.where("fg = 0"), _height(px), W, 40, 1)


@_query()
def kmeans_points(spark, sf_dir):
    return points.kmeans_points(fx.label_raster(spark, sf_dir).where("label = 0"), 16, 0)


@_query(f"""WITH {F1}, t AS (SELECT CAST(y // 50 AS INT) AS tile_row, CAST(x // 50 AS INT) AS tile_col, count(*) AS n_valid FROM f1 WHERE label = 0 GROUP BY ALL)
SELECT tile_row, tile_col, n_valid, least(n_valid, 16) AS n_points, least(n_valid, 16) AS n_on_valid FROM t""")
def tile_cluster_points(spark, sf_dir):
    """How many points each tile gets from the clusters of its free pixels, and how many of them stand on such pixels."""
    free = fx.label_raster(spark, sf_dir).where("label = 0").select("x", "y", F.lit(1).alias("free"))
    found = clusters.tile_points(free, 50, 16, 0).join(free, ["x", "y"], "left")
    tiles = free.groupBy((F.col("y") / 50).cast("int").alias("tile_row"), (F.col("x") / 50).cast("int").alias("tile_col")).agg(F.count("*").alias("n_valid"))
    return tiles.join(found.groupBy("tile_row", "tile_col").agg(F.count("*").alias("n_points"), F.count("free").alias("n_on_valid")), ["tile_row", "tile_col"], "left")


@_query(f"""WITH {F1}, v AS (SELECT count(*) AS n FROM f1 WHERE label = 0) SELECT least(n, 16) AS n_points, least(n, 16) AS n_on_valid FROM v""")
def kmeans_point_counts(spark, sf_dir):
    """The points of kmeans_points, counted, and those of them that stand on free pixels."""
    free = fx.label_raster(spark, sf_dir).where("label = 0").select("x", "y", F.lit(1).alias("free"))
    return kmeans_points(spark, sf_dir).join(free, ["x", "y"], "left").agg(F.count("*").alias("n_points"), F.count("free").alias("n_on_valid"))


@_query(f"WITH {F1}, v AS (SELECT x, y FROM f1 WHERE label = 0), c AS (SELECT i AS centre_id, 12.5 * i AS cx, 1.0 * i AS cy FROM range(0, 8) t(i)) SELECT CAST(centre_id AS INT) AS centre_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY centre_id ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), y, x) AS r FROM v, c) WHERE r = 1")
def nearest_to_centres(spark, sf_dir):
    centres = spark.range(8).select(F.col("id").cast("int").alias("centre_id"), (F.col("id") * 12.5).alias("x"), (F.col("id") * 1.0).alias("y"))
    return points.nearest(fx.label_raster(spark, sf_dir).where("label = 0"), centres)


# ---------------------------------------------------------------- values


@_query("SELECT vec_id, d, CAST(trunc(least(greatest(CAST(v AS DOUBLE) * 255, 0), 255)) AS INT) AS v FROM (SELECT vec_id, unnest(range(0, 64)) AS d, unnest(embedding) AS v FROM embeddings)")
def float_to_uint8(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("d", "v"))
    return e.select("vec_id", F.col("d").cast("long"), raster.to_uint8(F.col("v").cast("double"), "float32").alias("v"))


@_query(f"WITH {F1}, m AS (SELECT tr, tc, max(label) AS top FROM f1 GROUP BY tr, tc) SELECT x, y, CAST(CASE WHEN top <= 255 THEN label ELSE label // 256 END AS INT) AS v FROM f1 JOIN m USING (tr, tc)")
def uint16_to_uint8(spark, sf_dir):
    px = fx.label_raster(spark, sf_dir)
    top = px.groupBy("tr", "tc").agg(F.max("label").alias("top"))
    return px.join(top, ["tr", "tc"]).select("x", "y", raster.to_uint8(F.col("label"), "uint16", F.col("top")).alias("v"))


@_query(f"WITH {F1} SELECT x, y, CASE WHEN fg <> 0 THEN 0 ELSE label END AS v FROM f1")
def black_mask(spark, sf_dir):
    return fx.label_raster(spark, sf_dir).select("x", "y", raster.black_mask(F.col("label"), F.col("fg")).alias("v"))


@_query(f"WITH {F1} SELECT CAST(tr AS INT) AS tile_row, CAST(tc AS INT) AS tile_col, CAST(x % {T} AS INT) AS x, CAST(y % {T} AS INT) AS y, label FROM f1")
def crop_useful(spark, sf_dir):
    """The useful area of every tile, cut out of its padded window: a pixel comes to all windows that hold it and stays in one."""
    held = blocks.in_blocks(fx.label_raster(spark, sf_dir), F.col("label"), T, 2).withColumnsRenamed({"by": "tile_row", "bx": "tile_col", "v": "label"})
    read_x, crop_x = grid.axis_window(F.col("tile_col"), 0, 0, T, 2, "cover")
    read_y, crop_y = grid.axis_window(F.col("tile_row"), 0, 0, T, 2, "cover")
    inside, x, y = raster.crop(F.col("x") - read_x, F.col("y") - read_y, crop_x, crop_y, T)
    return held.where(inside).select("tile_row", "tile_col", x.cast("int").alias("x"), y.cast("int").alias("y"), "label")


@_query(f"WITH {F1} SELECT x, y, round(CAST(0.5 * x + 0.25 * y + 100 AS DOUBLE), 6) AS mx, round(CAST(0.125 * x - 0.5 * y + 200 AS DOUBLE), 6) AS my FROM f1")
def affine_corners(spark, sf_dir):
    mx, my = raster.affine(F.col("x"), F.col("y"), (0.5, 0.25, 100.0, 0.125, -0.5, 200.0))
    return fx.label_raster(spark, sf_dir).select("x", "y", F.round(mx, 6).alias("mx"), F.round(my, 6).alias("my"))


@_query(f"WITH {F1} SELECT x, y, x + 7 AS sx, y - 2 AS sy, round(CAST(CAST(x AS DOUBLE) / 128 AS FLOAT)::DOUBLE, 6) AS nx, round(CAST(CAST(y AS DOUBLE) / 64 AS FLOAT)::DOUBLE, 6) AS ny FROM f1")
def shifted_points(spark, sf_dir):
    sx, sy = raster.shifted(F.col("x"), F.col("y"), 7, -2)
    nx, ny = raster.normalised(F.col("x"), F.col("y"), 128, 64)
    return fx.label_raster(spark, sf_dir).select("x", "y", sx.alias("sx"), sy.alias("sy"), F.round(nx.cast("double"), 6).alias("nx"), F.round(ny.cast("double"), 6).alias("ny"))


@_query(f"WITH {F1} SELECT x, y, v[1] AS r, v[2] AS g, v[3] AS b FROM (SELECT x, y, CASE WHEN fg = 1 THEN [label % 251, label % 241, label % 239] ELSE [label % 251, label % 251, label % 251] END AS v FROM f1)")
def bands_to_rgb(spark, sf_dir):
    """One band is repeated, of four the first three are kept."""
    px = fx.label_raster(spark, sf_dir)
    bands = F.when(F.col("fg") == 1, F.array(*(F.col("label") % k for k in (251, 241, 239, 233)))).otherwise(F.array(F.col("label") % 251))
    return px.select("x", "y", raster.to_rgb(bands).alias("v")).select("x", "y", *(F.element_at("v", k + 1).alias(c) for k, c in enumerate("rgb")))


@_query(f"""WITH {F1}, c AS (SELECT x, y, label, label % 256 AS v, (label % 2147483648) * {raster.COLOUR} AS h FROM f1)
SELECT x, y, CAST(trunc(v * 0.75::DOUBLE + CASE WHEN label = 0 THEN 0 ELSE (h >> 8) & 255 END * 0.25::DOUBLE) AS INT) AS r, CAST(trunc(v * 0.75::DOUBLE + CASE WHEN label = 0 THEN 0 ELSE (h >> 16) & 255 END * 0.25::DOUBLE) AS INT) AS g,
  CAST(trunc(v * 0.75::DOUBLE + CASE WHEN label = 0 THEN 0 ELSE (h >> 24) & 255 END * 0.25::DOUBLE) AS INT) AS b FROM c""")
def blended_colours(spark, sf_dir):
    grey = F.array_repeat(F.col("label") % 256, 3)
    out = fx.label_raster(spark, sf_dir).select("x", "y", raster.blended(grey, F.col("label"), 0.25).alias("v"))
    return out.select("x", "y", *(F.element_at("v", k + 1).alias(c) for k, c in enumerate("rgb")))


_DECAY = f"""WITH RECURSIVE {F1}, {F3}, n AS (SELECT CAST(scene AS BIGINT) AS scene, CAST(pass AS BIGINT) AS pass, coverage FROM f3), walk(scene, pass, iou, stability, stopped, before) AS (
  SELECT DISTINCT scene, CAST(-1 AS BIGINT), 0.93::DOUBLE, 0.9::DOUBLE, FALSE, 0.0::DOUBLE FROM n
  UNION ALL
  SELECT w.scene, n.pass, CASE WHEN falls THEN greatest(0.91, w.iou - 0.01) ELSE w.iou END, CASE WHEN falls THEN greatest(0.88, w.stability - 0.01) ELSE w.stability END, done, n.coverage
  FROM (SELECT w.*, n.coverage AS c, n.coverage >= 65 OR (n.coverage - w.before < 0.1 AND w.iou <= 0.91) AS done, n.coverage < 65 AND n.coverage - w.before < 0.1 AND w.iou > 0.91 AS falls FROM walk w JOIN n ON n.scene = w.scene AND n.pass = w.pass + 1 WHERE NOT w.stopped) w
  JOIN n ON n.scene = w.scene AND n.pass = w.pass + 1
)"""


@_query(_DECAY + " SELECT scene, pass, round(iou, 6) AS iou, round(stability, 6) AS stability, stopped FROM walk WHERE pass >= 0")
def threshold_decay(spark, sf_dir):
    """Thresholds that fall when a pass adds little, until the target or the last threshold stops the loop."""
    rules = Threshold(iou_start=0.93, iou_end=0.91, stability_start=0.9, stability_end=0.88, step=0.01)
    return multipass.decay_by_scene(fx.coverage_series(spark, sf_dir), rules, 65.0).select("scene", "pass", *_r("iou", "stability"), "stopped")


# ---------------------------------------------------------------- files


def _folder(spark) -> str:
    """A folder of the shared checkpoint folder that driver and executors see by the same path."""
    path = os.path.join(shared_path(checkpoint_root(spark)), f"files-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


@_query(f"WITH {F1} SELECT x, y, label FROM f1")
def label_tiff(spark, sf_dir):
    """Labels written as a TIFF and read back by padded tiles."""
    px = _pixels(spark, sf_dir)
    path = raster_source.write_labels(px, f"{_folder(spark)}/labels.tif", W, _height(px))
    return raster_source.pixels_of(raster_source.read_tiles(spark, path, 64, 8, edge="cover"), 64)


@_query(f"WITH {F1} SELECT x, y, CAST(label <> 0 AS BIGINT) AS label FROM f1")
def mask_tiff(spark, sf_dir):
    px = _pixels(spark, sf_dir)
    path = raster_source.write_mask(px, f"{_folder(spark)}/mask.tif", W, _height(px))
    return raster_source.pixels_of(raster_source.read_tiles(spark, path, 64, edge="cover"), 64)


@_query(f"WITH {F1} SELECT CAST({W} AS INT) AS width, CAST(max(y) + 1 AS INT) AS height, CAST(1 AS INT) AS bands, CASE WHEN max(label) <= 255 THEN 'uint8' WHEN max(label) <= 65535 THEN 'uint16' ELSE 'uint32' END AS dtype, CAST(32723 AS INT) AS crs, 2.0::DOUBLE AS pixel, CAST(0 AS DOUBLE) AS nodata FROM f1")
def tiff_metadata(spark, sf_dir):
    px = _pixels(spark, sf_dir)
    h = read_header(raster_source.write_labels(px, f"{_folder(spark)}/labels.tif", W, _height(px), 32723, (2.0, 0.0, 100.0, 0.0, -2.0, 900.0)))
    return spark.createDataFrame([(h.width, h.height, h.bands, h.dtype, h.crs, h.transform[0], float(h.nodata))], "width int, height int, bands int, dtype string, crs int, pixel double, nodata double")


@_query(f"WITH {F1} SELECT x, y, label, CASE WHEN x // 16 < 3 THEN 'left' ELSE 'right' END AS half FROM f1")
def tile_windows_read(spark, sf_dir):
    """The whole raster by two reads, each of which opens the tiles of its own half only."""
    px = _pixels(spark, sf_dir)
    path = raster_source.write_labels(px, f"{_folder(spark)}/labels.tif", W, _height(px), compression="deflate")
    read = lambda where, half: raster_source.pixels_of(raster_source.read_tiles(spark, path, 16, 4, edge="cover", where=where), 16).withColumn("half", F.lit(half))
    return read("x1 <= 48", "left").unionByName(read("x0 >= 48", "right"))


@_query(f"WITH {F1} SELECT x, y, CAST((label // 256) % 256 AS DOUBLE) AS band_2, CAST(fg AS DOUBLE) AS band_3 FROM f1")
def band_tiff(spark, sf_dir):
    """Three bands written by tasks, of which two are read back."""
    px = fx.label_raster(spark, sf_dir).selectExpr("x", "y", "label % 256 AS low", "(label div 256) % 256 AS high", "fg")
    path = raster_source.write_bands(px, ["low", "high", "fg"], f"{_folder(spark)}/bands.tif", W, _height(px))
    columns = "tile_row int, tile_col int, crop_x int, crop_y int, width int, height int, dtype string, band_2 binary, band_3 binary"
    return raster_source.bands_of(raster_source.read_tiles(spark, path, 64, 8, edge="cover", columns=columns), [2, 3], 64)


@_query(f"WITH {F1} SELECT x, y, label FROM f1")
def mosaic_blocks(spark, sf_dir):
    """The raster put into a mosaic, by blocks, and read back."""
    px = _pixels(spark, sf_dir)
    m = Mosaic(spark, W, _height(px), 20, "disk")
    m.update(px)
    return m.read()


@_query(f"WITH {F1} SELECT x, y, label, 1 AS version FROM f1 UNION ALL SELECT x, y, CASE WHEN fg = 1 AND tr % 3 = 1 THEN label + 100000 ELSE label END, 2 FROM f1")
def mosaic_versions(spark, sf_dir):
    """A raster and a later version of it, of which some tiles were written again."""
    px = fx.label_raster(spark, sf_dir)
    m = MosaicTable(spark, f"{_folder(spark)}/mosaic", W, _height(px), T)
    first = m.update(px)
    second = m.update(px.where("fg = 1 and tr % 3 = 1").withColumn("label", F.col("label") + 100000))
    return m.read(first).withColumn("version", F.lit(1)).unionByName(m.read(second).withColumn("version", F.lit(2)))


_FEATURES = _PER_LABEL + """, side AS (SELECT cc.comp, count(*) AS n FROM cc JOIN f1 p ON cc.id = p.y * 100 + p.x, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy) LEFT JOIN f1 q ON q.x = p.x + d.dx AND q.y = p.y + d.dy WHERE q.label IS NULL OR q.label <> p.label GROUP BY cc.comp)
SELECT f1.label AS label_id, CAST(area.area AS DOUBLE) AS area_m2, CAST(side.n AS DOUBLE) AS perimeter_m, CAST(area.area AS DOUBLE) AS drawn FROM area JOIN side USING (comp) JOIN f1 ON area.comp = f1.y * 100 + f1.x"""


def _feature_file(kind: str):
    def query(spark, sf_dir):
        path = f"{_folder(spark)}/segments{kind}"
        vector_files.save_features(vector.polygons(fx.label_raster(spark, sf_dir), tolerance=0.0, width=W, block=BLOCK), path, 32723)
        return vector.drawn_areas(vector_files.read_features(spark, path)).select("label_id", "area_m2", "perimeter_m", "drawn")

    return query


#: Polygons written to a file and read back, with the area that their rings draw.
for _kind in (".shp", ".gpkg", ".geojson"):
    _QUERIES[f"features_{_kind[1:]}"] = _feature_file(_kind)
    _SQL[f"features_{_kind[1:]}"] = _FEATURES


# ---------------------------------------------------------------- masks


@_query(f"""WITH {F2}, b AS (SELECT mask_id, count(*) AS area, min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max FROM mask_px GROUP BY mask_id)
SELECT f2.mask_id, coalesce(area, 0) AS area, CAST(coalesce(x_min, 0) AS INT) AS x_min, CAST(coalesce(y_min, 0) AS INT) AS y_min, CAST(coalesce(x_max, 0) AS INT) AS x_max, CAST(coalesce(y_max, 0) AS INT) AS y_max FROM f2 LEFT JOIN b USING (mask_id)""")
def mask_area_bbox(spark, sf_dir):
    return fx.masks(spark, sf_dir).select("mask_id", masks.area(F.col("bits")).alias("area"), masks.bbox(F.col("bits"), 8).alias("b")).select("mask_id", "area", "b.*")


@_query(f"""WITH {F2}, d AS (SELECT DISTINCT tile_id, y * 8 + x AS p FROM mask_px), s AS (SELECT d.tile_id, d.p FROM d LEFT JOIN d q ON q.tile_id = d.tile_id AND q.p = d.p - 1 WHERE q.p IS NULL),
e AS (SELECT d.tile_id, d.p + 1 AS p FROM d LEFT JOIN d q ON q.tile_id = d.tile_id AND q.p = d.p + 1 WHERE q.p IS NULL)
SELECT s.tile_id, CAST(s.p AS BIGINT) AS run_start, CAST(min(e.p) AS BIGINT) AS run_end FROM s JOIN e ON e.tile_id = s.tile_id AND e.p > s.p GROUP BY s.tile_id, s.p""")
def mask_union_runs(spark, sf_dir):
    """What a tile's masks cover together, as runs."""
    found = runs.union(masks.with_runs(fx.masks(spark, sf_dir)), "tile_id")
    return found.select("tile_id", F.explode(F.transform(F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1), lambda k: F.struct(F.get("runs", k * 2).alias("run_start"), F.get("runs", k * 2 + 1).alias("run_end")))).alias("r")).select("tile_id", "r.*")


@_query(f"""WITH {F2}, n AS (SELECT mask_id, count(*) AS n FROM mask_px GROUP BY mask_id), s AS (SELECT p.tile_id, p.mask_id AS mask_a, q.mask_id AS mask_b, count(*) AS shared FROM mask_px p JOIN mask_px q ON p.tile_id = q.tile_id AND p.x = q.x AND p.y = q.y AND p.mask_id < q.mask_id GROUP BY ALL)
SELECT tile_id, mask_a, mask_b, round(shared / (a.n + b.n - shared), 6) AS iou FROM s JOIN n a ON a.mask_id = mask_a JOIN n b ON b.mask_id = mask_b WHERE shared / (a.n + b.n - shared) >= 0.35""")
def mask_iou_pairs(spark, sf_dir):
    return masks.iou_pairs(fx.masks(spark, sf_dir), 0.35).select("tile_id", "mask_a", "mask_b", *_r("iou"))


@_query(f"""WITH {F2}, px AS (SELECT mask_id // 3 AS mask_id, mask_id // 30 AS tile_id, mask_id % 3 * 64 + y * 8 + x AS d FROM mask_px), n AS (SELECT mask_id, count(*) AS n FROM px GROUP BY mask_id),
s AS (SELECT p.tile_id, p.mask_id AS mask_a, q.mask_id AS mask_b, count(*) AS shared FROM px p JOIN px q ON p.tile_id = q.tile_id AND p.d = q.d AND p.mask_id < q.mask_id GROUP BY ALL)
SELECT tile_id, mask_a, mask_b, round(shared / (a.n + b.n - shared), 6) AS iou FROM s JOIN n a ON a.mask_id = mask_a JOIN n b ON b.mask_id = mask_b WHERE shared / (a.n + b.n - shared) >= 0.33""")
def large_mask_iou_pairs(spark, sf_dir):
    """Masks of 192 pixels, three of the small ones side by side."""
    parts = fx.masks(spark, sf_dir).groupBy(F.expr("mask_id div 3").alias("mask_id")).agg(F.array_sort(F.collect_list(F.struct((F.col("mask_id") % 3).alias("k"), "bits"))).alias("p"))
    empty = F.array_repeat(F.lit(0).cast("tinyint"), 64)  # the last one may be short
    bits = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.coalesce(F.get(F.filter("p", lambda x: x["k"] == k), 0)["bits"], empty)))
    return masks.iou_pairs(parts.select("mask_id", F.expr("mask_id div 10").alias("tile_id"), bits.alias("bits")), 0.33).select("tile_id", "mask_a", "mask_b", *_r("iou"))


@_query(f"WITH {F2} SELECT DISTINCT tile_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM mask_px")
def mask_union(spark, sf_dir):
    return masks.union_pixels(fx.masks(spark, sf_dir), 8, "tile_id")


@_query(f"WITH {F2}, c AS (SELECT DISTINCT tile_id, x, y FROM mask_px WHERE ord = 0) SELECT tile_id, mask_id, count(*) AS shared FROM mask_px JOIN c USING (tile_id, x, y) WHERE ord > 0 GROUP BY tile_id, mask_id")
def mask_overlap(spark, sf_dir):
    m = fx.masks(spark, sf_dir)
    return masks.overlap_with(m.where("ord > 0"), m.where("ord = 0"))


@_query(f"WITH {F2} SELECT tile_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(max(ord) + 1 AS BIGINT) AS label FROM mask_px GROUP BY tile_id, x, y")
def labels_last_wins(spark, sf_dir):
    return masks.rasterise(fx.masks(spark, sf_dir), 8)


@_query(f"WITH {F2} SELECT tile_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(min(ord) + 1 AS BIGINT) AS label FROM mask_px GROUP BY tile_id, x, y")
def labels_first_wins(spark, sf_dir):
    return masks.rasterise(fx.masks(spark, sf_dir), 8, last_wins=False)


@_query(f"WITH {F2}, a AS (SELECT mask_id, tile_id, ord, CAST(list_sum(bits) AS BIGINT) AS area FROM f2) SELECT mask_id, area, row_number() OVER (PARTITION BY tile_id ORDER BY area, ord) - 1 AS place FROM a")
def masks_by_area(spark, sf_dir):
    return masks.by_area(fx.masks(spark, sf_dir)).select("mask_id", "area", F.col("place").cast("long"))


@_query(f"WITH {F2} SELECT mask_id, score FROM f2 WHERE score > 0.3 AND score > 0.45")
def quality_filter(spark, sf_dir):
    return fx.masks(spark, sf_dir).where("score > 0.3 and score > 0.45").select("mask_id", "score")


def _nms_sql(threshold: float) -> str:
    return f"""WITH RECURSIVE {F2}, box AS (
  SELECT f2.mask_id, f2.tile_id, f2.ord, row_number() OVER (PARTITION BY f2.tile_id ORDER BY score DESC, f2.mask_id) AS rk, x0, y0, x1, y1
  FROM f2 LEFT JOIN (SELECT mask_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM mask_px GROUP BY mask_id) USING (mask_id)
), met AS (
  SELECT q.tile_id, q.rk, p.rk AS by_rk, greatest(least(p.x1, q.x1) - greatest(p.x0, q.x0), 0) * greatest(least(p.y1, q.y1) - greatest(p.y0, q.y0), 0) AS shared,
         (p.x1 - p.x0) * (p.y1 - p.y0) + (q.x1 - q.x0) * (q.y1 - q.y0) AS total
  FROM box p JOIN box q ON p.tile_id = q.tile_id AND p.rk < q.rk
), rivals AS (
  SELECT box.tile_id, box.rk, coalesce(list(met.by_rk) FILTER (met.shared > {threshold} * (met.total - met.shared)), []) AS r FROM box LEFT JOIN met USING (tile_id, rk) GROUP BY ALL
), walk(tile_id, rk, kept) AS (
  SELECT DISTINCT tile_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM box
  UNION ALL
  SELECT w.tile_id, w.rk + 1, CASE WHEN len(list_intersect(w.kept, v.r)) > 0 THEN w.kept ELSE list_append(w.kept, w.rk + 1) END
  FROM walk w JOIN rivals v ON v.tile_id = w.tile_id AND v.rk = w.rk + 1
), last AS (SELECT tile_id, arg_max(kept, rk) AS kept FROM walk GROUP BY tile_id)
SELECT mask_id, tile_id, ord FROM box JOIN last USING (tile_id) WHERE list_contains(kept, rk)"""


@_query(_nms_sql(0.95))
def box_nms(spark, sf_dir):
    return masks.box_nms(fx.masks(spark, sf_dir), 8, 0.95).select("mask_id", "tile_id", "ord")


#: Components of each mask by relaxation, then acceptance one after the other: at least three pixels, less than half covered.
_ACCEPT = f"""WITH RECURSIVE {F2}, px AS (SELECT mask_id, tile_id, ord, CAST(y * 8 + x AS BIGINT) AS d, x, y FROM mask_px), nb AS (
  SELECT p.mask_id, p.d AS a, q.d AS b FROM px p JOIN px q ON p.mask_id = q.mask_id AND abs(p.x - q.x) + abs(p.y - q.y) = 1
), cc(mask_id, d, comp) USING KEY (mask_id, d) AS (
  SELECT mask_id, d, d FROM px
  UNION
  SELECT nb.mask_id, nb.a, min(cc.comp) FROM cc JOIN nb ON cc.mask_id = nb.mask_id AND cc.d = nb.b JOIN recurring.cc r ON r.mask_id = nb.mask_id AND r.d = nb.a WHERE cc.comp < r.comp GROUP BY nb.mask_id, nb.a
), part AS MATERIALIZED (
  SELECT px.tile_id, px.ord, cc.comp, list(cc.d) AS ds, row_number() OVER (PARTITION BY px.tile_id ORDER BY px.ord, cc.comp) AS k FROM cc JOIN px USING (mask_id, d) GROUP BY px.tile_id, px.ord, cc.comp
), walk(tile_id, k, labels, following, taken) AS (
  SELECT DISTINCT tile_id, CAST(0 AS BIGINT), list_transform(range(0, 64), lambda i: CAST(0 AS BIGINT)), CAST(1 AS BIGINT), FALSE FROM f2
  UNION ALL
  SELECT tile_id, k, CASE WHEN ok THEN list_transform(range(0, 64), lambda i: CASE WHEN labels[i + 1] = 0 AND list_contains(ds, i) THEN following ELSE labels[i + 1] END) ELSE labels END, following + CAST(ok AS BIGINT), ok
  FROM (SELECT w.tile_id, p.k, w.labels, w.following, p.ds, len(p.ds) >= 3 AND len(list_filter(p.ds, lambda i: w.labels[i + 1] <> 0)) * 2 < len(p.ds) AS ok FROM walk w JOIN part p ON p.tile_id = w.tile_id AND p.k = w.k + 1)
), ends AS (SELECT tile_id, max(k) AS k FROM part GROUP BY tile_id
), last AS (SELECT walk.tile_id, walk.labels, walk.following - 1 AS accepted FROM walk LEFT JOIN ends ON ends.tile_id = walk.tile_id WHERE walk.k = coalesce(ends.k, 0))"""


@_query(_ACCEPT + " SELECT tile_id, CAST(d % 8 AS INT) AS x, CAST(d // 8 AS INT) AS y, label FROM (SELECT tile_id, unnest(range(0, 64)) AS d, unnest(labels) AS label FROM last) WHERE label <> 0")
def greedy_accept(spark, sf_dir):
    return multipass.accept_masks(fx.masks(spark, sf_dir), 8, 8, 3)


@_query(_ACCEPT + """, gate AS (SELECT p.tile_id, count(*) FILTER (len(p.ds) < 3) AS small, count(*) AS parts FROM part p GROUP BY p.tile_id)
SELECT tile_id, accepted, coalesce(small, 0) AS filtered_small, coalesce(parts, 0) - coalesce(small, 0) - accepted AS filtered_overlap FROM last LEFT JOIN gate USING (tile_id)""")
def acceptance_counts(spark, sf_dir):
    """What each gate of the greedy acceptance lets through or turns away."""
    return multipass.acceptance_counts(fx.masks(spark, sf_dir), 8, 8, 3)


# ---------------------------------------------------------------- outlines


@_query(f"""WITH {F1}, e AS (SELECT p.label, CASE WHEN d.dx <> 0 THEN 1 ELSE 0 END AS vertical FROM f1 p, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy) LEFT JOIN f1 q ON q.x = p.x + d.dx AND q.y = p.y + d.dy WHERE p.label > 0 AND (q.label IS NULL OR q.label <> p.label))
SELECT label, round(CAST((SELECT count(*) FROM f1 WHERE f1.label = e.label) * 0.5 * 0.25 AS DOUBLE), 6) AS area, round(CAST(sum(CASE WHEN vertical = 1 THEN 0.25 ELSE 0.5 END) AS DOUBLE), 6) AS perimeter FROM e GROUP BY label""")
def region_area_perimeter(spark, sf_dir):
    return vector.measures(fx.label_raster(spark, sf_dir), "label", (0.5, 0.0, 0.0, 0.0, -0.25, 0.0)).select("label", *_r("area", "perimeter"))


@_query(_PER_LABEL + """ SELECT f1.label AS label_id, cc.comp AS part_id, CAST(count(*) AS DOUBLE) AS area_m2 FROM cc JOIN f1 ON cc.id = f1.y * 100 + f1.x GROUP BY ALL""")
def polygon_areas(spark, sf_dir):
    """Polygons traced at tolerance 0: the area of each must be its region's pixels."""
    return vector.polygons(fx.label_raster(spark, sf_dir), tolerance=0.0, width=W, block=BLOCK).select("label_id", "part_id", *_r("area_m2"))


@_query(_PER_LABEL + """, px2 AS (SELECT cc.comp, f1.label, f1.x, f1.y FROM cc JOIN f1 ON cc.id = f1.y * 100 + f1.x),
side AS (SELECT p.comp, count(*) AS n FROM px2 p, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy) LEFT JOIN f1 q ON q.x = p.x + d.dx AND q.y = p.y + d.dy WHERE q.label IS NULL OR q.label <> p.label GROUP BY p.comp),
quad AS (SELECT comp, cx, cy, count(*) AS n, count(*) FILTER (odd) AS o FROM (SELECT comp, x + i AS cx, y + j AS cy, (i + j) % 2 = 1 AS odd FROM px2, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(i, j)) GROUP BY ALL),
euler AS (SELECT comp, (count(*) FILTER (n = 1) - count(*) FILTER (n = 3) + 2 * count(*) FILTER (n = 2 AND o <> 1)) // 4 AS e, count(*) FILTER (n = 2 AND o <> 1) AS pinches FROM quad GROUP BY comp)
SELECT px2.label AS label_id, px2.comp AS part_id, CAST(side.n AS DOUBLE) AS perimeter_m, CAST(2 - euler.e + euler.pinches AS BIGINT) AS n_rings FROM (SELECT DISTINCT comp, label FROM px2) px2 JOIN side USING (comp) JOIN euler USING (comp)""")
def polygon_outlines(spark, sf_dir):
    """Length of each polygon's outline and number of its rings: by the Euler number of its pixels, and one more for each corner where an outline meets itself."""
    found = vector.polygons(fx.label_raster(spark, sf_dir), tolerance=0.0, width=W, block=BLOCK)
    return found.select("label_id", "part_id", *_r("perimeter_m"), F.col("n_rings").cast("bigint"))


@_query(_PER_LABEL + """, own AS (SELECT cc.comp, id % 100 AS x, id // 100 AS y FROM cc),
corners AS (SELECT comp, count(DISTINCT (x + dx, y + dy)) AS n FROM own, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(dx, dy) GROUP BY comp),
sides AS (SELECT comp, count(DISTINCT (k, x + dx, y + dy)) AS n FROM own, (VALUES ('h', 0, 0), ('h', 0, 1), ('v', 0, 0), ('v', 1, 0)) d(k, dx, dy) GROUP BY comp),
rings AS (SELECT comp, 2 - c.n + s.n - a.area AS n FROM corners c JOIN sides s USING (comp) JOIN area a USING (comp))
SELECT comp AS part_id, CAST(n AS INT) AS n_rings, CAST(n AS INT) AS n_rings_simplified, true AS thinner FROM rings""")
def polygon_rings(spark, sf_dir):
    """Each region's rings (its outer one and a ring for each part of the plane that it cuts off) before and after simplification, which adds no points."""
    px = fx.label_raster(spark, sf_dir)
    found = [vector.polygons(px, tolerance=t, width=W, block=BLOCK).select("part_id", F.col("n_rings").alias(f"n{k}"), F.length("wkb").alias(f"size{k}")) for k, t in enumerate((0.0, 1.5))]
    both = found[0].join(found[1], "part_id", "left")
    return both.select("part_id", F.col("n0").alias("n_rings"), F.col("n1").alias("n_rings_simplified"), (F.col("size1") <= F.col("size0")).alias("thinner"))


@_query("""SELECT p_partkey AS label_id, CAST(2 AS BIGINT) AS pieces, CASE WHEN p_partkey % 2 = 0 THEN (p_size + 2) * (p_partkey % 7 + 1) / 2.0::DOUBLE ELSE CAST((p_size + 11) * (p_size + 11) - 24 AS DOUBLE) END AS covered FROM part""")
def valid_polygons(spark, sf_dir):
    """Polygons that cross or overlap themselves, made valid: how many each becomes and what they cover."""
    made = vector.drawn_areas(validity.make_valid(fx.broken_polygons(spark, sf_dir)))
    return made.groupBy("label_id").agg(F.count("*").alias("pieces"), F.sum("drawn").alias("covered"))


@_query()
def polygons(spark, sf_dir):
    return vector.polygons(fx.label_raster(spark, sf_dir), tolerance=1.0, width=W, block=BLOCK)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
