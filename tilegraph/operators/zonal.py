"""Statistics of labels, segments, tiles and passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import numbered


def label_counts(pixels: DataFrame) -> DataFrame:
    """(label, n) of all labels, background too."""
    return pixels.groupBy("label").agg(F.count("*").alias("n"))


def label_areas(pixels: DataFrame) -> DataFrame:
    """(label, area) of labels other than background."""
    return pixels.where("label > 0").groupBy("label").agg(F.count("*").alias("area"))


def area_statistics(pixels: DataFrame) -> DataFrame:
    """One row: count, min, max, mean, median and total of label areas; zeros if there is no label."""
    zero = F.lit(0).cast("long")
    return label_areas(pixels).agg(
        F.count("*").alias("n_regions"),
        F.coalesce(F.min("area"), zero).alias("min_area"),
        F.coalesce(F.max("area"), zero).alias("max_area"),
        F.coalesce(F.avg("area"), F.lit(0.0)).alias("mean_area"),
        F.coalesce(F.median("area"), F.lit(0.0)).alias("median_area"),
        F.coalesce(F.sum("area"), zero).alias("total_area"),
    )


def segment_sizes(pixels: DataFrame) -> DataFrame:
    """One row: mean, median, population deviation, min and max of segment sizes; zeros if there is none."""
    zero = F.lit(0).cast("long")
    return label_areas(pixels).agg(
        F.coalesce(F.avg("area"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.median("area"), F.lit(0.0)).alias("median"),
        F.coalesce(F.stddev_pop("area"), F.lit(0.0)).alias("std"),
        F.coalesce(F.min("area"), zero).alias("min"),
        F.coalesce(F.max("area"), zero).alias("max"),
    )


def coverage(pixels: DataFrame, *by: str) -> DataFrame:
    """coverage, the per cent of pixels with a label, overall or by group."""
    share = (F.avg(F.when(F.col("label") > 0, 1.0).otherwise(0.0)) * F.lit(100.0)).alias("coverage")
    return pixels.groupBy(*by).agg(share) if by else pixels.agg(share)


def tile_summary(pixels: DataFrame, row: str = "tr", col: str = "tc") -> DataFrame:
    """By tile: coverage, n_labels (distinct values less one, as if background were always there, not below 0) and max_label."""
    share = (F.avg(F.when(F.col("label") > 0, 1.0).otherwise(0.0)) * F.lit(100.0)).alias("coverage")
    counted = F.greatest(F.count_distinct("label") - 1, F.lit(0)).cast("long").alias("n_labels")
    return pixels.groupBy(F.col(row).alias("tile_row"), F.col(col).alias("tile_col")).agg(share, counted, F.max("label").alias("max_label"))


def nonempty_tiles(pixels: DataFrame, value: str, row: str = "tr", col: str = "tc") -> DataFrame:
    """(tile_row, tile_col) of the tiles whose values do not add up to 0; others are skipped before any kernel runs."""
    return pixels.groupBy(F.col(row).alias("tile_row"), F.col(col).alias("tile_col")).agg(F.sum(F.col(value).cast("long")).alias("total")).where("total <> 0").drop("total")


def threshold_histogram(final: DataFrame, column: str = "final_iou") -> DataFrame:
    """(threshold, tiles): tiles by final threshold, rounded to two places."""
    return final.groupBy(F.round(column, 2).alias("threshold")).agg(F.count("*").alias("tiles"))


def threshold_map(final: DataFrame, column: str = "final_iou") -> DataFrame:
    """threshold_histogram() as one map, ordered by threshold."""
    return threshold_histogram(final, column).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("threshold", "tiles")))).alias("threshold_distribution"))


def coverage_gain(series: DataFrame, scene: str = "scene", step: str = "pass") -> DataFrame:
    """series with gain, the rise in coverage since the pass before (its own coverage at first)."""
    return series.withColumn("gain", F.col("coverage") - F.coalesce(F.lag("coverage").over(W.partitionBy(scene).orderBy(step)), F.lit(0.0)))


def pass_totals(events: DataFrame) -> DataFrame:
    """By tile, ordered lists over passes of masks generated, masks added and coverage, and their totals."""
    listed = F.array_sort(F.collect_list(F.struct("pass", "generated", "added", "coverage")))
    out = events.groupBy("tile_row", "tile_col").agg(listed.alias("p"), F.sum("filtered_overlap").alias("masks_filtered_overlap"), F.sum("filtered_small").alias("masks_filtered_small"))
    lists = {name: F.col("p").getField(n) for name, n in (("masks_generated_per_pass", "generated"), ("masks_per_pass", "added"), ("coverage_per_pass", "coverage"))}
    return out.withColumns(lists | {"total_masks": F.aggregate("p", F.lit(0).cast("long"), lambda s, e: s + e["added"])}).drop("p")


def growth_check(samples: DataFrame, value: str = "used", order: str = "t", least: int = 10, warn_above: float = 1000.0) -> DataFrame:
    """One row: min, max and avg of a monitored series, and how much the last fifth's mean exceeds the first fifth's; null for `least` samples or fewer."""
    placed = numbered(samples.select(order, value), F.asc(order), name="place")
    each, more = divmod(placed.count(), 5)  # the first `more` fifths have a sample more
    place, long_ = F.col("place") - 1, more * (each + 1)
    fifth = placed.withColumn("fifth", F.when(place < long_, F.floor(place / (each + 1)) + 1).otherwise(F.floor((place - long_) / max(each, 1)) + 1 + more))
    early, late = (F.avg(F.when(F.col("fifth") == k, F.col(value))) for k in (1, 5))
    growth = F.when(F.count("*") > least, late - early)
    return fifth.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"), growth.alias("growth"), F.coalesce(growth > warn_above, F.lit(False)).alias("warn"))


def threshold_schedule(steps: DataFrame, index: str, start: float, end: float, step: float) -> DataFrame:
    """steps with threshold, which falls in equal steps from start to end."""
    return steps.withColumn("threshold", F.greatest(F.lit(float(end)), F.lit(float(start)) - F.col(index) * F.lit(float(step))))


def pass_map(covered: DataFrame, *by: str) -> DataFrame:
    """(by, x, y, first_pass): the first pass that covered each pixel."""
    return covered.groupBy(*by, "x", "y").agg(F.min("pass").alias("first_pass"))


def pass_bucket(value: Column, bounds: list[int]) -> Column:
    """The number of the range that a pass falls into: ranges end before each bound."""
    out = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        out = F.when(value < bounds[k], k).otherwise(out)
    return out


def bright_extent(pixels: DataFrame, value: str, limit: int = 200, share: float = 0.5) -> DataFrame:
    """One row (x0, x1, y0, y1): first and last column and row in which more than `share` of the pixels lie below `limit`."""
    dark = F.avg((F.col(value) < limit).cast("double"))
    cols = pixels.groupBy("x").agg(dark.alias("d")).where(F.col("d") > share).agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    rows = pixels.groupBy("y").agg(dark.alias("d")).where(F.col("d") > share).agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    return cols.crossJoin(rows)  # one row each
