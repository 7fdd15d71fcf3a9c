"""Reconciling labels across tile seams: contacts, choice of pairs, closure, relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import BROADCAST_ROWS, join_by_key, materialise
from .closure import components

STRATEGIES = ("best_match", "mutual_best", "min_contact", "none")


def seam_pixels(pixels: DataFrame, tile: int) -> DataFrame:
    """(axis, line, at, a, b): the two labels that meet at each place of each seam.

    Only pixels beside a seam are shuffled, once: both sides of a place land in one group. The modulo filter
    stands on the scan itself.
    """
    label = F.col("label").cast("long")

    def side(axis: str, along: str, across: str) -> DataFrame:
        k = F.col(across)
        beside = pixels.where(((k % tile == 0) & (k > 0)) | (k % tile == tile - 1))
        line = F.when(k % tile == 0, k).otherwise(k + 1)
        return beside.select(F.lit(axis).alias("axis"), line.cast("int").alias("line"), F.col(along).cast("int").alias("at"), F.when(k % tile != 0, label).alias("a"), F.when(k % tile == 0, label).alias("b"))

    if tile < 2:
        raise ValueError("a tile has two pixels a side at least")
    both = side("v", "y", "x").unionByName(side("h", "x", "y"))
    return both.groupBy("axis", "line", "at").agg(F.max("a").alias("a"), F.max("b").alias("b"))


def contacts(pixels: DataFrame, tile: int, ordered: bool = True) -> DataFrame:
    """(axis, line, a, b, cnt): how often two labels meet across each whole seam line; background and equal labels don't count."""
    met = seam_pixels(pixels, tile).where((F.col("a") > 0) & (F.col("b") > 0) & (F.col("a") != F.col("b")))
    if not ordered:
        met = met.select("axis", "line", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.groupBy("axis", "line", "a", "b").agg(F.count("*").alias("cnt"))


def ranked(met: DataFrame) -> DataFrame:
    """contacts with rank_a and rank_b: a label's partners across a line by count, ties to the smaller partner."""
    first = W.partitionBy("axis", "line", "a").orderBy(F.desc("cnt"), "b")
    second = W.partitionBy("axis", "line", "b").orderBy(F.desc("cnt"), "a")
    return met.withColumn("rank_a", F.row_number().over(first)).withColumn("rank_b", F.row_number().over(second))


def choose(met: DataFrame, strategy: str = "best_match", min_contact: int = 20) -> DataFrame:
    """Of contacts (ordered ones, but unordered for min_contact) those to be merged: each side's best partner, partners that agree, or pairs with enough contact."""
    if strategy == "none":
        return met.where(F.lit(False))
    if strategy == "best_match":
        return ranked(met).where("rank_a = 1 or rank_b = 1").drop("rank_a", "rank_b")
    if strategy == "mutual_best":
        return ranked(met).where("rank_a = 1 and rank_b = 1").drop("rank_a", "rank_b")
    if strategy == "min_contact":
        return met.where(F.col("cnt") >= min_contact)
    raise ValueError(f"strategy must be one of {STRATEGIES}")


def chosen(pixels: DataFrame, tile: int, strategy: str = "best_match", min_contact: int = 20) -> DataFrame:
    """Contacts of a raster that are to be merged, see choose()."""
    return choose(contacts(pixels, tile, ordered=strategy != "min_contact"), strategy, min_contact)


def relabel_table(pairs: DataFrame) -> DataFrame:
    """(label, root) of the labels that change: the smallest label reached through the pairs."""
    found = components(pairs.select("a", "b"))
    return found.where(F.col("node") != F.col("component")).select(F.col("node").alias("label"), F.col("component").alias("root"))


def apply_relabel(pixels: DataFrame, table: DataFrame) -> DataFrame:
    """pixels with label replaced by its root where the table has one.

    A table beyond the broadcast bound is joined by label, with large labels dealt out; background never moves.
    """
    named = table.select(F.col("label").alias("__label"), F.col("root").alias("__root"))
    label = F.col("label").cast("long")
    if table.count() <= BROADCAST_ROWS:
        out = pixels.join(F.broadcast(named), label == F.col("__label"), "left")
        return out.withColumn("label", F.coalesce("__root", label)).select(pixels.columns)
    px = pixels.withColumn("__label", label)
    sizes = px.where("__label > 0").groupBy("__label").agg(F.count("*").alias("__n"))
    full = materialise(sizes.join(named.hint("merge"), "__label", "left").withColumn("__root", F.coalesce("__root", "__label")))
    # the written table is compressed and may look small enough to Spark for a broadcast of all its rows
    out = join_by_key(px.where("__label > 0"), full.hint("merge"), "__label", "__n").withColumn("label", F.col("__root"))
    return out.select(pixels.columns).unionByName(px.where("__label <= 0").withColumn("label", label).select(pixels.columns))


def merge_seams(pixels: DataFrame, tile: int, strategy: str = "best_match", min_contact: int = 20) -> DataFrame:
    """pixels relabelled so that what the strategy joins across seams has one label."""
    if strategy == "none":
        return pixels
    return apply_relabel(pixels, materialise(relabel_table(chosen(pixels, tile, strategy, min_contact))))


MERGE_STATS = "merge_strategy string, pairs_found bigint, pairs_after_filter bigint, unique_pairs_to_merge bigint, labels_merged bigint, segments_before_merge bigint, segments_after_merge bigint, segments_reduced bigint"


def merge_stats(pixels: DataFrame, tile: int, strategy: str = "best_match", min_contact: int = 20) -> DataFrame:
    """One row of counts about a merge. Pairs found are ordered pairs a line, but unordered ones for min_contact."""
    met = materialise(contacts(pixels, tile, ordered=strategy != "min_contact"))  # counted once
    kept = materialise(choose(met, strategy, min_contact))
    unique = kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    changed = relabel_table(kept).agg(F.count("*").alias("labels_merged"))
    before = pixels.where("label > 0").agg(F.count_distinct("label").alias("segments_before_merge"))
    found = met.agg(F.count("*").alias("pairs_found"))
    after = kept.agg(F.count("*").alias("pairs_after_filter"))
    distinct = unique.agg(F.count("*").alias("unique_pairs_to_merge"))
    row = found.crossJoin(after).crossJoin(distinct).crossJoin(changed).crossJoin(before)  # five tables of one row each
    if strategy == "none":
        row = row.withColumns({c: F.lit(None).cast("bigint") for c in ("pairs_after_filter", "unique_pairs_to_merge")})
    row = row.withColumn("merge_strategy", F.lit(strategy)).withColumn("segments_after_merge", F.col("segments_before_merge") - F.col("labels_merged"))
    return row.withColumn("segments_reduced", F.col("labels_merged")).select(*(c.split()[0] for c in MERGE_STATS.split(", ")))
