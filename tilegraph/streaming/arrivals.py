"""Tiles that arrive over time: pixels land in a store of Parquet files, and only seams that a batch touches are looked at again.

The store keeps labels as segmented; contacts are kept by seam line and replaced as a whole, since a
label's best partner is decided along the whole line. Batches are idempotent: a batch that is run again
writes the same files over. A pixel that arrives again stands as its latest batch says.

What a batch costs here grows with the lines that it touches, of which it reads all pixels stored; seam_state.py keeps
those in state and reads a batch's own rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.storage import bounded_broadcast, materialise
from ..operators import seams

PIXELS = "x int, y int, label bigint"


def touched_lines(batch: DataFrame, tile: int) -> DataFrame:
    """(axis, line) of the seams beside which the batch has pixels."""

    def lines(axis: str, across: str) -> DataFrame:
        k = F.col(across)
        return batch.where(((k % tile == 0) & (k > 0)) | (k % tile == tile - 1)).select(F.lit(axis).alias("axis"), F.when(k % tile == 0, k).otherwise(k + 1).cast("int").alias("line"))

    return lines("v", "x").unionByName(lines("h", "y")).distinct()


class SeamStore:
    """Pixels and seam contacts in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, tile: int):
        self.spark, self.root, self.tile = spark, root.rstrip("/"), tile

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _latest(self, pixels: DataFrame) -> DataFrame:
        return pixels.groupBy("x", "y").agg(F.max_by("label", "batch").alias("label"))

    def pixels(self) -> DataFrame:
        """(x, y, label) of what has arrived, each pixel as its latest batch has it."""
        return self._latest(self._read("pixels", PIXELS + ", batch bigint"))

    def _beside(self, lines: DataFrame) -> DataFrame:
        """pixels() beside some seam lines; others are left out at the scan, before anything is shuffled."""
        found = self._read("pixels", PIXELS + ", batch bigint")
        for axis, across in (("v", "x"), ("h", "y")):
            k = F.col(across)
            line = F.when((k % self.tile == 0) & (k > 0), k).when(k % self.tile == self.tile - 1, k + 1)
            own = lines.where(F.col("axis") == axis).select(F.col("line").alias("__line"), F.lit(True).alias(f"__{axis}"))
            found = found.join(bounded_broadcast(own), line == F.col("__line"), "left").drop("__line")
        return self._latest(found.where("__v or __h").drop("__v", "__h"))

    def contacts(self) -> DataFrame:
        """Of each line what its latest batch found."""
        from pyspark.sql import Window as W

        kept = self._read("contacts", "axis string, line int, a bigint, b bigint, cnt bigint, batch bigint")
        return kept.withColumn("last", F.max("batch").over(W.partitionBy("axis", "line"))).where("batch = last and cnt > 0").drop("batch", "last")

    def add(self, batch: DataFrame, number: int) -> None:
        """Take in a batch of pixels and count the contacts along the seams that it touches."""
        rows = batch.select("x", "y", F.col("label").cast("long"))
        rows.write.mode("overwrite").parquet(f"{self.root}/pixels/batch={number}")
        lines = materialise(touched_lines(rows, self.tile))
        met = seams.contacts(self._beside(lines), self.tile)
        found = lines.join(met, ["axis", "line"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("long")))
        found.write.mode("overwrite").parquet(f"{self.root}/contacts/batch={number}")

    def relabel_table(self, strategy: str = "best_match") -> DataFrame:
        """(label, root) over all that has arrived."""
        chosen = seams.ranked(self.contacts())
        rule = "rank_a = 1 or rank_b = 1" if strategy == "best_match" else "rank_a = 1 and rank_b = 1"
        return seams.relabel_table(chosen.where(rule))


def merge_arrivals(stream: DataFrame, store: SeamStore, checkpoint: str) -> StreamingQuery:
    """A streaming query that feeds the store; `stream` has the columns of PIXELS."""
    return stream.writeStream.foreachBatch(lambda df, number: store.add(df, number)).option("checkpointLocation", checkpoint).start()
