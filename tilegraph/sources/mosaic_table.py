"""A mosaic of label blocks as a table of versions in a shared folder, on any file system that Spark writes to.

A write adds files with its own blocks and a small manifest (tile, version, file); nothing else is touched. The manifest appears
under its number by one rename, which fails if another write has taken that number: a version is there whole or
not at all. A reader folds the manifests up to its version, the latest file of each tile, and opens only the files of the
tiles that it asks for. Old versions stay readable until they are vacuumed away.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import bounded_broadcast
from .mosaic import BLOCK

MANIFEST = "tile_row int, tile_col int, version bigint, file string"
#: Blocks in a file: of how many tiles one read of a tile opens the file.
TILES_PER_FILE = 64


class MosaicTable:
    """Blocks of tile x tile labels over a raster of width x height; pixels without a block are background."""

    def __init__(self, spark: SparkSession, root: str, width: int, height: int, tile: int):
        self.spark, self.root, self.width, self.height, self.tile = spark, root.rstrip("/"), width, height, tile

    # ---- files

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{at}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _publish(self, staged: str, name: str) -> None:
        """Rename a staged manifest; an error if its name is taken."""
        jvm = self.spark._jvm
        where = self._path(staged)
        self._fs().mkdirs(self._path("versions"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(where, self._path(f"versions/{name}"), none)

    def _names(self) -> list[str]:
        fs, where = self._fs(), self._path("versions")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    # ---- versions

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, in order."""
        return sorted({int(n.split("-")[0]) for n in self._live(self._names())})

    @staticmethod
    def _live(names: list[str]) -> list[str]:
        """Manifests from the latest folded one on, which holds what the earlier ones say."""
        folded = max((n for n in names if n.endswith("-folded")), default=None)
        return [n for n in names if folded is None or n == folded or n > folded]

    def index(self, version: int | None = None) -> DataFrame:
        """(tile_row, tile_col, version, file) of the tiles there are as of a version, the latest by default."""
        names = self._live(self._names())
        if version is not None:
            if version not in {int(n.split("-")[0]) for n in names}:
                raise ValueError(f"there is no version {version}")
            names = [n for n in names if int(n.split("-")[0]) <= version]
        if not names:
            return self.spark.createDataFrame([], MANIFEST)
        rows = self.spark.read.schema(MANIFEST).parquet(*(f"{self.root}/versions/{n}" for n in names))
        return rows.groupBy("tile_row", "tile_col").agg(F.max(F.struct("version", "file")).alias("m")).select("tile_row", "tile_col", "m.version", "m.file")

    def write_tiles(self, blocks: DataFrame) -> int:
        """Put blocks in the mosaic, as a new version; a tile that is there already gives way in it. A tile given twice is an error."""
        name = uuid.uuid4().hex
        data, staged = f"{self.root}/data/{name}", f"staged-{name}"
        rows = blocks.select("tile_row", "tile_col", "labels").repartitionByRange("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col")
        rows.write.option("maxRecordsPerFile", TILES_PER_FILE).parquet(data)
        written = self.spark.read.schema(BLOCK).parquet(data)
        version = max(self.versions(), default=0) + 1
        manifest = written.select("tile_row", "tile_col", F.lit(version).cast("bigint").alias("version"), F.col("_metadata.file_path").alias("file"))
        manifest.write.parquet(f"{self.root}/{staged}")
        try:
            told = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{staged}")
            if not told.groupBy("tile_row", "tile_col").count().where("count > 1").isEmpty():
                raise ValueError("a tile was written twice")
            self._publish(staged, f"{version:012d}")
        except BaseException:
            for gone in (staged, f"data/{name}"):
                self._fs().delete(self._path(gone), True)
            raise
        return version

    def blocks(self, version: int | None = None, where: str | None = None, tiles: DataFrame | None = None) -> DataFrame:
        """The blocks of a version; of the tiles for which `where` (on tile_row, tile_col) holds, or that are in `tiles`. Only files with such tiles are opened."""
        wanted = self.index(version)
        wanted = wanted.where(where) if where else wanted
        wanted = wanted.join(tiles.select("tile_row", "tile_col").distinct(), ["tile_row", "tile_col"], "left_semi") if tiles is not None else wanted
        files = [r["file"] for r in wanted.select("file").distinct().collect()]  # names of files, as a reader takes them
        if not files:
            return self.spark.createDataFrame([], BLOCK)
        found = self.spark.read.schema(BLOCK).parquet(*files).withColumn("file", F.col("_metadata.file_path"))
        # a file may hold tiles that later versions replace, or that are not asked for
        return found.join(bounded_broadcast(wanted.drop("version")), ["tile_row", "tile_col", "file"], "left_semi").drop("file")

    def read(self, version: int | None = None, where: str | None = None, tiles: DataFrame | None = None) -> DataFrame:
        """(x, y, label) of the pixels within the raster, where a block was written."""
        px = self.blocks(version, where, tiles).select("tile_row", "tile_col", F.posexplode("labels").alias("k", "label"))
        x, y = F.col("tile_col") * self.tile + F.col("k") % self.tile, F.col("tile_row") * self.tile + F.floor(F.col("k") / self.tile)
        return px.select(x.cast("int").alias("x"), y.cast("int").alias("y"), "label").where((F.col("x") < self.width) & (F.col("y") < self.height))

    def update(self, pixels: DataFrame) -> int:
        """Set pixels (x, y, label), as a new version; other pixels of their tiles stay, other tiles aren't read."""
        t = self.tile
        row, col = F.floor(F.col("y") / t).cast("int").alias("tile_row"), F.floor(F.col("x") / t).cast("int").alias("tile_col")
        new = pixels.select(row, col, ((F.col("y") % t) * t + F.col("x") % t).cast("int").alias("k"), F.coalesce(F.col("label").cast("long"), F.lit(0).cast("long")).alias("label"))
        old = self.blocks(tiles=new).select("tile_row", "tile_col", F.col("labels").alias("before"))
        placed = new.groupBy("tile_row", "tile_col").agg(F.map_from_entries(F.collect_list(F.struct("k", "label"))).alias("m"))
        both = placed.join(old, ["tile_row", "tile_col"], "left")
        kept = lambda k: F.coalesce(F.try_element_at("m", k), F.get("before", k), F.lit(0).cast("long"))
        return self.write_tiles(both.select("tile_row", "tile_col", F.transform(F.sequence(F.lit(0), F.lit(t * t - 1)), kept).alias("labels")))

    def vacuum(self, oldest: int) -> int:
        """Give up the versions before `oldest`: their manifests fold into its own, and files that no version left needs are deleted; their number."""
        names = self._live(self._names())
        staged = f"staged-{uuid.uuid4().hex}"
        self.index(oldest).write.parquet(f"{self.root}/{staged}")
        every = self.spark.read.schema(MANIFEST).parquet(*(f"{self.root}/versions/{n}" for n in names)).select("file")
        kept = [f"{self.root}/{staged}", *(f"{self.root}/versions/{n}" for n in names if int(n.split("-")[0]) > oldest)]
        needed = self.spark.read.schema(MANIFEST).parquet(*kept).select("file")
        gone = [r["file"] for r in every.distinct().join(needed.distinct(), "file", "left_anti").collect()]
        self._publish(staged, f"{oldest:012d}-folded")
        fs = self._fs()
        for n in names:
            if int(n.split("-")[0]) <= oldest:
                fs.delete(self._path(f"versions/{n}"), True)
        for file in gone:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(file), False)
        return len(gone)
