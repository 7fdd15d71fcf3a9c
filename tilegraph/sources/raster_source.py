"""Rasters as Spark sources and sinks: partitions of the tiles that a query asks for, blocks on the way out."""

from __future__ import annotations

import operator
import re
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.raster import COLOUR
from ..operators.grid import EDGES, grid_size
from .tiff import TILE, encoded, read_header, read_window, shared_path, smallest_dtype
from .tiff_sink import TiffWriter

SCHEMA = "tile_row int, tile_col int, read_x int, read_y int, crop_x int, crop_y int, width int, height int, x0 int, y0 int, x1 int, y1 int, bands int, dtype string, data binary"


#: Pixels of the windows that one partition reads, and partitions before tiles share any.
AT_ONCE, FEWEST = 1 << 19, 32


class TilePartition(InputPartition):
    """The tiles of some rows and columns of the grid, both without gaps."""

    def __init__(self, rows: range, cols: range):
        self.rows, self.cols = rows, cols


def runs_of(numbers) -> list[range]:
    """Ascending numbers as ranges without gaps."""
    out: list[range] = []
    for k in numbers:
        if out and out[-1].stop == k:
            out[-1] = range(out[-1].start, k + 1)
        else:
            out.append(range(k, k + 1))
    return out


def rectangles(rows, cols, most: int) -> list[tuple[range, range]]:
    """All places of a grid's rows and columns, in rectangles without gaps of at most `most` places, near square ones where the grid allows it."""
    out = []
    for down in runs_of(rows):
        for across in runs_of(cols):
            w = min(len(across), max(1, isqrt(most)))
            h = min(len(down), most // w)
            w = min(len(across), most // h)
            out += [(down[i : i + h], across[j : j + w]) for i in range(0, len(down), h) for j in range(0, len(across), w)]
    return out


def axis(k: int, n: int, size: int, tile: int, padding: int, edge: str) -> tuple[int, int, int]:
    """(read origin, crop offset, read length) of tile k of n; the rules of grid.axis_window()."""
    if edge == "cover":
        start = max(k * tile - padding, 0)
        return start, k * tile - start, min((k + 1) * tile + padding, size) - start
    reach = tile + 2 * padding
    start, crop = (0, 0) if k == 0 else (size - reach, 2 * padding) if k == n - 1 else (k * tile - padding, padding)
    start = max(start, 0)
    return start, crop, min(reach, size - start)


_COMPARE = {EqualTo: operator.eq, EqualNullSafe: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
#: What a tile's place along one axis decides, by column: the place of the value in TiffReader.along().
_DOWN = {"tile_row": 0, "read_y": 1, "crop_y": 2, "height": 3, "y0": 4, "y1": 5}
_ACROSS = {"tile_col": 0, "read_x": 1, "crop_x": 2, "width": 3, "x0": 4, "x1": 5}
_BAND = re.compile(r"band_([1-9][0-9]*)")


def holds(condition: Filter, value) -> bool | None:
    """Whether a pushed filter holds for a value that is not null; None if it is of a kind that isn't known here."""
    if isinstance(condition, Not):
        inner = holds(condition.child, value)
        return None if inner is None else not inner
    if isinstance(condition, In):
        return value in condition.value
    if isinstance(condition, IsNull | IsNotNull):
        return isinstance(condition, IsNotNull)
    compare = _COMPARE.get(type(condition))
    return None if compare is None else compare(value, condition.value)


def _column(condition: Filter) -> str | None:
    while isinstance(condition, Not):
        condition = condition.child
    path = getattr(condition, "attribute", ())
    return path[0] if len(path) == 1 else None


class TiffReader(DataSourceReader):
    """Tiles of an image. x0 to x1 and y0 to y1 are the pixels that are a tile's own.

    Large tiles are a partition each. Of many small ones a partition takes a rectangle, whose window it reads once: at most
    AT_ONCE pixels with the padding, and no more tiles than leave FEWEST partitions.

    Of a schema that the reader is given only its columns are made: `band_2 binary` reads that band alone, and without
    `data` or a band no sample is read.
    """

    def __init__(self, options, schema: StructType):
        self.path = shared_path(options["path"])
        self.header = read_header(self.path)
        self.tile = int(options.get("tile", max(self.header.width, self.header.height)))
        self.padding = int(options.get("padding", 0))
        self.edge = options.get("edge", "cover" if "tile" not in options else "whole")
        if self.edge not in EDGES:
            raise ValueError(f"edge must be one of {EDGES}")
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        cols, rows, _ = grid_size(self.header.width, self.header.height, self.tile, self.edge)
        if not cols * rows:
            raise ValueError(f"a raster of {self.header.width} x {self.header.height} has no tile of {self.tile}")
        self.shape = rows, cols
        self.rows, self.cols = range(rows), range(cols)
        self.names = [f.name for f in schema.fields]
        known = {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown := [n for n in self.names if n not in known and not _BAND.fullmatch(n)]:
            raise ValueError(f"tiles have no column {unknown[0]}")

    def along(self, k: int, down: bool) -> tuple[int, ...]:
        """(k, read origin, crop offset, read length, first and end of its own pixels) of tile k along one axis."""
        n, size = (self.shape[0], self.header.height) if down else (self.shape[1], self.header.width)
        start, crop, length = axis(k, n, size, self.tile, self.padding, self.edge)
        return k, start, crop, length, k * self.tile, k * self.tile + min(self.tile, length - crop)

    def partitions(self):
        tiles, window = len(self.rows) * len(self.cols), (self.tile + 2 * self.padding) ** 2
        return [TilePartition(*part) for part in rectangles(self.rows, self.cols, max(1, min(AT_ONCE // window, tiles // FEWEST)))]

    def read(self, partition):
        if partition is None:  # what Spark asks for where no tile is left
            return
        h = self.header
        downs, acrosses = [self.along(r, True) for r in partition.rows], [self.along(c, False) for c in partition.cols]
        alone = {n: int(_BAND.fullmatch(n)[1]) for n in self.names if _BAND.fullmatch(n)}
        wanted = (self.bands or list(range(1, h.bands + 1))) if "data" in self.names else []
        asked = sorted({*wanted, *alone.values()})
        top, left = (min(a[1] for a in way) for way in (downs, acrosses))
        if asked:
            bottom, right = (max(a[1] + a[3] for a in way) for way in (downs, acrosses))
            window = read_window(self.path, left, top, right - left, bottom - top, asked, h)
        for down in downs:
            for across in acrosses:
                row = {c: down[k] for c, k in _DOWN.items()} | {c: across[k] for c, k in _ACROSS.items()}
                row |= {"bands": len(self.bands or range(h.bands)), "dtype": h.dtype}
                if asked:
                    y, x = row["read_y"] - top, row["read_x"] - left
                    data = window[y : y + row["height"], x : x + row["width"]]
                    row |= {n: data[:, :, asked.index(b)].tobytes() for n, b in alone.items()}
                    if wanted:
                        row["data"] = data[:, :, [asked.index(b) for b in wanted]].tobytes()
                yield tuple(row[n] for n in self.names)


class PruningReader(TiffReader):
    """Decides filters on where a tile lies, row by row and column by column of the grid: tiles that fail them are in no partition.

    Spark (4.1) keeps one set of pushed filters for a relation, the last one's: two filters on one DataFrame would both
    read what the second asks for. So this reader serves the option prune=yes only, which read_tiles() sets on a relation
    that nothing else can filter.
    """

    def pushFilters(self, filters):
        for condition in filters:
            column = _column(condition)
            if column in _DOWN and holds(condition, 0) is not None:
                self.rows = [k for k in self.rows if holds(condition, self.along(k, True)[_DOWN[column]])]
            elif column in _ACROSS and holds(condition, 0) is not None:
                self.cols = [k for k in self.cols if holds(condition, self.along(k, False)[_ACROSS[column]])]
            else:
                yield condition

class TiffSource(DataSource):
    """spark.read.format("tilegraph_tiff").option("tile", T).option("padding", P).option("bands", "1,2,3").load(path)
    blocks.write.format("tilegraph_tiff").option("width", W).option("height", H).mode("overwrite").save(path)

    The path lies where all executors see it (a shared mount): a tile's task seeks to its own blocks.
    """

    @classmethod
    def name(cls):
        return "tilegraph_tiff"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (PruningReader if self.options.get("prune") == "yes" else TiffReader)(self.options, schema)

    def writer(self, schema, overwrite):
        return TiffWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach it."""
    spark.dataSource.register(TiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_tiles(spark: SparkSession, path: str, tile: int, padding: int = 0, bands: list[int] | None = None, edge: str = "whole", where: str | None = None, columns: str | None = None) -> DataFrame:
    """The padded windows of an image's tiles, raw samples in `data`; or the `columns` asked for, which may name single bands (band_3 binary).

    `where` is a condition on a tile's columns (tile_row = 3 AND x0 < 5000 AND x1 > 4000, say); tiles that its terms on
    places rule out are in no partition. The result may be filtered on as any DataFrame, without further pruning.
    """
    register(spark)
    reader = spark.read.format("tilegraph_tiff").option("tile", tile).option("padding", padding).option("edge", edge).option("prune", "yes" if where else "no")
    reader = reader.option("bands", ",".join(map(str, bands))) if bands else reader
    tiles = (reader.schema(columns) if columns else reader).load(path)
    # no later filter passes one that isn't deterministic, so `where` stays the only one that is pushed
    return tiles.where(where).where(F.monotonically_increasing_id() >= 0) if where else tiles


def to_rgb_blocks(tiles: DataFrame, scale: str = "per_tile", largest: int | None = None) -> DataFrame:
    """Tiles with `rgb`, three bytes a pixel. 16-bit samples beyond 255 are divided by 256, as the tile's (or, with scale="global", the image's) largest value asks."""
    if scale not in ("per_tile", "global"):
        raise ValueError("scale must be per_tile or global")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                image = np.frombuffer(row["data"], dtype=row["dtype"]).reshape(row["height"], row["width"], row["bands"])
                out.append(rgb(uint8(image, largest if scale == "global" else None)).tobytes())
            yield batch.drop_columns(["data"]).append_column("rgb", pa.array(out, type=pa.binary()))

    others = [f for f in tiles.schema.fields if f.name != "data"]
    return tiles.mapInArrow(run, StructType([*others, StructField("rgb", BinaryType())]))


def uint8(image: np.ndarray, largest: int | None = None) -> np.ndarray:
    """Samples as 0 to 255; see functions.raster.to_uint8()."""
    if image.dtype == np.uint8:
        return image
    if image.dtype == np.uint16:
        top = image.max(initial=0) if largest is None else largest
        return (image if top <= 255 else image // 256).astype(np.uint8)
    if image.dtype in (np.float32, np.float64):
        return np.clip(image * 255.0, 0, 255).astype(np.uint8)
    raise ValueError(f"no conversion from {image.dtype}")


def rgb(image: np.ndarray) -> np.ndarray:
    """Bands as three: one is repeated, of more the first three are kept, two are an error."""
    n = 1 if image.ndim == 2 else image.shape[2]
    if n == 2:
        raise ValueError("no RGB from two bands")
    return np.repeat(image.reshape(*image.shape[:2], 1), 3, axis=2) if n == 1 else image[..., :3]


#: Pixels of small tiles that leave a task as one batch.
BATCH = 1 << 16


def _long(batches, tile: int, planes_of, names: list[str], kind):
    """(x, y, names ...): the useful samples of tiles as rows, those of many small tiles in one batch; planes_of() gives a tile's whole planes."""
    held, pixels = [], 0

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["x", "y", *names])

    for batch in batches:
        for row in batch.to_pylist():
            planes = [p[row["crop_y"] :, row["crop_x"] :][:tile, :tile] for p in planes_of(row)]
            y, x = np.indices(planes[0].shape).reshape(2, -1)
            held.append([(x + row["tile_col"] * tile).astype(np.int32), (y + row["tile_row"] * tile).astype(np.int32), *(p.ravel().astype(kind) for p in planes)])
            pixels += len(x)
            if pixels >= BATCH:
                yield batch_of()
                held, pixels = [], 0
    if held:
        yield batch_of()


def pixels_of(tiles: DataFrame, tile: int, band: int = 1) -> DataFrame:
    """(x, y, label): the useful samples of one band of read_tiles(), as a long raster."""

    def planes(row):
        return [np.frombuffer(row["data"], dtype=row["dtype"]).reshape(row["height"], row["width"], row["bands"])[:, :, band - 1]]

    return tiles.mapInArrow(lambda batches: _long(batches, tile, planes, ["label"], np.int64), "x int, y int, label long")


def label_blocks(pixels: DataFrame, dtype: str, tile: int = TILE, compression: str = "lzw") -> DataFrame:
    """(by, bx, data) of a long raster: blocks of tile x tile, made and compressed where their pixels meet."""

    def run(key, table):
        block = np.zeros((tile, tile), dtype=dtype)
        block[table.column("y").to_numpy() % tile, table.column("x").to_numpy() % tile] = table.column("label").to_numpy()
        return pa.table({"by": pa.array([key[0].as_py()], type=pa.int64()), "bx": pa.array([key[1].as_py()], type=pa.int64()), "data": [encoded(block, compression)]})

    keyed = pixels.where("label <> 0").select("x", "y", "label", F.expr(f"cast(y div {tile} as bigint)").alias("by"), F.expr(f"cast(x div {tile} as bigint)").alias("bx"))
    return keyed.groupBy("by", "bx").applyInArrow(run, "by bigint, bx bigint, data binary")


def band_blocks(pixels: DataFrame, bands: list[str], dtype: str, tile: int = TILE) -> DataFrame:
    """(by, bx, data) of a long raster with a column a band; samples stand in the order of `bands`, nulls and absent pixels are 0."""

    def run(key, table):
        block = np.zeros((tile, tile, len(bands)), dtype=dtype)
        y, x = table.column("y").to_numpy() % tile, table.column("x").to_numpy() % tile
        for k in range(len(bands)):
            block[y, x, k] = table.column(f"v{k}").to_numpy()
        return pa.table({"by": pa.array([key[0].as_py()], type=pa.int64()), "bx": pa.array([key[1].as_py()], type=pa.int64()), "data": [block.tobytes()]})

    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"v{k}") for k, c in enumerate(bands)]
    keyed = pixels.select("x", "y", *values, F.expr(f"cast(y div {tile} as bigint)").alias("by"), F.expr(f"cast(x div {tile} as bigint)").alias("bx"))
    return keyed.groupBy("by", "bx").applyInArrow(run, "by bigint, bx bigint, data binary")


def write_bands(pixels: DataFrame, bands: list[str], path: str, width: int, height: int, dtype: str = "uint8", compression: str = "lzw") -> str:
    """Columns of a long raster as the bands of a TIFF; samples of 53 bits at most."""
    register(pixels.sparkSession)
    options = {"width": width, "height": height, "dtype": dtype, "bands": len(bands), "compression": compression, "nodata": "none"}
    band_blocks(pixels, bands, dtype).write.format("tilegraph_tiff").options(**options).mode("overwrite").save(path)
    return path


def bands_of(tiles: DataFrame, bands: list[int], tile: int) -> DataFrame:
    """(x, y, band_1 ...): the useful samples of read_tiles() with single bands as columns, as a long raster."""
    names = [f"band_{b}" for b in bands]

    def planes(row):
        return [np.frombuffer(row[n], dtype=row["dtype"]).reshape(row["height"], row["width"]) for n in names]

    return tiles.mapInArrow(lambda batches: _long(batches, tile, planes, names, np.float64), ", ".join(["x int", "y int", *(f"{n} double" for n in names)]))


def write_labels(pixels: DataFrame, path: str, width: int, height: int, crs: int | None = None, transform=None, nodata: float | None = 0, compression: str = "lzw") -> str:
    """A label raster as a tiled, compressed TIFF of the smallest unsigned type. Tasks write its blocks (tiff_sink.py); the driver sees where they are, not what."""
    register(pixels.sparkSession)
    dtype = smallest_dtype(pixels.agg(F.max("label")).first()[0] or 0)
    options = {"width": width, "height": height, "dtype": dtype, "nodata": "none" if nodata is None else nodata, "compression": compression, "encoded": "yes"}
    options |= {"crs": crs} if crs is not None else {}
    options |= {"transform": ",".join(map(repr, map(float, transform)))} if transform is not None else {}
    label_blocks(pixels, dtype, compression=compression).write.format("tilegraph_tiff").options(**options).mode("overwrite").save(path)
    return path


def write_mask(pixels: DataFrame, path: str, width: int, height: int, crs: int | None = None, transform=None) -> str:
    """A 0/1 raster as 8-bit TIFF."""
    return write_labels(pixels.select("x", "y", (F.col("label") != 0).cast("long").alias("label")), path, width, height, crs, transform)


def png(image: np.ndarray) -> bytes:
    """An (h, w, 3) uint8 image as PNG."""
    import struct
    import zlib

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w, _ = image.shape
    raw = np.zeros((h, 1 + 3 * w), dtype=np.uint8)
    raw[:, 1:] = image.reshape(h, -1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def colours(labels: np.ndarray) -> np.ndarray:
    """functions.raster.colour() of an array of labels."""
    mixed = (labels.astype(np.int64) % (1 << 31)) * COLOUR
    out = np.stack([(mixed >> s).astype(np.uint8) for s in (8, 16, 24)], axis=-1)
    out[labels == 0] = 0
    return out


def write_preview(blocks: DataFrame, pixels: DataFrame, path: str, width: int, height: int, tile: int, alpha: float = 0.5, most_side: int = 1024) -> str:
    """The whole image and its label colours as one PNG; of an image beyond most_side every n-th row and column.

    blocks are to_rgb_blocks() of tiles. Only what the preview shows, at most most_side squared pixels, reaches
    the driver.
    """
    step = max(1, -(-max(width, height) // most_side))
    w, h = -(-width // step), -(-height // step)

    def thin(batches):
        for batch in batches:
            for row in batch.to_pylist():
                image = np.frombuffer(row["rgb"], dtype=np.uint8).reshape(row["height"], row["width"], 3)[row["crop_y"] :, row["crop_x"] :][:tile, :tile]
                x0, y0 = row["tile_col"] * tile, row["tile_row"] * tile
                part = image[-y0 % step :: step, -x0 % step :: step]
                yield pa.RecordBatch.from_pylist([{"x": -(-x0 // step), "y": -(-y0 // step), "w": part.shape[1], "rgb": part.tobytes()}], schema=pa.schema([("x", pa.int32()), ("y", pa.int32()), ("w", pa.int32()), ("rgb", pa.binary())]))

    image, labels = np.zeros((h, w, 3), dtype=np.uint8), np.zeros((h, w), dtype=np.int64)
    thinned = blocks.select("tile_row", "tile_col", "crop_x", "crop_y", "width", "height", "rgb").mapInArrow(thin, "x int, y int, w int, rgb binary")
    for row in thinned.toLocalIterator():
        part = np.frombuffer(row["rgb"], dtype=np.uint8).reshape(-1, max(row["w"], 1), 3)
        room = image[row["y"] : row["y"] + part.shape[0], row["x"] : row["x"] + part.shape[1]]
        room[...] = part[: room.shape[0], : room.shape[1]]
    some = pixels.where((F.col("x") % step == 0) & (F.col("y") % step == 0) & (F.col("label") != 0))
    shown = some.select((F.col("x") / step).cast("int").alias("x"), (F.col("y") / step).cast("int").alias("y"), "label").toArrow()
    labels[shown.column("y").to_numpy(), shown.column("x").to_numpy()] = shown.column("label").to_numpy()
    with open(path, "wb") as f:
        f.write(png((image * (1 - alpha) + colours(labels) * alpha).astype(np.uint8)))
    return path


def tile_previews(tiles: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(tile_row, tile_col, png): image and label colours blended; tiles has rgb and labels of one size, colours hang on the label alone."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                image = np.frombuffer(row["rgb"], dtype=np.uint8).reshape(row["height"], row["width"], 3)
                labels = np.asarray(row["labels"], dtype=np.uint64).reshape(image.shape[:2])
                out.append((row["tile_row"], row["tile_col"], png((image * (1 - alpha) + colours(labels) * alpha).astype(np.uint8))))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["tile_row", "tile_col", "png"])

    return tiles.select("tile_row", "tile_col", "width", "height", "rgb", "labels").mapInArrow(run, "tile_row int, tile_col int, png binary")
