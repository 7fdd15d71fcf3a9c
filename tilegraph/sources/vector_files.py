"""Vector files of polygon features: shapefile, GeoPackage and GeoJSON, written and read by tasks on a shared mount.

Tasks turn their features into parts in a folder beside the target and report counts, sizes and extents: one row a task is
all that the driver sees. For shapefiles and GeoJSON, tasks of a second job then put each part at its place in the file
(record numbers and offsets counted on from what stands before); a GeoPackage is one database, into which the
database itself copies the parts. Files appear under their names when they are whole. Readers cut a file into ranges of
records or bytes, one a partition.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import sqlite3
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.vector import read_wkb, signed_area, wkb_polygon
from .tiff import shared_path
from .tiff_sink import copy_range

DEFAULT_CRS = 4326

# Geographic systems by EPSG code, as name, datum, spheroid, its half axis and inverse flattening.
_GEOGRAPHIC = {
    4326: ("WGS 84", "WGS_1984", "WGS 84", 6378137, 298.257223563),
    4258: ("ETRS89", "European_Terrestrial_Reference_System_1989", "GRS 1980", 6378137, 298.257222101),
    4269: ("NAD83", "North_American_Datum_1983", "GRS 1980", 6378137, 298.257222101),
    4674: ("SIRGAS 2000", "Sistema_de_Referencia_Geocentrico_para_las_AmericaS_2000", "GRS 1980", 6378137, 298.257222101),
}
#: Transverse Mercator zones: first and last code, code of the geographic system, zone of the first, south.
_ZONES = ((32601, 32660, 4326, 1, False), (32701, 32760, 4326, 1, True), (25828, 25838, 4258, 28, False), (26901, 26923, 4269, 1, False), (31965, 31976, 4674, 11, False), (31977, 31985, 4674, 17, True))


def wkt(crs: int | None = None) -> str:
    """Well-known text of an EPSG code: geographic systems and zones as above, web Mercator, else a local system of that name."""
    code = crs or DEFAULT_CRS
    end = f',AUTHORITY["EPSG","{code}"]]'

    def geographic(c: int) -> str:
        name, datum, spheroid, axis, flat = _GEOGRAPHIC[c]
        return f'GEOGCS["{name}",DATUM["{datum}",SPHEROID["{spheroid}",{axis},{flat}]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","{c}"]]'

    if code in _GEOGRAPHIC:
        return geographic(code)
    metre = 'UNIT["metre",1]'
    if code == 3857:
        return f'PROJCS["WGS 84 / Pseudo-Mercator",{geographic(4326)},PROJECTION["Mercator_1SP"],PARAMETER["central_meridian",0],PARAMETER["scale_factor",1],PARAMETER["false_easting",0],PARAMETER["false_northing",0],{metre}{end}'
    for first, last, base, zone, south in _ZONES:
        if first <= code <= last:
            n = code - first + zone
            parameters = {"latitude_of_origin": 0, "central_meridian": 6 * n - 183, "scale_factor": 0.9996, "false_easting": 500000, "false_northing": 10000000 if south else 0}
            listed = ",".join(f'PARAMETER["{k}",{v}]' for k, v in parameters.items())
            return f'PROJCS["{_GEOGRAPHIC[base][0]} / UTM zone {n}{"S" if south else "N"}",{geographic(base)},PROJECTION["Transverse_Mercator"],{listed},{metre}{end}'
    return f'LOCAL_CS["EPSG:{code}",{metre}{end}'


def _oriented(rings: list[np.ndarray], outer_positive: bool) -> list[np.ndarray]:
    return [r if (signed_area(r) > 0) == (outer_positive == (k == 0)) else r[::-1] for k, r in enumerate(rings)]


FEATURE = ["label_id", "area_m2", "perimeter_m", "wkb"]
_PART = "place long, name string, n long, sizes array<long>, x0 double, y0 double, x1 double, y1 double"
_DBF = [(b"label_id", b"N", 18, 0), (b"area_m2", b"N", 24, 6), (b"perimeter_", b"N", 24, 6)]
_DBF_HEAD, _DBF_ROW = 32 + 32 * len(_DBF) + 1, 1 + sum(f[2] for f in _DBF)
_JSON_HEAD, _JSON_TAIL = b'{"type": "FeatureCollection", "features": [', b"\n]}\n"
#: Bytes of records that a task numbers anew at a time.
RENUMBERED = 1 << 24

# ---------------------------------------------------------------- parts


class _Part:
    """What a task writes: counts and extents here, bytes in the formats below."""

    def __init__(self, name: str):
        self.name, self.n, self.box = name, 0, [np.inf, np.inf, -np.inf, -np.inf]

    def add(self, label_id: int, area: float, length: float, wkb: bytes) -> None:
        rings = read_wkb(wkb)
        low, high = rings[0].min(axis=0), rings[0].max(axis=0)
        self.box = [*np.minimum(self.box[:2], low), *np.maximum(self.box[2:], high)]
        self.put(label_id, area, length, wkb, rings, low, high)
        self.n += 1


class _ShapePart(_Part):
    """.shp, .shx and .dbf records, numbered from 1 and placed from 0."""

    def __init__(self, name: str, crs):
        super().__init__(name)
        self.files = [open(f"{name}.{e}", "wb") for e in ("shp", "shx", "dbf")]  # noqa: SIM115

    def put(self, label_id, area, length, wkb, rings, low, high):
        rings = _oriented(rings, outer_positive=False)  # outer rings run clockwise
        points = np.vstack(rings)
        parts = np.cumsum([0] + [len(r) for r in rings[:-1]])
        body = struct.pack("<i4dii", 5, *low, *high, len(rings), len(points)) + parts.astype("<i4").tobytes() + points.astype("<f8").tobytes()
        shp, shx, dbf = self.files
        shx.write(struct.pack(">ii", shp.tell() // 2, len(body) // 2))
        shp.write(struct.pack(">ii", self.n + 1, len(body) // 2) + body)
        dbf.write(f" {label_id:18d}{area:24.6f}{length:24.6f}".encode())

    def close(self) -> list[int]:
        sizes = [f.tell() for f in self.files]
        for f in self.files:
            f.close()
        return sizes


class _JsonPart(_Part):
    """Features, each after a comma and a new line."""

    def __init__(self, name: str, crs):
        super().__init__(name)
        self.file = open(f"{name}.geojson", "wb")  # noqa: SIM115

    def put(self, label_id, area, length, wkb, rings, low, high):
        rings = [r.tolist() for r in _oriented(rings, outer_positive=True)]
        feature = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": rings}, "properties": {"label_id": label_id, "area_m2": area, "perimeter_m": length}}
        self.file.write(b",\n" + json.dumps(feature).encode())

    def close(self) -> list[int]:
        size = self.file.tell()
        self.file.close()
        return [size]


class _TablePart(_Part):
    """Rows of a database of their own."""

    def __init__(self, name: str, crs):
        super().__init__(name)
        self.head = struct.pack("<2sBBi", b"GP", 0, 1, crs or DEFAULT_CRS)
        self.db = sqlite3.connect(f"{name}.gpkg", isolation_level=None)
        self.db.executescript("PRAGMA journal_mode = OFF; PRAGMA synchronous = OFF; BEGIN; CREATE TABLE part (geom BLOB, label_id INTEGER, area_m2 REAL, perimeter_m REAL)")

    def put(self, label_id, area, length, wkb, rings, low, high):
        self.db.execute("INSERT INTO part VALUES (?, ?, ?, ?)", (self.head + wkb, label_id, area, length))

    def close(self) -> list[int]:
        self.db.execute("COMMIT")
        self.db.close()
        return [self.n]


def _write_parts(features: DataFrame, folder: str, kind: type[_Part], crs: int | None) -> list:
    """The parts of all features, in the order of partitions; a row a partition that has any."""

    def run(batches: Iterator[pa.RecordBatch]):
        part = None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if part is None:
                    part = kind(f"{folder}/{uuid.uuid4().hex}", crs)  # an attempt that is lost leaves a part that nobody names
                part.add(*row)
        if part is not None:
            sizes = part.close()
            told = {"place": TaskContext.get().partitionId(), "name": part.name, "n": part.n, "sizes": sizes, **dict(zip(("x0", "y0", "x1", "y1"), map(float, part.box), strict=True))}
            yield pa.RecordBatch.from_pylist([told])

    return sorted(features.select(FEATURE).mapInArrow(run, _PART).collect())


def _place(spark: SparkSession, rows: list[tuple], run) -> None:
    """run(row) for each row, in tasks; a repeated attempt writes the same bytes again."""

    def each(batches):
        for batch in batches:
            for row in batch.to_pylist():
                run(row)
                yield pa.RecordBatch.from_pylist([{"name": row["name"]}])

    placed = spark.createDataFrame(rows, "name string, n long, sizes array<long>, first long, starts array<long>").repartition(max(1, len(rows)))
    placed.mapInArrow(each, "name string").count()


def _starts(parts: list, heads: list[int]) -> list[tuple]:
    """(name, n, sizes, features before, place in each file) of each part, and the places where the last ends."""
    out, first, at = [], 0, list(heads)
    for p in parts:
        out.append((p["name"], p["n"], p["sizes"], first, list(at)))
        first, at = first + p["n"], [a + s for a, s in zip(at, p["sizes"], strict=True)]
    return [*out, (None, 0, [], first, at)]


def _box(parts: list) -> list[float]:
    return [f(p[c] for p in parts) for c, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max))]


@contextlib.contextmanager
def _workplace(path: str):
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    os.makedirs(folder)
    try:
        yield folder
    finally:
        shutil.rmtree(folder, ignore_errors=True)


# ---------------------------------------------------------------- files


def _renumber(row) -> None:
    """A part's records to their places in the files, under their own numbers."""
    shp, shx, dbf = row["starts"]
    ends = [f"{os.path.dirname(row['name'])}/whole.{e}" for e in ("shp", "shx", "dbf")]
    index = np.fromfile(f"{row['name']}.shx", dtype=">i4").reshape(-1, 2).astype(np.int64)
    begin = index[:, 0] * 2
    with open(f"{row['name']}.shp", "rb") as source, open(ends[0], "r+b") as out:
        done = 0
        while done < len(begin):
            upto = max(done + 1, int(np.searchsorted(begin, begin[done] + RENUMBERED)))
            stop = int(begin[upto]) if upto < len(begin) else row["sizes"][0]
            source.seek(int(begin[done]))
            data = np.frombuffer(bytearray(source.read(stop - int(begin[done]))), dtype=np.uint8).copy()
            at = begin[done:upto] - begin[done]
            number = np.arange(row["first"] + done + 1, row["first"] + upto + 1).astype(">i4")
            data[at[:, None] + np.arange(4)] = number.view(np.uint8).reshape(-1, 4)
            out.seek(shp + int(begin[done]))
            out.write(data.tobytes())
            done = upto
    index[:, 0] += shp // 2
    with open(ends[1], "r+b") as out:
        out.seek(shx)
        out.write(index.astype(">i4").tobytes())
    with open(f"{row['name']}.dbf", "rb") as source, open(ends[2], "r+b") as out:
        copy_range(source.fileno(), out.fileno(), row["sizes"][2], dbf)


def save_shapefile(features: DataFrame, path: str, crs: int | None = None) -> int:
    """Writes .shp, .shx, .dbf, .prj; the number of features. Without any, no file is written."""
    base = os.path.splitext(shared_path(path))[0]
    with _workplace(base) as folder:
        parts = _write_parts(features, folder, _ShapePart, crs)
        if not parts:
            return 0
        *rows, (_, _, _, n, (shp, shx, dbf)) = _starts(parts, [100, 100, _DBF_HEAD])
        if shp >= 1 << 31:
            raise ValueError("a shapefile ends at 2 GB; a GeoPackage or GeoJSON doesn't")
        whole = {e: f"{folder}/whole.{e}" for e in ("shp", "shx", "dbf")}
        for e, size in (("shp", shp), ("shx", shx)):
            with open(whole[e], "wb") as f:
                f.write(struct.pack(">i20xi", 9994, size // 2) + struct.pack("<ii4d32x", 1000, 5, *_box(parts)))
        with open(whole["dbf"], "wb") as f:
            f.write(struct.pack("<B3BIHH20x", 3, 124, 1, 1, n, _DBF_HEAD, _DBF_ROW))
            for name, kind, width, decimals in _DBF:
                f.write(struct.pack("<11sc4xBB14x", name, kind, width, decimals))
            f.write(b"\r")
            f.seek(dbf)
            f.write(b"\x1a")
        _place(features.sparkSession, rows, _renumber)
        with open(f"{folder}/whole.prj", "w", encoding="ascii") as f:
            f.write(wkt(crs))
        for e in ("shx", "dbf", "prj", "shp"):
            os.replace(f"{folder}/whole.{e}", f"{base}.{e}")
    return n


def _json_place(row) -> None:
    with open(f"{row['name']}.geojson", "rb") as source, open(f"{os.path.dirname(row['name'])}/whole.geojson", "r+b") as out:
        copy_range(source.fileno(), out.fileno(), row["sizes"][0], row["starts"][0])
        if row["first"] == 0:  # the first feature of all has no comma before it
            out.seek(row["starts"][0])
            out.write(b" ")


def save_geojson(features: DataFrame, path: str, crs: int | None = None) -> int:
    """Writes a FeatureCollection, coordinates as they are; the number of features. Without any, no file is written."""
    path = shared_path(path)
    with _workplace(path) as folder:
        parts = _write_parts(features, folder, _JsonPart, crs)
        if not parts:
            return 0
        *rows, (_, _, _, n, (end,)) = _starts(parts, [len(_JSON_HEAD)])
        with open(f"{folder}/whole.geojson", "wb") as f:
            f.write(_JSON_HEAD)
            f.seek(end)
            f.write(_JSON_TAIL)
        _place(features.sparkSession, rows, _json_place)
        os.replace(f"{folder}/whole.geojson", path)
    return n


def save_geopackage(features: DataFrame, path: str, crs: int | None = None, layer: str = "segments") -> int:
    """Writes one layer; the number of features. Without any, no file is written. The database copies the tasks' parts, no feature passes through Python on the driver."""
    path, srs = shared_path(path), crs or DEFAULT_CRS
    with _workplace(path) as folder:
        parts = _write_parts(features, folder, _TablePart, crs)
        if not parts:
            return 0
        db = sqlite3.connect(f"{folder}/whole.gpkg", isolation_level=None)
        db.executescript(f"""
            PRAGMA application_id = 1196444487; PRAGMA user_version = 10300; PRAGMA journal_mode = OFF; PRAGMA synchronous = OFF;
            CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
            INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined cartesian', -1, 'NONE', -1, 'undefined', NULL), ('Undefined geographic', 0, 'NONE', 0, 'undefined', NULL), ('EPSG:{srs}', {srs}, 'EPSG', {srs}, '{wkt(crs)}', NULL);
            CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
            CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);
            CREATE TABLE {layer} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB, label_id INTEGER, area_m2 REAL, perimeter_m REAL);
            INSERT INTO gpkg_geometry_columns VALUES ('{layer}', 'geom', 'POLYGON', {srs}, 0, 0);
        """)
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", (layer, layer, *_box(parts), srs))
        for p in parts:
            db.execute("ATTACH ? AS part", (f"{p['name']}.gpkg",))
            db.execute(f"INSERT INTO {layer} (geom, label_id, area_m2, perimeter_m) SELECT geom, label_id, area_m2, perimeter_m FROM part.part ORDER BY rowid")
            db.execute("DETACH part")
        db.close()
        os.replace(f"{folder}/whole.gpkg", path)
    return sum(p["n"] for p in parts)


SAVERS = {".shp": save_shapefile, ".gpkg": save_geopackage, ".geojson": save_geojson}


def save_features(features: DataFrame, path: str, crs: int | None = None) -> int:
    """Writes in the format that the file's extension names."""
    saver = SAVERS.get(os.path.splitext(path)[1].lower())
    if saver is None:
        raise ValueError(f"no vector format for {path}; known are {', '.join(SAVERS)}")
    return saver(features, path, crs)


# ---------------------------------------------------------------- reading


class FeatureRange(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class FeatureReader(DataSourceReader):
    """(label_id, area_m2, perimeter_m, wkb) of a file of save_features(); `records` of it a partition, or as many bytes times 1,000 of GeoJSON."""

    def __init__(self, options):
        self.path = shared_path(options["path"])
        self.kind = os.path.splitext(self.path)[1].lower()
        self.records = int(options.get("records", 100_000))
        if self.kind not in SAVERS:
            raise ValueError(f"no vector format for {self.path}; known are {', '.join(SAVERS)}")

    def partitions(self):
        first, step = 0, self.records
        if self.kind == ".shp":
            with open(f"{self.path[:-4]}.dbf", "rb") as f:
                (size,) = struct.unpack("<4xi", f.read(8))
        elif self.kind == ".gpkg":
            db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
            first, size = db.execute("SELECT coalesce(min(fid), 0), coalesce(max(fid), -1) + 1 FROM segments").fetchone()
            db.close()
        else:
            size, step = os.path.getsize(self.path), self.records * 1000
        return [FeatureRange(k, min(k + step, size)) for k in range(first, size, step)] or [FeatureRange(0, 0)]

    def read(self, partition):
        if partition is None or partition.start >= partition.end:
            return iter(())
        return {".shp": self._shapes, ".gpkg": self._rows, ".geojson": self._lines}[self.kind](partition.start, partition.end)

    def _rows(self, start, end):
        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        for blob, *rest in db.execute("SELECT geom, label_id, area_m2, perimeter_m FROM segments WHERE fid >= ? AND fid < ? ORDER BY fid", (start, end)):
            yield (*rest, blob[8:])
        db.close()

    def _lines(self, start, end):
        """Features on lines that begin within the range."""
        with open(self.path, "rb") as f:
            f.seek(max(start - 1, 0))
            if start:
                f.readline()
            while f.tell() < end and (line := f.readline()):
                if line.startswith(b'{"type": "Feature", '):
                    x = json.loads(line.rstrip().rstrip(b","))
                    p = x["properties"]
                    yield p["label_id"], p["area_m2"], p["perimeter_m"], wkb_polygon([np.asarray(r) for r in x["geometry"]["coordinates"]])

    def _shapes(self, start, end):
        with open(self.path, "rb") as shp, open(f"{self.path[:-4]}.shx", "rb") as shx, open(f"{self.path[:-4]}.dbf", "rb") as dbf:
            head, record = struct.unpack("<8xHH", dbf.read(12))
            dbf.seek(head + record * start)
            shx.seek(100 + 8 * start)
            for _ in range(start, end):
                at, words = struct.unpack(">ii", shx.read(8))
                row = dbf.read(record)[1:].decode()
                shp.seek(at * 2 + 8)
                body = shp.read(words * 2)
                parts, points = struct.unpack_from("<ii", body, 36)
                cuts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
                spots = np.frombuffer(body, dtype="<f8", offset=44 + 4 * parts).reshape(points, 2)
                yield int(row[:18]), float(row[18:42]), float(row[42:66]), wkb_polygon([spots[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])


class FeatureSource(DataSource):
    """spark.read.format("tilegraph_features").load("segments.shp"), .gpkg or .geojson"""

    @classmethod
    def name(cls):
        return "tilegraph_features"

    def schema(self):
        return "label_id long, area_m2 double, perimeter_m double, wkb binary"

    def reader(self, schema):
        return FeatureReader(self.options)


def read_features(spark: SparkSession, path: str, records: int = 100_000) -> DataFrame:
    """(label_id, area_m2, perimeter_m, wkb) of a file that save_features() wrote."""
    spark.dataSource.register(FeatureSource)
    return spark.read.format("tilegraph_features").option("records", records).load(path)
