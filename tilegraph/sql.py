"""The engine's functions under SQL names: register(spark), then write queries as text.

Rules on single values are SQL functions with SQL bodies, which the optimiser sees through. What works on a tile's rows
together are Arrow table functions: called with TABLE(...) PARTITION BY (tile_row, tile_col), each tile's rows meet in one task.

    SELECT * FROM tg_cluster_points(TABLE(SELECT x, y, tile_row, tile_col FROM free) PARTITION BY (tile_row, tile_col), 64, 5)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.raster import COLOUR
from .operators import clusters
from .operators.components import label_block

#: Name, parameters, result and body of each function on values.
FUNCTIONS = [
    ("tg_colour(label BIGINT)", "ARRAY<INT>", f"CASE WHEN label = 0 THEN array(0, 0, 0) ELSE transform(array(8, 16, 24), s -> cast(shiftright(pmod(label, 2147483648) * {COLOUR}L, s) & 255 AS INT)) END"),
    ("tg_black_mask(value DOUBLE, mask INT)", "DOUBLE", "CASE WHEN mask <> 0 THEN 0D ELSE value END"),
    ("tg_float_to_uint8(value DOUBLE)", "INT", "cast(least(greatest(value * 255D, 0D), 255D) AS INT)"),
    ("tg_uint16_to_uint8(value INT, largest INT)", "INT", "CASE WHEN largest <= 255 THEN value ELSE value div 256 END"),
    ("tg_map_x(x DOUBLE, y DOUBLE, t ARRAY<DOUBLE>)", "DOUBLE", "t[0] * x + t[1] * y + t[2]"),
    ("tg_map_y(x DOUBLE, y DOUBLE, t ARRAY<DOUBLE>)", "DOUBLE", "t[3] * x + t[4] * y + t[5]"),
    ("tg_tile(k INT, size INT)", "INT", "cast(floor(k / size) AS INT)"),
]


def _ints(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int32))


class _Gathered:
    """Rows of one partition, however many batches they come in."""

    def __init__(self):
        self.held: list[pa.RecordBatch] = []
        self.given: tuple = ()

    def gather(self, table: pa.RecordBatch, *given) -> Iterator[pa.Table]:
        self.held.append(table)
        self.given = tuple(g[0].as_py() if isinstance(g, pa.Array | pa.ChunkedArray) else g for g in given)
        return iter(())

    def grid(self) -> tuple[int, int, int, int, np.ndarray, np.ndarray, pa.Table] | None:
        """(tile_row, tile_col, lowest x, lowest y, x, y, rows)."""
        if not sum(b.num_rows for b in self.held):
            return None
        rows = pa.Table.from_batches(self.held)
        x, y = (rows.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
        return rows.column("tile_row")[0].as_py(), rows.column("tile_col")[0].as_py(), int(x.min()), int(y.min()), x - x.min(), y - y.min(), rows


@F.arrow_udtf(returnType="tile_row int, tile_col int, point_id int, x int, y int")
class ClusterPoints(_Gathered):
    """(x, y, tile_row, tile_col) of valid pixels, points a tile, rounds of erosion: see clusters.tile_points(). Erosion takes what isn't given as invalid."""

    def eval(self, table: pa.RecordBatch, n: pa.Array, rounds: pa.Array) -> Iterator[pa.Table]:
        return self.gather(table, n, rounds)

    def terminate(self) -> Iterator[pa.Table]:
        found = self.grid()
        if found is None:
            return
        row, col, x0, y0, x, y, _ = found
        n, rounds = self.given
        valid = np.zeros((int(y.max()) + 1, int(x.max()) + 1), dtype=bool)
        valid[y, x] = True
        inner = clusters.eroded(valid, rounds)
        rng = np.random.default_rng([42, row, col])
        points = np.argwhere(inner) if inner.sum() <= n else clusters.sample(inner, 10_000, rng)
        if len(points) > n:
            points = points[[int(((points - c) ** 2).sum(axis=1).argmin()) for c in clusters.cluster(points.astype(float), n, rng)]]
        m = len(points)
        yield pa.table({"tile_row": _ints([row] * m), "tile_col": _ints([col] * m), "point_id": _ints(range(m)), "x": _ints(points[:, 1] + x0), "y": _ints(points[:, 0] + y0)})


@F.arrow_udtf(returnType="tile_row int, tile_col int, x int, y int, ordinal bigint")
class TileComponents(_Gathered):
    """(x, y, label, tile_row, tile_col): the components of a tile's labels, numbered from 1 in raster order; see components.tile_ordinals()."""

    def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
        return self.gather(table)

    def terminate(self) -> Iterator[pa.Table]:
        found = self.grid()
        if found is None:
            return
        row, col, x0, y0, x, y, rows = found
        values = np.zeros((int(y.max()) + 1, int(x.max()) + 1), dtype=np.int64)
        values[y, x] = rows.column("label").to_numpy()
        on = values[y, x] != 0
        x, y = x[on], y[on]
        _, place = np.unique(label_block(values)[y, x], return_inverse=True)
        yield pa.table({"tile_row": _ints([row] * len(x)), "tile_col": _ints([col] * len(x)), "x": _ints(x + x0), "y": _ints(y + y0), "ordinal": pa.array(place.astype(np.int64) + 1)})


TABLE_FUNCTIONS = {"tg_cluster_points": ClusterPoints, "tg_tile_components": TileComponents}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session."""
    for signature, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
