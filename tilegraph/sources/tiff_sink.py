"""Rasters written by tasks: a data source writer whose commit lays out one TIFF.

Each task appends the blocks of its partition to a part file of its own beside the target, and hands the driver where they
are: three numbers a block, never a sample. The commit gives each part its place in the image, lets the
operating system copy the parts there range by range, writes the directory, and renames the file over the target; until
then the target is untouched. A failed or repeated attempt leaves a part that no message names; commit and abort
both take the folder of parts away, so that a task that still runs finds no place to write to.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from .tiff import HEAD, TILE, Layout, encoded, finish, shared_path

#: Bytes that one system call copies at most.
RANGE = 1 << 26
BLOCK_SCHEMA = "by long, bx long, data binary"


@dataclass
class Part(WriterCommitMessage):
    """A part file and, as int64 arrays, the block rows, block columns and sizes of what it holds, in order."""

    path: str
    by: bytes
    bx: bytes
    sizes: bytes


def copy_range(source: int, target: int, size: int, at: int) -> None:
    """`size` bytes of one file to place `at` of another, by the operating system; they don't pass through this process."""
    done = 0
    while done < size:
        n = min(RANGE, size - done)
        try:
            moved = os.copy_file_range(source, target, n, done, at + done)
        except OSError:  # a file system that can't
            os.lseek(target, at + done, os.SEEK_SET)
            moved = os.sendfile(target, source, done, n)
        if not moved:
            raise OSError("a part file is shorter than its task said")
        done += moved


class TiffWriter(DataSourceArrowWriter):
    """Options: width, height (required), dtype (uint32), bands (1), compression (lzw or deflate), crs, transform (six numbers), nodata (0, or none), bigtiff (auto, yes), encoded (no).

    Rows are blocks (by, bx, data) of 256 x 256 pixels, row by row, bands interleaved; blocks at the right and lower edge
    are full, too. With encoded=yes `data` is compressed already. Blocks that don't come are zero, a block that comes twice
    or lies outside is an error.
    """

    def __init__(self, options, schema, overwrite: bool):
        if "path" not in options or "width" not in options or "height" not in options:
            raise ValueError("a path and the options width and height are needed")
        self.path, self.overwrite = shared_path(options["path"]), overwrite
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"
        numbers = [float(v) for v in options["transform"].split(",")] if options.get("transform") else None
        if numbers and len(numbers) != 6:
            raise ValueError("transform has six numbers")
        nodata = options.get("nodata", "0")
        self.layout = Layout(
            int(options["width"]), int(options["height"]), options.get("dtype", "uint32"), int(options.get("bands", 1)), int(options["crs"]) if options.get("crs") else None,
            tuple(numbers) if numbers else None, None if nodata == "none" else float(nodata), options.get("compression", "lzw"),
        )
        self.big = True if options.get("bigtiff") == "yes" else None
        self.encoded = options.get("encoded", "no").lower() in ("yes", "true")
        if missing := {"by", "bx", "data"} - {f.name for f in schema.fields}:
            raise ValueError(f"blocks have the columns {BLOCK_SCHEMA}; there is no {', '.join(sorted(missing))}")
        os.makedirs(self.folder)  # on the driver, before any task

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        name, rows, cols, sizes = f"{self.folder}/{uuid.uuid4().hex}", [], [], []
        full = TILE * TILE * self.layout.bands * np.dtype(self.layout.dtype).itemsize
        with open(name, "wb") as f:
            for batch in iterator:
                at = [batch.schema.get_field_index(c) for c in ("by", "bx", "data")]
                for by, bx, data in zip(*(batch.column(k) for k in at), strict=True):
                    by, bx, data = by.as_py(), bx.as_py(), data.as_py()
                    if not (0 <= by < self.layout.down and 0 <= bx < self.layout.across):
                        raise ValueError(f"block ({by}, {bx}) lies outside {self.layout.width} x {self.layout.height}")
                    if not self.encoded:
                        if len(data) != full:
                            raise ValueError(f"block ({by}, {bx}) has {len(data)} bytes, not {full}")
                        data = encoded(np.frombuffer(data, dtype=self.layout.dtype), self.layout.compression)
                    f.write(data)
                    rows.append(by)
                    cols.append(bx)
                    sizes.append(len(data))
        return Part(name, *(np.array(x, dtype=np.int64).tobytes() for x in (rows, cols, sizes)))

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None]
        staged = f"{self.folder}.tif"
        try:
            if not self.overwrite and os.path.exists(self.path):
                raise FileExistsError(f"{self.path} is there; mode overwrite replaces it")
            n = self.layout.across * self.layout.down
            offsets, counts, at = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), HEAD
            with open(staged, "wb") as out:
                for m in parts:
                    by, bx, sizes = (np.frombuffer(x, dtype=np.int64) for x in (m.by, m.bx, m.sizes))
                    place = by * self.layout.across + bx
                    if len(np.unique(place)) < len(place) or counts[place].any():
                        raise ValueError("a block was written twice")
                    ends = np.cumsum(sizes)
                    offsets[place], counts[place] = at + ends - sizes, sizes
                    if len(sizes):
                        with open(m.path, "rb") as part:
                            copy_range(part.fileno(), out.fileno(), int(ends[-1]), at)
                        at += int(ends[-1])
                finish(out, self.layout, offsets, counts, at, self.big)
            os.replace(staged, self.path)
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.remove(staged)
            self.abort([])

    def abort(self, messages: list[Part | None]) -> None:
        gone = f"{self.folder}-gone"
        with contextlib.suppress(FileNotFoundError):
            os.rename(self.folder, gone)  # at once, whatever tasks are about to open
            shutil.rmtree(gone, ignore_errors=True)
