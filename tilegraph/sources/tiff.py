"""A small TIFF codec: baseline strips and tiles, LZW, unsigned and float samples, and the GeoTIFF tags that place an image."""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np

_FORMATS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_DTYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
TILE = 256


@dataclass(frozen=True)
class Header:
    """What an image's directory says."""

    width: int
    height: int
    bands: int
    dtype: str
    crs: int | None
    transform: tuple[float, float, float, float, float, float] | None
    nodata: float | None
    compression: int
    planar: int
    block: tuple[int, int]
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    order: str
    predictor: int = 1


def shared_path(path: str) -> str:
    """The path of a file on a mount that driver and executors share; `file:` is taken off, other file systems are an error."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):", path)
    if scheme and scheme[1].lower() != "file":
        raise ValueError(f"rasters are read and written by blocks at their places, on a shared mount; not on {scheme[1]}")
    return re.sub("^file:/+", "/", path)


def read_header(path: str) -> Header:
    """The header alone, of a classic TIFF or a BigTIFF; no sample is read."""
    path = shared_path(path)
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, "rb") as f:
        head = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        magic = struct.unpack(order + "H", head[2:4])[0] if order else 0
        if magic not in (42, 43):
            raise ValueError(f"not a TIFF file: {path}")
        big = magic == 43
        word, number, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
        f.seek(struct.unpack(order + word, head[8:16] if big else head[4:8])[0])
        (n,) = struct.unpack(order + number, f.read(struct.calcsize(number)))
        entries = f.read(entry * n)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HH" + word, entries, entry * k)
            code = _FORMATS.get(kind)
            if code is None:
                continue
            size = struct.calcsize(order + code) * count
            room = struct.calcsize(word)
            data = entries[entry * (k + 1) - room : entry * (k + 1)]
            if size > room:
                f.seek(struct.unpack(order + word, data)[0])
                data = f.read(size)
            tags[tag] = data[:size].rstrip(b"\0").decode("latin-1") if kind == 2 else struct.unpack(order + code * count, data[:size])
    width, height = tags[256][0], tags[257][0]
    bands, bits, form = tags.get(277, (1,))[0], tags.get(258, (1,))[0], tags.get(339, (1,))[0]
    block = (tags[322][0], tags[323][0]) if 322 in tags else (width, min(tags.get(278, (height,))[0], height))
    transform = None
    if 33550 in tags and 33922 in tags:
        (sx, sy, _), tie = tags[33550][:3], tags[33922]
        transform = (sx, 0.0, tie[3] - tie[0] * sx, 0.0, -sy, tie[4] + tie[1] * sy)
    elif 34264 in tags:
        m = tags[34264]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    keys = tags.get(34735, ())
    crs = next((keys[k + 3] for k in range(4, len(keys), 4) if keys[k] in (3072, 2048) and keys[k + 1] == 0), None)
    nodata = float(tags[42113]) if tags.get(42113) else None
    return Header(width, height, bands, np.dtype(_DTYPES[form, bits]).name, crs, transform, nodata, tags.get(259, (1,))[0], tags.get(284, (1,))[0], block, tags.get(324, tags.get(273)), tags.get(325, tags.get(279)), order, tags.get(317, (1,))[0])


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant first, early change."""
    out = bytearray()
    table: list[bytes] = []
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    acc = held = 0
    width, last = 9, None
    for byte in data:
        acc = (acc << 8 | byte) & 0xFFFFFFFF
        held += 8
        if held < width:
            continue
        held -= width
        code = acc >> held & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = base.copy(), 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """What lzw_decode() reads."""
    out = bytearray()
    acc = held = 0
    table = {bytes((i,)): i for i in range(256)}
    width, following = 9, 258

    def put(code: int):
        nonlocal acc, held
        acc = acc << width | code
        held += width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = following
        following += 1
        if following == 4094:
            put(256)
            table, width, following = {bytes((k,)): k for k in range(256)}, 9, 258
        else:
            width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        word = data[i : i + 1]
    if word:
        put(table[word])
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    put(257)
    if held:
        out.append(acc << (8 - held) & 255)
    return bytes(out)


def read_window(path: str, x: int, y: int, width: int, height: int, bands: list[int] | None = None, header: Header | None = None) -> np.ndarray:
    """(height, width, bands) of a window, cut to the image; only the blocks that it meets are read. Bands count from 1."""
    path = shared_path(path)
    h = header or read_header(path)
    pick = [b - 1 for b in bands] if bands else list(range(h.bands))
    if any(b < 0 or b >= h.bands for b in pick):
        raise ValueError(f"bands run from 1 to {h.bands}")
    x1, y1 = min(x + width, h.width), min(y + height, h.height)
    bw, bh = h.block
    across, down = -(-h.width // bw), -(-h.height // bh)
    dtype = np.dtype(h.dtype).newbyteorder(h.order)
    samples = 1 if h.planar == 2 else h.bands
    out = np.zeros((y1 - y, x1 - x, len(pick)), dtype=h.dtype)
    with open(path, "rb") as f:
        for plane in sorted(set(pick)) if h.planar == 2 else [0]:
            for by in range(y // bh, -(-y1 // bh)):
                for bx in range(x // bw, -(-x1 // bw)):
                    k = plane * across * down + by * across + bx
                    f.seek(h.offsets[k])
                    data = f.read(h.counts[k])
                    if h.compression == 5:
                        data = lzw_decode(data)
                    elif h.compression in (8, 32946):
                        data = zlib.decompress(data)
                    elif h.compression != 1:
                        raise ValueError(f"compression {h.compression} is not supported")
                    rows = len(data) // (bw * samples * dtype.itemsize)
                    part = np.frombuffer(data, dtype=dtype, count=rows * bw * samples).reshape(rows, bw, samples)
                    if h.predictor == 2:
                        part = np.cumsum(part, axis=1, dtype=h.dtype)
                    oy, ox = by * bh, bx * bw
                    ys, ye, xs, xe = max(y, oy), min(y1, oy + rows), max(x, ox), min(x1, ox + bw)
                    piece = part[ys - oy : ye - oy, xs - ox : xe - ox]
                    for n, b in enumerate(pick):
                        if h.planar != 2 or b == plane:
                            out[ys - y : ye - y, xs - x : xe - x, n] = piece[..., 0 if h.planar == 2 else b]
    return out


#: Names of the compressions that are written, and their numbers.
COMPRESSIONS = {"lzw": 5, "deflate": 8}


def encoded(block: np.ndarray, compression: str = "lzw") -> bytes:
    """A full block as Writer.place() takes it."""
    raw = np.ascontiguousarray(block, dtype=block.dtype.newbyteorder("<")).tobytes()
    return lzw_encode(raw) if compression == "lzw" else zlib.compress(raw)


#: Where blocks begin: there is room for either kind of header.
HEAD = 16
#: A classic TIFF's offsets end here.
CLASSIC = 1 << 32


@dataclass(frozen=True)
class Layout:
    """What a written image is, but for its blocks: its header and its directory."""

    width: int
    height: int
    dtype: str
    bands: int = 1
    crs: int | None = None
    transform: tuple | None = None
    nodata: float | None = 0
    compression: str = "lzw"
    tile: int = TILE

    def __post_init__(self):
        if self.compression not in COMPRESSIONS:
            raise ValueError(f"compression must be one of {sorted(COMPRESSIONS)}")

    @property
    def across(self) -> int:
        return -(-self.width // self.tile)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile)

    def empty(self) -> bytes:
        """A block of zeros, encoded."""
        return encoded(np.zeros((self.tile, self.tile, self.bands), dtype=self.dtype), self.compression)

    def head(self, at: int, big: bool) -> bytes:
        """The first HEAD bytes of a file whose directory is at `at`."""
        return struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at).ljust(HEAD, b"\0")

    def directory(self, at: int, offsets, counts, big: bool) -> bytes:
        """The directory, to be written at the even place `at`."""
        dtype = np.dtype(self.dtype)
        form, place = {"u": 1, "i": 2, "f": 3}[dtype.kind], 16 if big else 4
        tags = [
            (256, 4, [self.width]), (257, 4, [self.height]), (258, 3, [dtype.itemsize * 8] * self.bands), (259, 3, [COMPRESSIONS[self.compression]]), (262, 3, [2 if self.bands >= 3 else 1]),
            (277, 3, [self.bands]), (284, 3, [1]), (322, 3, [self.tile]), (323, 3, [self.tile]), (324, place, offsets), (325, place, counts), (339, 3, [form] * self.bands),
        ]
        if self.transform is not None:
            a, b, c, d, e, f = map(float, self.transform)
            if b == d == 0 and e < 0:
                tags += [(33550, 12, [a, -e, 0.0]), (33922, 12, [0.0, 0.0, 0.0, c, f, 0.0])]
            else:
                tags.append((34264, 12, [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
        if self.crs is not None:
            geographic = 4000 <= self.crs < 5000
            tags.append((34735, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, self.crs]))
        if self.nodata is not None:
            tags.append((42113, 2, f"{self.nodata:g}".encode() + b"\0"))
        tags.sort(key=lambda t: t[0])
        word, number, entry, room = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
        after = at + struct.calcsize(number) + entry * len(tags) + room
        entries, extra = [], bytearray()
        for tag, kind, values in tags:
            data = values if kind == 2 else np.asarray(values, dtype=f"<{_NUMPY[kind]}").tobytes()
            if len(data) > room:
                field = struct.pack("<" + word, after + len(extra))
                extra += data + b"\0" * (len(data) % 2)
            else:
                field = data.ljust(room, b"\0")
            entries.append(struct.pack("<HH" + word, tag, kind, len(values)) + field)
        return struct.pack("<" + number, len(tags)) + b"".join(entries) + b"\0" * room + bytes(extra)


_NUMPY = {3: "u2", 4: "u4", 12: "f8", 16: "u8"}


def finish(file, layout: Layout, offsets: np.ndarray, counts: np.ndarray, end: int, big: bool | None = None) -> None:
    """Header and directory of a file whose blocks stand at `offsets`, up to `end`; a count of 0 means a block of zeros. Beyond 4 GB (or if `big`) it is a BigTIFF."""
    missing = counts == 0
    if missing.any():
        empty = layout.empty()
        file.seek(end)
        file.write(empty)
        offsets, counts = np.where(missing, end, offsets), np.where(missing, len(empty), counts)
        end += len(empty)
    at = end + end % 2
    if big is None:
        big = at + 16 * len(offsets) + 4096 >= CLASSIC
    file.seek(at)
    file.write(layout.directory(at, offsets, counts, big))
    file.seek(0)
    file.write(layout.head(at, big))


class Writer:
    """A tiled image written block by block, in any order; blocks never written are zero."""

    def __init__(self, path: str, width: int, height: int, dtype: str, bands: int = 1, crs: int | None = None, transform=None, nodata: float | None = 0, compression: str = "lzw"):
        self.layout = Layout(width, height, dtype, bands, crs, transform, nodata, compression)
        self.file = open(shared_path(path), "wb")  # noqa: SIM115
        self.file.seek(HEAD)
        n = self.layout.across * self.layout.down
        self.offsets, self.counts = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)

    def write(self, bx: int, by: int, block: np.ndarray) -> None:
        """Block (bx, by); edge blocks may be smaller and are filled up."""
        full = np.zeros((TILE, TILE, self.layout.bands), dtype=self.layout.dtype)
        full[: block.shape[0], : block.shape[1]] = block.reshape(*block.shape[:2], self.layout.bands)
        self.place(bx, by, encoded(full, self.layout.compression))

    def place(self, bx: int, by: int, data: bytes) -> None:
        """Block (bx, by) as encoded() has made it."""
        k = by * self.layout.across + bx
        self.offsets[k], self.counts[k] = self.file.tell(), len(data)
        self.file.write(data)

    def close(self) -> None:
        finish(self.file, self.layout, self.offsets, self.counts, self.file.tell())
        self.file.close()


def smallest_dtype(largest: int) -> str:
    """The unsigned type that labels up to `largest` need."""
    return "uint8" if largest <= 255 else "uint16" if largest <= 65535 else "uint32"
