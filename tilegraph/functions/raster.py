"""Column expressions on pixel values and on rasters held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What labels are multiplied with to scatter their colours.
COLOUR = 2654435761


def to_uint8(value: Column, kind: str, largest: Column | None = None) -> Column:
    """value as 0 to 255. uint8 stays; uint16 stays where the tile's `largest` is at most 255, else a 256th, cut; floats times 255, clipped and cut."""
    if kind == "uint8":
        return value.cast("int")
    if kind == "uint16":
        if largest is None:
            raise ValueError("uint16 needs the tile's largest value")
        return F.when(largest <= 255, value).otherwise(F.floor(value / 256)).cast("int")
    if kind in ("float32", "float64"):
        return F.least(F.greatest(value * 255.0, F.lit(0.0)), F.lit(255.0)).cast("int")
    raise ValueError(f"no conversion from {kind}")


def to_rgb(bands: Column) -> Column:
    """An array of bands as three: one is repeated, the first three of more are kept, two are an error."""
    n = F.size(bands)
    return F.when(n == 1, F.array_repeat(F.element_at(bands, 1), 3)).when(n >= 3, F.slice(bands, 1, 3)).otherwise(F.raise_error(F.concat(F.lit("no RGB from bands: "), n.cast("string"))))


def black_mask(value: Column, mask: Column) -> Column:
    """0 where the mask is set."""
    return F.when(mask != 0, F.lit(0)).otherwise(value)


def black_mask_array(values: Column, mask: Column) -> Column:
    """black_mask() over two arrays of one length."""
    return F.zip_with(values, mask, lambda v, m: F.when(m != 0, F.lit(0)).otherwise(v))


def crop(x: Column, y: Column, crop_x: Column | int, crop_y: Column | int, tile: int) -> tuple[Column, Column, Column]:
    """(inside, x, y) of a tile's useful area."""
    inside = (x >= crop_x) & (x < crop_x + tile) & (y >= crop_y) & (y < crop_y + tile)
    return inside, x - crop_x, y - crop_y


def affine(x: Column, y: Column, transform: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Map coordinates of a pixel corner: (a x + b y + c, d x + e y + f)."""
    a, b, c, d, e, f = map(float, transform)
    return a * x + b * y + c, d * x + e * y + f


def normalised(x: Column, y: Column, width: int, height: int) -> tuple[Column, Column]:
    """A point as single-precision shares of the image's width and height."""
    return (x / width).cast("float"), (y / height).cast("float")


def shifted(x: Column, y: Column, dx: int, dy: int) -> tuple[Column, Column]:
    return x + dx, y + dy


def colour(label: Column) -> Column:
    """[r, g, b] of a label: black for background, else bits of a product with an odd number."""
    h = F.pmod(label.cast("long"), F.lit(1 << 31)) * F.lit(COLOUR)
    parts = [F.shiftright(h, s).bitwiseAND(255).cast("int") for s in (8, 16, 24)]
    return F.when(label == 0, F.array(F.lit(0), F.lit(0), F.lit(0))).otherwise(F.array(*parts))


def blended(rgb: Column, label: Column, alpha: float = 0.5) -> Column:
    """Image and label colours, mixed by alpha."""
    return F.zip_with(rgb, colour(label), lambda v, c: (v * (1 - alpha) + c * alpha).cast("int"))
