"""Masks as sorted runs: [start, end, start, end, ...) of flat pixel numbers y * width + x.

Runs are disjoint, do not touch, and ascend, so a mask of a million pixels is some thousands of numbers. Measures are Arrow
column functions on whole batches; union, overlap and pairs merge runs in numpy where a tile's masks meet. Nothing
looks at single pixels but encode() and pixels().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNS = "array<bigint>"
#: Masks of one tile that meet in one task when pairs are sought.
PAIR_BLOCK = 256
#: Runs that one comparison of a mask with others looks up at a time.
LOOKUPS = 1 << 20
#: Parts into which a group's masks are dealt before their union is made whole.
PARTS = 16

# ---------------------------------------------------------------- arrays


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a column of lists; a null list is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(values, type=pa.int64()))


def encoded(bits: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs, offsets) of many bit arrays laid end to end."""
    on = np.concatenate((bits != 0, [False]))
    edge = np.zeros(len(on), dtype=bool)
    edge[0], edge[1:] = on[0], on[1:] != on[:-1]
    inner = offsets[1:-1]  # a mask's edge ends a run and begins another
    double = inner[(inner > 0) & (inner < len(bits))]
    double = np.unique(double[on[double - 1] & on[double]])
    at = np.sort(np.concatenate((np.flatnonzero(edge), double, double)), kind="stable")
    starts, ends = at[0::2], at[1::2]
    owner = np.searchsorted(offsets, starts, "right") - 1
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    runs = np.empty(2 * len(starts), dtype=np.int64)
    runs[0::2], runs[1::2] = starts - offsets[owner], ends - offsets[owner]
    return runs, np.concatenate(([0], np.cumsum(2 * counts)))


def merged(runs: np.ndarray) -> np.ndarray:
    """The runs that any of the given ones cover; given ones may overlap and come in any order."""
    starts, ends = runs[0::2], runs[1::2]
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    fresh = np.append(True, starts[1:] > ends[:-1])[: len(starts)]
    out = np.empty(2 * int(fresh.sum()), dtype=np.int64)
    out[0::2], out[1::2] = starts[fresh], ends[np.append(np.flatnonzero(fresh)[1:] - 1, len(ends) - 1)] if len(ends) else ends
    return out


class Cover:
    """Many masks, to be asked how much of each a run covers."""

    def __init__(self, runs: np.ndarray, offsets: np.ndarray):
        self.span = int(runs.max(initial=0)) + 1
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) // 2)
        self.starts, self.ends = runs[0::2] + owner * self.span, runs[1::2] + owner * self.span
        self.before = np.concatenate(([0], np.cumsum(self.ends - self.starts)))

    def _until(self, place: np.ndarray) -> np.ndarray:
        """Pixels of all masks before a place."""
        k = np.searchsorted(self.starts, place, "right")
        last = np.maximum(k - 1, 0)
        over = np.maximum(self.ends[last] - place, 0) if len(self.ends) else 0
        return self.before[k] - np.where(k > 0, over, 0)

    def shared(self, runs: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Pixels that one mask's runs share with each of some masks."""
        out = np.zeros(len(masks), dtype=np.int64)
        starts, ends = (np.minimum(x, self.span) for x in (runs[0::2], runs[1::2]))
        step = max(1, LOOKUPS // max(len(starts), 1))
        for at in range(0, len(masks), step):
            base = masks[at : at + step, None] * self.span
            out[at : at + step] = (self._until(base + ends) - self._until(base + starts)).sum(axis=1)
        return out


# ---------------------------------------------------------------- column functions


def encode_array(bits: pa.Array) -> pa.Array:
    """Lists of bits as lists of runs."""
    values, offsets = _flat(bits)
    return _lists(*encoded(np.nan_to_num(values), offsets))


def _area(runs: pa.Array) -> pa.Array:
    values, offsets = _flat(runs)
    total = np.concatenate(([0], np.cumsum(values[1::2] - values[0::2])))
    return pa.array(total[offsets[1:] // 2] - total[offsets[:-1] // 2])


def _bbox(width: int):
    def run(runs: pa.Array) -> pa.Array:
        values, offsets = _flat(runs)
        first, last = values[0::2], values[1::2] - 1
        wraps = first // width != last // width  # a run over a row's end meets both sides of the raster
        cols = [np.where(wraps, 0, first % width), first // width, np.where(wraps, width - 1, last % width), last // width]
        some, at = np.diff(offsets) > 0, offsets[:-1] // 2
        out = []
        for values_, best in zip(cols, (np.minimum, np.minimum, np.maximum, np.maximum), strict=True):
            found = np.zeros(len(some), dtype=np.int32)
            if some.any():
                found[some] = best.reduceat(values_, at[some])
            out.append(pa.array(found))
        return pa.StructArray.from_arrays(out, names=["x_min", "y_min", "x_max", "y_max"])

    return run


def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    """By row; all rows of a batch are looked up at once."""
    va, oa = _flat(a)
    vb, ob = _flat(b)
    cover = Cover(vb, ob)
    owner = np.repeat(np.arange(len(oa) - 1), np.diff(oa) // 2)
    base = owner * cover.span
    n = cover._until(base + np.minimum(va[1::2], cover.span)) - cover._until(base + np.minimum(va[0::2], cover.span))
    out = np.zeros(len(oa) - 1, dtype=np.int64)
    np.add.at(out, owner, n)
    return pa.array(out)


def encode(bits: Column) -> Column:
    """The runs of an array of bits; null bits are unset."""
    return F.arrow_udf(_typed(encode_array, 1), RUNS)(bits)


def area(runs: Column) -> Column:
    """Number of set pixels."""
    return F.arrow_udf(_typed(_area, 1), "bigint")(runs)


def bbox(runs: Column, width: int) -> Column:
    """STRUCT(x_min, y_min, x_max, y_max), ends included; all 0 for an empty mask."""
    return F.arrow_udf(_typed(_bbox(width), 1), "struct<x_min:int,y_min:int,x_max:int,y_max:int>")(runs)


def shared(a: Column, b: Column) -> Column:
    """Number of pixels that two masks have in common."""
    return F.arrow_udf(_typed(_shared, 2), "bigint")(a, b)


def _typed(f, n: int):
    """f with the annotations by which a column function is told to take and give whole arrays."""

    def one(a: pa.Array) -> pa.Array:
        return f(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return f(a, b)

    return one if n == 1 else two


# ---------------------------------------------------------------- tables


def pixels(masks: DataFrame, width: int, *keep: str) -> DataFrame:
    """(keep..., x, y) of the pixels of each mask (keep..., runs)."""
    pairs = F.transform(F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1), lambda k: F.struct(F.get("runs", k * 2).alias("s"), F.get("runs", k * 2 + 1).alias("e")))
    each = masks.where(F.size("runs") > 0).select(*keep, F.explode(pairs).alias("r")).select(*keep, F.explode(F.sequence(F.col("r.s"), F.col("r.e") - 1)).alias("p"))
    return each.select(*keep, (F.col("p") % width).cast("int").alias("x"), F.floor(F.col("p") / width).cast("int").alias("y"))


def union(masks: DataFrame, *by: str) -> DataFrame:
    """(by..., runs): what any mask of a group covers. A group's masks are merged in parts first, so that only merged runs meet."""

    def run(key, table):
        return pa.table({**{c: pa.array([k.as_py()], type=k.type) for c, k in zip(names, key, strict=True)}, "runs": _lists(r := merged(_flat(table.column("runs"))[0]), np.array([0, len(r)]))})

    out = masks.select(*by, "runs").withColumn("__part", F.pmod(F.xxhash64("runs"), F.lit(PARTS)))
    for names in ([*by, "__part"], [*by]):
        fields = ", ".join(f"`{c}` {out.schema[c].dataType.simpleString()}" for c in names)
        out = out.groupBy(*names).applyInArrow(run, f"{fields}, runs {RUNS}")
    return out


def overlap(masks: DataFrame, covered: DataFrame, by: str = "tile_id") -> DataFrame:
    """(by, mask_id, shared) of the masks (by, mask_id, runs) that share pixels with what is covered (by, runs: one row a group)."""
    met = masks.join(covered.select(F.col(by), F.col("runs").alias("__covered")), by)
    return met.select(by, "mask_id", shared(F.col("runs"), F.col("__covered")).alias("shared")).where("shared > 0")


def _pairs(threshold: float, group_type: str):
    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        order = np.argsort(table.column("mask_id").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        ids, block, n = (table.column(c).to_numpy() for c in ("mask_id", "block", "n"))
        values, offsets = _flat(table.column("runs"))
        cover = Cover(values, offsets)
        first = np.where(n > 0, values[np.minimum(offsets[:-1], max(len(values) - 1, 0))] if len(values) else 0, 0)
        last = np.where(n > 0, values[np.maximum(offsets[1:] - 1, 0)] if len(values) else 0, 0)
        a, b, iou = [], [], []
        for x in np.flatnonzero((block == i) & (n > 0)).tolist():
            others = np.flatnonzero((block == j) & (n > 0))
            others = others[others > x] if i == j else others
            # sizes and extents rule out what can't reach the threshold
            others = others[np.minimum(n[others], n[x]) >= threshold * (1 - 1e-9) * np.maximum(n[others], n[x])]
            others = others[(first[others] < last[x]) & (last[others] > first[x])]
            both = cover.shared(values[offsets[x] : offsets[x + 1]], others)
            ratio = both / (n[x] + n[others] - both)
            near = ratio >= threshold
            a.append(np.minimum(ids[x], ids[others[near]]))
            b.append(np.maximum(ids[x], ids[others[near]]))
            iou.append(ratio[near])
        cat = lambda parts, kind: np.concatenate([*parts, np.zeros(0, dtype=kind)])
        a = cat(a, ids.dtype)
        return pa.table({"group": pa.array([key[0].as_py()] * len(a), type=key[0].type), "mask_a": a, "mask_b": cat(b, ids.dtype), "iou": cat(iou, np.float64)})

    return run


def iou_pairs(masks: DataFrame, threshold: float = 0.5, group: str = "tile_id", block: int | None = None) -> DataFrame:
    """(group, mask_a, mask_b, iou) of the pairs of a group (group, mask_id, runs) whose IoU reaches the threshold (above 0).

    A group's masks are dealt to blocks; a pair of blocks meets in one task, so no group is ever whole in one and a mask
    travels once for each other block of its group. Empty masks pair with none.
    """
    if threshold <= 0:
        raise ValueError("the threshold is above 0")
    block = block or PAIR_BLOCK
    sized = masks.select(F.col(group).alias("group"), F.col("mask_id").cast("long").alias("mask_id"), "runs", area(F.col("runs")).alias("n"))
    blocks = F.ceil(F.col("size") / block).cast("long")
    sizes = masks.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("size"))
    dealt = sized.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("mask_id"), blocks).cast("long")).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "__other"), "j": F.greatest("block", "__other")}).drop("__other", "size")
    kind = sized.schema["group"].dataType.simpleString()
    found = dealt.groupBy("group", "i", "j").applyInArrow(_pairs(float(threshold), kind), f"group {kind}, mask_a long, mask_b long, iou double")
    return found.withColumnRenamed("group", group)
